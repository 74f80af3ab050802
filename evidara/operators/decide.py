"""Answer or refuse, and what a pack holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources import vocabulary as V
from ..sources.stage import cut
from .retrieve import top

DEPTH, MIN_SHARED, PACK = 3, 2, 5


def query_plans(cases: DataFrame) -> DataFrame:
    """T5: the plan a case implies: its slots in order, none that a graded turn may not have, and its hypothesis."""
    roles = V.lookup(V.ROLES, F.col("teaching_action"))
    fair = F.filter(roles, lambda r: ~r.isin(V.GRADED_BANNED))
    roles = F.when(F.col("assessment_state") == "graded", F.when(F.size(fair) == 0, F.array(F.lit("explanation"))).otherwise(fair)).otherwise(roles)
    slot = lambda r, i: F.struct(F.concat(F.col("case_id"), F.lit("-s"), i.cast("string")).alias("slot_id"), r.alias("role"), F.lit(True).alias("required"), F.lit(1).alias("min_items"), F.lit(2).alias("max_items"))
    hypothesis = F.when(F.col("teaching_action") == "misconception_correction", F.concat("case_id", F.lit("-misconception")))
    ceiling = V.lookup(V.CEILING, F.col("assessment_state"))
    return cases.select(
        F.concat(F.lit("plan-"), "case_id").alias("plan_id"), "case_id", "teaching_action", "assessment_state", ceiling.alias("ceiling"),
        V.rank(ceiling).alias("ceiling_rank"), F.transform(roles, slot).alias("slots"), hypothesis.alias("hypothesis"),
    )


def top_objects(items: DataFrame, depth: int = DEPTH) -> DataFrame:
    """G1: the first item of each of the first ``depth`` distinct objects."""
    first = top(items.withColumnRenamed("rank", "item_rank"), ["plan_id", "object_id"], 1, F.asc("item_rank")).drop("rank")
    return top(first, ["plan_id"], depth, F.asc("item_rank")).withColumnRenamed("rank", "object_rank")


def same_passage(mine: Column, theirs: Column, my_blocks: Column, their_blocks: Column) -> Column:
    """The same window, or windows that share a block."""
    return (mine == theirs) | F.arrays_overlap(my_blocks, their_blocks)


def gate(plans: DataFrame, primary: DataFrame, other: DataFrame, windows: DataFrame, objects: DataFrame, floor: float, ceiling: float, depth: int = DEPTH, least: int = MIN_SHARED) -> DataFrame:
    """For every plan whether it may be answered, and the reasons if not.

    A top score equal to the floor passes, one equal to the ceiling needs no agreement. Agreement counts objects that both
    runs have among their first ``depth`` with the same passage; one of a teaching type is enough. V16: a gate that no score could
    pass as meant is refused.
    """
    if least < 1 or depth < 1 or ceiling <= floor:
        raise ValueError("a gate needs agreement and depth of 1 at least, and a ceiling above its floor")
    blocks = windows.select("representation_id", "block_ids")
    side = lambda run, n: top_objects(run, depth).join(blocks, "representation_id").select("plan_id", "object_id", F.col("representation_id").alias(f"r{n}"), F.col("block_ids").alias(f"b{n}"))
    both = side(primary, 1).join(side(other, 2), ["plan_id", "object_id"]).filter(same_passage(F.col("r1"), F.col("r2"), F.col("b1"), F.col("b2")))
    kind = objects.select("object_id", F.col("object_type").isin(V.TEACHING_TYPES).alias("teaches"))
    agreed = cut(both.join(kind, "object_id", "left").groupBy("plan_id").agg(F.count(F.lit(1)).alias("corroboration"), F.bool_or(F.coalesce("teaches", F.lit(False))).alias("anchored")))
    best = primary.groupBy("plan_id").agg(F.max_by("score", -F.col("rank")).alias("top_score"))
    d = plans.select("plan_id").join(best, "plan_id", "left").join(agreed, "plan_id", "left")
    d = d.select("plan_id", F.col("top_score").isNotNull().alias("any"), F.coalesce("top_score", F.lit(0.0)).alias("top_score"), F.coalesce("corroboration", F.lit(0)).cast("long").alias("corroboration"), F.coalesce("anchored", F.lit(False)).alias("anchored"))
    weak = F.col("any") & (F.col("top_score") < ceiling) & (F.col("corroboration") < least) & ~F.col("anchored")
    reasons = F.array_compact(F.array(
        F.when(~F.col("any"), F.lit("no candidate")), F.when(F.col("any") & (F.col("top_score") < floor), F.lit("below floor")), F.when(weak, F.lit("not corroborated")),
    ))
    return d.select("plan_id", "top_score", "corroboration", "anchored", F.array_join(reasons, "; ").alias("reasons"), (F.size(reasons) == 0).alias("answerable"))


def admitted(items: DataFrame, decisions: DataFrame, k: int = PACK) -> DataFrame:
    """The pack's items of the plans that are answered."""
    return items.filter(F.col("rank") <= k).join(decisions.filter("answerable").select("plan_id"), "plan_id", "left_semi")


def siblings(packed: DataFrame, scores: DataFrame, other_scores: DataFrame, floor: float) -> DataFrame:
    """B1: other windows of the packed objects at or above the floor that the second run scores too, where it scores any."""
    chosen = packed.select("plan_id", "object_id").distinct()
    own = scores.filter(F.col("score") >= floor).join(chosen, ["plan_id", "object_id"], "left_semi")
    can = other_scores.select("plan_id").distinct().withColumn("can", F.lit(True))
    seen = other_scores.select("plan_id", "representation_id", F.lit(True).alias("seen"))
    both = own.join(can, "plan_id", "left").join(seen, ["plan_id", "representation_id"], "left")
    return both.filter(F.col("can").isNull() | F.col("seen").isNotNull()).select("plan_id", "object_id", "representation_id", "score")


def pack_blocks(packed: DataFrame, sibs: DataFrame, windows: DataFrame) -> DataFrame:
    """B2: for every packed item its blocks: context, own, then siblings in window order, each once."""
    w = windows.select("representation_id", "block_ids", "context_id", "number")
    more = sibs.join(w, "representation_id").groupBy("plan_id", "object_id").agg(F.array_sort(F.collect_list(F.struct("number", "block_ids"))).alias("sib"))
    rows = packed.join(w, "representation_id").join(more, ["plan_id", "object_id"], "left")
    flat = F.flatten(F.transform(F.coalesce("sib", F.slice(F.col("sib"), 1, 0), F.expr("cast(array() as array<struct<number:bigint,block_ids:array<string>>>)")), lambda s: s["block_ids"]))
    all_ = F.array_distinct(F.concat(F.array_compact(F.array("context_id")), "block_ids", flat))
    return rows.select("plan_id", "rank", "object_id", "representation_id", "score", all_.alias("block_ids"))


def slot_fill(packed: DataFrame, plans: DataFrame) -> DataFrame:
    """Item i goes to slot i, what is left over to the last slot; in a plan without slots it has none."""
    rows = packed.join(plans.select("plan_id", "slots"), "plan_id")
    slot = F.when(F.size("slots") > 0, F.element_at("slots", F.greatest(F.least(F.col("rank"), F.size("slots")), F.lit(1)).cast("int")))
    return rows.select("plan_id", "rank", "object_id", slot["slot_id"].alias("slot_id"), slot["role"].alias("role"))


def unfilled(plans: DataFrame, decisions: DataFrame, filled: DataFrame) -> DataFrame:
    """Required slots of answered plans that no item fills."""
    s = plans.join(decisions.filter("answerable").select("plan_id"), "plan_id", "left_semi").select("plan_id", F.explode("slots").alias("s"))
    s = s.filter("s.required").select("plan_id", "s.slot_id", "s.role")
    return s.join(filled.select("plan_id", "slot_id").distinct(), ["plan_id", "slot_id"], "left_anti")


def gaps(plans: DataFrame, decisions: DataFrame, packed: DataFrame, filled: DataFrame, windows: DataFrame) -> DataFrame:
    """plan_id, reason of all that an answered plan lacks: items whose window the corpus does not have, and required slots."""
    lost = packed.join(windows.select("representation_id"), "representation_id", "left_anti")
    lost = lost.select("plan_id", F.concat(F.lit("not in the corpus: "), "object_id").alias("reason"))
    return lost.unionByName(unfilled(plans, decisions, filled).select("plan_id", F.concat(F.lit("no evidence for "), "role").alias("reason")))


def pack_status(plans: DataFrame, decisions: DataFrame, packed: DataFrame, gaps: DataFrame) -> DataFrame:
    """Abstain, or sufficient if there is evidence and no gap, else insufficient."""
    n = packed.groupBy("plan_id").agg(F.count(F.lit(1)).alias("items"))
    g = gaps.groupBy("plan_id").agg(F.count(F.lit(1)).alias("gaps"))
    d = decisions.join(n, "plan_id", "left").join(g, "plan_id", "left").na.fill(0, ["items", "gaps"])
    status = F.when(~F.col("answerable"), "abstain").when((F.col("items") > 0) & (F.col("gaps") == 0), "sufficient").otherwise("insufficient")
    return d.select("plan_id", status.alias("status"), "items", "gaps", "reasons")


def pack_spans(packs: DataFrame, blocks: DataFrame) -> DataFrame:
    """The page of a pack item is that of its first block that exists, else 1."""
    ids = packs.select("plan_id", "rank", "object_id", F.posexplode_outer("block_ids").alias("at", "block_id"))
    found = ids.join(blocks.select("block_id", "page"), "block_id", "left")
    page = F.coalesce(F.min_by("page", F.when(F.col("page").isNotNull(), F.col("at"))), F.lit(1))
    return found.groupBy("plan_id", "rank", "object_id").agg(page.cast("long").alias("page"))


def pack_texts(packs: DataFrame, blocks: DataFrame) -> DataFrame:
    """The readable lines of a pack item's blocks, in its order."""
    line = C.readable(F.col("text"), F.col("latex"))
    ids = packs.select("plan_id", "rank", "object_id", F.posexplode("block_ids").alias("at", "block_id")).join(blocks.select("block_id", line.alias("line")), "block_id").filter("line <> ''")
    lines = F.array_sort(F.collect_list(F.struct("at", "line")))
    return ids.groupBy("plan_id", "rank", "object_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))


def offsets(texts: DataFrame) -> DataFrame:
    """The stretch of an item's text that its citation covers, which is all of it."""
    return texts.select("plan_id", "rank", "object_id", F.lit(0).cast("long").alias("char_start"), F.length("text").cast("long").alias("char_end"))


def candidate_trace(items: DataFrame, decisions: DataFrame, k: int = PACK) -> DataFrame:
    """Every candidate with its rank, whether it was admitted, and why not."""
    rows = items.join(decisions.select("plan_id", "answerable", "reasons"), "plan_id")
    why = F.when(~F.col("answerable"), F.concat(F.lit("pack abstained: "), "reasons")).when(F.col("rank") > k, F.concat(F.lit("ranked "), F.col("rank").cast("string"), F.lit(f", below the pack cut of {k}")))
    return rows.select("plan_id", "object_id", "rank", "score", (F.col("answerable") & (F.col("rank") <= k)).alias("admitted"), why.alias("rejection_reason"))


def corpus_checksum(sources: DataFrame, objects: DataFrame, windows: DataFrame) -> DataFrame:
    """One digest of ids and content hashes. Kinds are cut into shards by their hash, so that no task holds the whole corpus."""
    part = lambda df, kind, key, value: df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.concat(key, value).alias("x"))
    rows = part(sources, "1", "source_id", "checksum").unionByName(part(objects, "2", "object_id", "content_hash"))
    rows = rows.unionByName(part(windows, "3", "representation_id", "content_hash"))
    shard = F.substring(F.sha2("id", 256), 1, 2)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "id", "x"))), lambda r: r["x"]), "")
    shards = rows.groupBy(shard.alias("shard")).agg(F.sha2(text, 256).alias("d"), F.count(F.lit(1)).alias("n"))
    digest = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("shard", "d"))), lambda r: r["d"]), ""), 256)
    return shards.agg(digest.alias("checksum"), F.sum("n").alias("entries"))


def lineage_failures(packs: DataFrame, released_objects: DataFrame, released_sources: DataFrame, objects: DataFrame) -> DataFrame:
    """T4: packed objects that the manifest does not name, or whose source it does not name, or that do not exist."""
    rows = packs.select("plan_id", "object_id").distinct()
    rows = rows.join(released_objects.select("object_id", F.lit(True).alias("released")), "object_id", "left")
    rows = rows.join(objects.select("object_id", "source_id", F.lit(True).alias("known")), "object_id", "left")
    rows = rows.join(released_sources.select("source_id", F.lit(True).alias("source_released")), "source_id", "left")
    why = F.when(F.col("released").isNull(), "object not in manifest").when(F.col("known").isNull(), "object not in corpus").when(F.col("source_released").isNull(), "source not in manifest")
    return rows.select("plan_id", "object_id", why.alias("failure")).filter("failure is not null")
