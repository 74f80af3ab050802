"""Scores of retrieval, refusal and citation against gold cases."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import vocabulary as V

AXES = ["grade", "subject", "language", "question_type", "teaching_action", "learner_state", "assessment_state", "modality", "answerable"]
#: A slice gates from so many cases on; floors of recall at the candidates and at the pack; what counts as materially worse.
GATING, CANDIDATE_FLOOR, PACK_FLOOR, MARGIN = 20, 0.95, 0.90, 0.15
PACK = 5


def violations(items: DataFrame, plans: DataFrame, objects: DataFrame, sources: DataFrame, allowed: DataFrame, licensed: DataFrame) -> DataFrame:
    """A2: per plan how many returned items break each of five rules; objects that do not exist count as unauthorised alone."""
    o = objects.select("object_id", "source_id", V.rank(F.col("disclosure")).alias("disclosure_rank"), "tenant_scope", "approval_state", "retired", F.lit(True).alias("known"))
    s = sources.select("source_id", F.col("approval_state").alias("source_state"))
    rows = items.select("plan_id", "object_id").join(plans.select("plan_id", "ceiling_rank", "tenant"), "plan_id").join(o, "object_id", "left").join(s, "source_id", "left")
    rows = rows.join(allowed.withColumn("ok", F.lit(True)), ["plan_id", "object_id"], "left").join(licensed.select("object_id", F.lit(True).alias("lent")), "object_id", "left")
    known = F.col("known").isNotNull()
    unapproved = known & F.col("lent").isNull() & ~((F.col("approval_state") == "approved") & F.coalesce(F.col("source_state") == "approved", F.lit(False)))
    n = lambda p, name: F.count_if(p).alias(name)
    return rows.groupBy("plan_id").agg(
        n(F.col("ok").isNull(), "unauthorised"), n(known & (F.col("disclosure_rank") > F.col("ceiling_rank")), "disclosure"),
        n(known & F.col("tenant_scope").isNotNull() & (F.col("tenant_scope") != F.col("tenant")), "cross_tenant"), n(unapproved, "unapproved"), n(known & F.col("retired"), "retired"),
    )


def case_results(cases: DataFrame, items: DataFrame, windows: DataFrame, gold: DataFrame, broken: DataFrame, threshold: float, k_pack: int = PACK) -> DataFrame:
    """A1: per case whether gold blocks are among the candidates' and the pack's, or whether it was rightly refused."""
    plan = F.concat(F.lit("plan-"), "case_id")
    blocks = items.join(windows.select("representation_id", "block_ids"), "representation_id").select("plan_id", "rank", F.explode("block_ids").alias("block_id"))
    g = gold.select(plan.alias("plan_id"), "block_id").distinct().withColumn("gold", F.lit(True))
    met = blocks.join(g, ["plan_id", "block_id"], "left")
    hit = met.groupBy("plan_id").agg(
        F.coalesce(F.bool_or("gold"), F.lit(False)).alias("hit_candidates"), F.coalesce(F.bool_or(F.when(F.col("rank") <= k_pack, F.col("gold"))), F.lit(False)).alias("hit_pack"),
        F.count_distinct(F.when(F.col("rank") <= k_pack, F.col("block_id"))).alias("blocks_at_pack"),
    )
    best = items.filter("rank = 1").select("plan_id", F.col("score").alias("top_score"))
    total = broken.select("plan_id", sum(F.col(c) for c in ("unauthorised", "disclosure", "cross_tenant", "unapproved", "retired")).alias("violations"))
    rows = cases.withColumn("plan_id", plan).join(hit, "plan_id", "left").join(best, "plan_id", "left").join(total, "plan_id", "left")
    known = F.coalesce("top_score", F.lit(0.0))
    no = F.lit(False)
    return rows.select(
        "case_id", *AXES, "holdout", (F.col("answerable") & F.coalesce("hit_candidates", no)).alias("hit_candidates"), (F.col("answerable") & F.coalesce("hit_pack", no)).alias("hit_pack"),
        F.when(~F.col("answerable"), F.col("top_score").isNull() | (known < threshold)).alias("abstained"), known.alias("top_score"),
        F.coalesce("blocks_at_pack", F.lit(0)).cast("long").alias("blocks_at_pack"), F.coalesce("violations", F.lit(0)).cast("long").alias("violations"),
    )


def _rates() -> list[Column]:
    rate = lambda p, of: F.round(F.avg(F.when(of, p.cast("int"))), 6)
    a = F.col("answerable")
    return [
        F.count(F.lit(1)).alias("n"), F.count_if(a).alias("n_answerable"), rate(F.col("hit_candidates"), a).alias("recall_candidates"), rate(F.col("hit_pack"), a).alias("recall_pack"),
        rate(F.col("abstained"), ~a).alias("abstention"), F.sum("violations").alias("violations"),
    ]


def score_report(results: DataFrame) -> DataFrame:
    """A3: totals; a rate without cases is null."""
    return results.agg(*_rates(), F.round(F.avg(F.when(F.col("answerable"), F.col("blocks_at_pack"))), 6).alias("blocks_per_pack"))


def slice_scores(results: DataFrame) -> DataFrame:
    """A4: the same per value of each axis and of each pair of axes; cases are spread once, so one shuffle does."""
    text = lambda a: F.col(a).cast("string")
    own = lambda a: F.concat(F.lit(f"{a}="), text(a))
    key = lambda name, *axes: F.struct(name.alias("slice"), F.array(*map(own, axes)).alias("axes"))
    keys = [key(own(a), a) for a in AXES]
    keys += [key(F.concat(F.lit(f"{a}×{b}="), text(a), F.lit("×"), text(b)), a, b) for a, b in combinations(sorted(AXES), 2)]
    return results.select("*", F.explode(F.array(*keys)).alias("key")).select("*", "key.*").groupBy("slice", "axes").agg(*_rates())


def failing_slices(slices: DataFrame, least: int = GATING) -> DataFrame:
    """A5: slices with enough cases that are below a floor or have violations, with the first failure that holds."""
    why = F.when(F.col("recall_candidates") < CANDIDATE_FLOOR, "candidates").when(F.col("recall_pack") < PACK_FLOOR, "pack").when(F.col("violations") > 0, "violations")
    return slices.filter(F.col("n") >= least).select("slice", "axes", why.alias("failure")).filter("failure is not null")


def distinctive_failures(failing: DataFrame) -> DataFrame:
    """Failing axes, and failing pairs of which neither axis fails alone. Slices without ``axes`` are read from their names."""
    if "axes" not in failing.columns:
        names, values = F.split(F.split("slice", "=")[0], "×"), F.split(F.regexp_extract("slice", "^[^=]*=(.*)$", 1), "×")
        failing = failing.withColumn("axes", F.zip_with(names, values, lambda n, v: F.concat(n, F.lit("="), v)))
    single = failing.filter(F.size("axes") == 1)
    pair = failing.filter(F.size("axes") == 2).withColumn("one", F.get("axes", F.lit(0))).withColumn("two", F.get("axes", F.lit(1)))
    axes = single.select(F.col("slice").alias("axis"))
    alone = pair.join(axes, F.col("one") == F.col("axis"), "left_anti").join(axes, F.col("two") == F.col("axis"), "left_anti")
    return single.select("slice", "failure").unionByName(alone.select("slice", "failure"))


def worse(reports: DataFrame, baseline: str, margin: float = MARGIN) -> DataFrame:
    """Retrievers that break more rules than the baseline, or lose ``margin`` of its pack recall."""
    b = reports.filter(F.col("retriever") == baseline).select(F.col("recall_pack").alias("base_recall"), F.col("violations").alias("base_violations"))
    loss = F.coalesce("recall_pack", F.lit(0.0)) <= F.round(F.coalesce("base_recall", F.lit(0.0)) - margin, 6)
    return reports.crossJoin(F.broadcast(b)).select("retriever", "recall_pack", "violations", ((F.col("violations") > F.col("base_violations")) | loss).alias("worse"))


def calibrate(results: DataFrame, budget: float | None = None) -> DataFrame:
    """The threshold half-way between the worst answerable and the best unanswerable score, or the highest that
    refuses at most ``budget`` of the answerable cases; with what it refuses of either kind."""
    a = F.col("answerable")
    ends = results.agg(F.min(F.when(a, F.col("top_score"))).alias("floor"), F.max(F.when(~a, F.col("top_score"))).alias("ceiling"), F.array_sort(F.collect_list(F.when(a, F.col("top_score")))).alias("tops"))
    n = F.size("tops")
    cut = (F.col("floor") + F.col("ceiling")) / 2 if budget is None else F.element_at("tops", F.least(F.floor(budget * n).cast("int") + 1, n))
    t = ends.select(F.round(cut, 7).alias("threshold"), F.round(F.col("floor") - F.col("ceiling"), 6).alias("margin"), "floor", "ceiling")
    below = (F.col("top_score") < F.col("threshold")).cast("int")
    rows = results.select("answerable", "top_score").crossJoin(F.broadcast(t))
    return rows.groupBy("threshold", "margin", "floor", "ceiling").agg(
        F.round(F.avg(F.when(a, below)), 6).alias("false_abstain_rate"), F.round(F.avg(F.when(~a, below)), 6).alias("refused_rate")
    )


def spans_resolve(packs: DataFrame, spans: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per plan whether every cited block exists and each item's page is that of its first block."""
    ids = packs.select("plan_id", "rank", F.posexplode_outer("block_ids").alias("at", "block_id"))
    rows = ids.join(blocks.select("block_id", "page"), "block_id", "left").join(spans.select("plan_id", "rank", F.col("page").alias("span_page")), ["plan_id", "rank"])
    ok = F.col("page").isNotNull() & ((F.col("at") > 0) | (F.col("page") == F.col("span_page")))
    return rows.groupBy("plan_id").agg(F.bool_and(ok).alias("resolved"))


def citation_cases(cases: DataFrame, statuses: DataFrame, packs: DataFrame, resolved: DataFrame, gold: DataFrame) -> DataFrame:
    """A10: per case: answered, resolved, gold blocks, gold blocks cited, cited blocks."""
    plan = F.concat(F.lit("plan-"), "case_id")
    side = lambda df, block, gold, cited: df.select("plan_id", block.alias("block_id"), F.lit(gold).alias("gold"), F.lit(cited).alias("cited"))
    both = side(gold.withColumn("plan_id", plan), F.col("block_id"), True, False).unionByName(side(packs, F.explode("block_ids"), False, True))
    both = both.groupBy("plan_id", "block_id").agg(F.bool_or("gold").alias("gold"), F.bool_or("cited").alias("cited"))
    met = F.col("gold") & F.col("cited") & F.col("block_id").isNotNull()
    n = both.groupBy("plan_id").agg(F.count_if("gold").alias("gold_blocks"), F.count_if("cited").alias("cited"), F.count_if(met).alias("gold_cited"))
    rows = cases.select("case_id", plan.alias("plan_id"), "holdout").join(statuses.select("plan_id", "status", "items"), "plan_id")
    rows = rows.join(resolved, "plan_id", "left").join(n, "plan_id", "left")
    rows = rows.na.fill(0, ["gold_blocks", "cited", "gold_cited"])
    answered = (F.col("status") != "abstain") & (F.col("items") > 0)
    return rows.select("case_id", "holdout", answered.alias("answered"), F.coalesce("resolved", F.lit(True)).alias("resolved"), "gold_blocks", "gold_cited", F.col("cited").alias("cited_blocks"))


def citation_report(rows: DataFrame) -> DataFrame:
    """Resolution over all packs; delivered recall, completeness and precision as means over answered ones; and whether the gates hold."""
    a, g, c = F.col("answered"), F.col("gold_blocks"), F.col("cited_blocks")
    made = rows.agg(
        F.count(F.lit(1)).alias("packs"), F.count_if(a).alias("answered"), F.round(F.avg(F.col("resolved").cast("int")), 6).alias("resolution"),
        F.round(F.avg(F.when(a & (g > 0), (F.col("gold_cited") > 0).cast("int"))), 6).alias("delivered_recall"),
        F.round(F.avg(F.when(a & (g > 0), F.col("gold_cited") / F.nullif(g, F.lit(0)))), 6).alias("completeness"),
        F.round(F.avg(F.when(a & (c > 0), F.col("gold_cited") / F.nullif(c, F.lit(0)))), 6).alias("evidence_precision"),
    )
    return made.withColumn("gates_hold", (F.col("resolution") >= 1.0) & F.coalesce(F.col("completeness") >= 0.95, F.lit(True)))


def failing_gates(report: DataFrame, resolution: float = 1.0, completeness: float = 0.95) -> DataFrame:
    """Gate, value, floor of the gates that a citation report fails; a completeness that was not measured fails nothing."""
    gate = lambda name, floor: F.when(F.col(name) < floor, F.struct(F.lit(name).alias("gate"), F.col(name).alias("value"), F.lit(floor).alias("floor")))
    found = F.array_compact(F.array(gate("resolution", resolution), gate("completeness", completeness)))
    return report.select(F.explode(found).alias("g")).select("g.*")


def lower_bound(successes: Column, trials: Column, confidence: float = 0.95, steps: int = 50) -> Column:
    """One-sided exact (Clopper-Pearson) lower bound of a rate, by bisection on the binomial tail.

    A step of the bisection goes once over the tail, each logarithm made from the one before it.
    """
    alpha = 1 - confidence
    s, n = successes.cast("long"), trials.cast("long")
    choose = F.aggregate(F.sequence(F.lit(1).cast("long"), s), F.lit(0.0), lambda acc, i: acc + F.log((n - s + i) / i))
    zero = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        first = F.struct((choose + s * F.log(mid) + (n - s) * F.log(1 - mid)).alias("term"), F.lit(0.0).alias("sum"))
        odds = F.log(mid) - F.log(1 - mid)
        tail = lambda t, k: F.struct((t["term"] + F.log((n - k) / (k + 1)) + odds).alias("term"), (t["sum"] + F.exp(t["term"])).alias("sum"))
        high = F.aggregate(F.sequence(s, n), first, tail)["sum"] > alpha
        return F.struct(F.when(high, acc["lo"]).otherwise(mid).alias("lo"), F.when(high, mid).otherwise(acc["hi"]).alias("hi"))

    halved = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), zero, halve)["lo"]
    return F.when((n <= 0) | (s <= 0), 0.0).when(s >= n, F.pow(F.lit(alpha), 1 / F.when(n > 0, n))).otherwise(halved)


def holdout_report(rows: DataFrame) -> DataFrame:
    """What was answered and refused, visible and held out, with exact lower bounds. rows: holdout, answerable, answered."""
    a, y = F.col("answerable"), F.col("answered")
    n = rows.groupBy("holdout").agg(F.count_if(~a & ~y).alias("refused"), F.count_if(~a).alias("unanswerable"), F.count_if(a & y).alias("answered"), F.count_if(a).alias("answerable"))
    return n.select("*", F.round(lower_bound(F.col("refused"), F.col("unanswerable")), 6).alias("refused_bound"), F.round(lower_bound(F.col("answered"), F.col("answerable")), 6).alias("answered_bound"))
