"""The star-schema and text tables seen as a corpus: sources, blocks, objects, cases, plans.

Attributes that the tables lack are derived from ids by arithmetic, so that every rule has rows on either
side. All rows of the tables are used.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import windows as W
from . import vocabulary as V
from .stage import cut

TENANT, VERSION = "tenant-pilot", "pilot-0"
LICENSED = ["src16", "src17"]
OPENERS = ["the", "und", "la", "el"]


def pick(values: list[str], number: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (number % len(values) + 1).cast("int"))


def containing(docs: DataFrame, items: DataFrame, most: int = 5) -> DataFrame:
    """doc_id, item_id, query of items (item_id, query) that texts of docs (doc_id, text) contain.

    The words inside an item, its first and last aside, stand whole in a text that contains it. So the first ``most`` of them, hashed, are
    joined with the runs of as many words of the texts, and what meets is looked at. Items without inner words, if there are any, are looked for in every text.
    """
    cut_ = lambda c: F.split(c, r"\s+")
    key = lambda words, at, n: F.xxhash64(n, F.array_join(F.slice(words, at, n), " "))
    own = items.withColumn("words", cut_("query")).withColumn("n", F.least(F.size("words") - 2, F.lit(most)))
    long = own.filter("n > 0").select("item_id", "query", "n", key(F.col("words"), F.lit(2), F.col("n")).alias("key"))
    widths = sorted(r["n"] for r in long.select("n").distinct().collect())
    short = own.filter("n <= 0").select("item_id", "query")
    found = short.limit(0).select(F.lit(0).cast("long").alias("doc_id"), "item_id", "query")
    if widths:
        runs = lambda n: F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda k: key(F.col("words"), k, F.lit(n)))
        every = F.flatten(F.array(*(F.when(F.size("words") >= n, runs(n)).otherwise(F.array().cast("array<bigint>")) for n in widths)))
        probes = docs.filter(F.col("text").isNotNull()).withColumn("words", cut_("text")).select("doc_id", F.explode(F.array_distinct(every)).alias("key"))
        met = probes.join(long, "key").select("doc_id", "item_id", "query").distinct()
        found = met.join(docs, "doc_id").filter(F.expr("contains(text, query)")).select("doc_id", "item_id", "query")
    if not short.isEmpty():
        found = found.unionByName(docs.join(short, F.expr("contains(text, query)")).select("doc_id", "item_id", "query"))
    return found


class Corpus:
    """Lazy DataFrames over one directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def sources(self) -> DataFrame:
        n = F.substring("source", 4, 9).cast("int")
        state = F.when(n < 16, "approved").when(n < 18, "quarantined").when(n == 18, "retired").otherwise("withdrawn")
        return cut(
            self.table("documents").select("source").distinct().withColumn("n", n)
            .select(
                F.col("source").alias("source_id"), state.alias("approval_state"), (F.col("n") % 5 != 3).alias("has_rights"), (F.col("n") % 7 != 6).alias("scanned"),
                F.sha2("source", 256).alias("checksum"), F.concat(F.lit("ed"), F.col("n") % 3).alias("edition"), "n",
            )
        )

    @cached_property
    def blocks(self) -> DataFrame:
        pos = self.table("documents").filter(F.col("text").isNotNull()).select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        n, p = F.length("line"), F.col("pos").cast("long")
        kind = F.when(p == 0, "heading").when(p % 11 == 10, "page_footer").when(n < 40, "caption").when(p % 7 == 5, "formula").when(p % 9 == 8, "table").otherwise("paragraph")
        coded = (kind == "formula") & (p % 2 == 0)
        link = F.when(kind == "caption", F.when(p % 10 < 5, p - 1).otherwise(p + 1))
        name = lambda q: F.concat_ws(":", F.col("doc_id").cast("string"), q.cast("string"))
        start = F.sum(n + 1).over(Window.partitionBy("doc_id").orderBy("pos")) - n - 1
        return pos.select(
            "doc_id", F.concat(F.lit("o"), F.col("doc_id")).alias("object_id"), name(p).alias("block_id"), F.col("source").alias("source_id"), p.alias("pos"),
            (F.floor(p / 8) + 1).alias("page"), kind.alias("block_type"), F.when(coded, "").otherwise(F.col("line")).alias("text"),
            F.when(coded, F.col("line")).alias("latex"), F.when(link.isNotNull(), name(link)).alias("linked_id"), start.alias("char_start"), n.cast("long").alias("n_chars"),
        )

    @cached_property
    def objects(self) -> DataFrame:
        quality = self.table("labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
        d = self.table("documents").join(quality, "doc_id", "left")
        i = F.col("doc_id")
        kind = pick(["definition", "explanation", "example", "exercise", "solution", "concept"], i)
        open_ = pick(["public", "public", "hint_gated", "worked_step"], i)
        text = F.coalesce("text", F.lit(""))
        return d.select(
            "doc_id", F.concat(F.lit("o"), i).alias("object_id"), F.col("source").alias("source_id"), kind.alias("object_type"),
            F.when(kind == "solution", "solution").otherwise(open_).alias("disclosure"), F.when(i % 5 == 0, "7").otherwise("10").alias("grade"), F.col("lang").alias("subject"),
            F.when(i % 13 == 0, "tenant-other").when(i % 17 == 0, TENANT).alias("tenant_scope"), F.when(F.col("quality") == 0, "quarantined").otherwise("approved").alias("approval_state"),
            (i % 29 == 0).alias("retired"), F.lit("pilot").alias("board"), F.lit(VERSION).alias("version"),
            F.substring(F.trim(F.element_at(F.split(text, "\n"), 1)), 1, 80).alias("heading_path"), text.alias("text"), F.sha2(text, 256).alias("content_hash"),
        )

    @cached_property
    def gold(self) -> DataFrame:
        """case_id, block_id, subject of the blocks that a benchmark passage covers in a document, at its first place there."""
        items = self.table("benchmark").filter(F.length("text") > 0).select("item_id", F.col("text").alias("query"))
        docs = self.table("documents").select("doc_id", "text", "lang")
        met = containing(docs.select("doc_id", "text"), items)
        at = docs.join(met, "doc_id").select("item_id", "doc_id", "lang", (F.expr("instr(text, query)") - 1).alias("start"), F.length("query").alias("n"))
        b = self.blocks.select("doc_id", "block_id", "char_start", "n_chars")
        inside = (F.col("char_start") < F.col("start") + F.col("n")) & (F.col("char_start") + F.col("n_chars") > F.col("start"))
        return cut(at.join(b, "doc_id").filter(inside).select(F.concat(F.lit("c"), "item_id").alias("case_id"), "block_id", "lang", F.when(F.col("doc_id") % 5 == 0, "7").otherwise("10").alias("grade")))

    @cached_property
    def cases(self) -> DataFrame:
        gold = self.gold.groupBy("case_id").agg(F.min("lang").alias("lang"), F.min("grade").alias("gold_grade"), F.count_distinct("block_id").alias("n_gold"))
        i = F.col("item_id")
        d = self.table("benchmark").withColumn("case_id", F.concat(F.lit("c"), i)).join(gold, "case_id", "left")
        return cut(d.select(
            "case_id", "item_id", F.col("text").alias("query"), F.coalesce("gold_grade", F.when(i % 3 == 0, "7").otherwise("10")).alias("grade"), F.coalesce("lang", F.lit("en")).alias("subject"),
            F.coalesce("lang", F.lit("en")).alias("language"), pick(["factual", "procedural", "conceptual"], i).alias("question_type"), pick(list(V.ROLES), i).alias("teaching_action"),
            pick(["cold_start", "progressing"], i).alias("learner_state"), pick(list(V.CEILING), i).alias("assessment_state"), pick(["text", "equation", "table", "diagram"], i).alias("modality"),
            F.coalesce(F.col("n_gold") > 0, F.lit(False)).alias("answerable"), (i % 4 == 3).alias("holdout"), (i % 3).alias("n_adjudicators"),
        ))

    @cached_property
    def plans(self) -> DataFrame:
        c = self.cases
        ceiling = V.lookup(V.CEILING, F.col("assessment_state"))
        scoped = C.scoped_query(F.col("query"), F.col("grade"), F.col("subject"))
        return c.select(
            F.concat(F.lit("plan-"), "case_id").alias("plan_id"), "case_id", "item_id", "query", scoped.alias("scoped"), "grade", "subject", "teaching_action", "assessment_state",
            F.lit(TENANT).alias("tenant"), F.lit("pilot").alias("board"), F.lit(VERSION).alias("version"), ceiling.alias("ceiling"), V.rank(ceiling).alias("ceiling_rank"),
        )

    @cached_property
    def windows(self) -> DataFrame:
        return cut(W.represent(self.blocks, self.objects.select("object_id", "heading_path"), OPENERS))

    @cached_property
    def vectors(self) -> DataFrame:
        """representation_id, object_id, vector; windows beyond the table's vectors have none."""
        v = self.table("embeddings").select(F.col("vec_id"), F.col("embedding").alias("vector"))
        w = self.windows.select("representation_id", "object_id", (F.substring("object_id", 2, 20).cast("long") + F.col("number") - 1).alias("vec_id"))
        return w.join(v, "vec_id", "left").select("representation_id", "object_id", "vector")

    @cached_property
    def plan_vectors(self) -> DataFrame:
        v = self.table("embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("query_vector"))
        return self.plans.join(v, "item_id").select("plan_id", "query_vector")
