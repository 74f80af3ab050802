"""Stores, caches, reviews and drift."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scan_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines under a fixed schema; a malformed line is an error, blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def scan_json_document(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON value a file; keys that begin with an underscore are notes and are dropped."""
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def write_csv(df: DataFrame, path: str) -> None:
    """A sheet with a header line."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_sheets(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Marked sheets with the name of the file that each row is from."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path).withColumn("sheet", F.input_file_name())


def save(df: DataFrame, path: str) -> None:
    """Write beside the target and swap, so that readers see the old table or the new one."""
    spark = df.sparkSession
    staged = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.parquet(staged)
    jvm = spark.sparkContext._jvm
    fs_path = jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = fs_path(f"{staged}.old")
    if fs.exists(fs_path(path)):
        fs.rename(fs_path(path), old)
    fs.rename(fs_path(staged), fs_path(path))
    fs.delete(old, True)


def create_tables(spark: SparkSession, schemas: dict[str, str]) -> None:
    """Tables that are missing."""
    for name, schema in schemas.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet")


def approval_problem(approval: Column, rights: Column, declared: Column, actual: Column, scanned: Column) -> Column:
    """S3: why a source may not load: its state, or an approval without rights, matching checksum or scan."""
    return (
        F.when(~approval.isin("quarantined", "approved"), "state may not load")
        .when((approval == "approved") & ~rights, "approved without rights")
        .when((approval == "approved") & (declared != actual), "rights are for another file")
        .when((approval == "approved") & ~scanned, "approved without scan")
    )


def upsert(target: DataFrame, source: DataFrame, key: list[str], update: list[str]) -> DataFrame:
    """Target after source: new keys come in whole, known ones take only the columns ``update``."""
    cols = [c for c in target.columns if c not in key]
    t, s = target.select(*key, F.struct(*cols).alias("t")), source.select(*key, F.struct(*cols).alias("s"))
    pick = lambda c: F.when(F.col("t").isNull(), F.col(f"s.{c}")).when(F.col("s").isNull(), F.col(f"t.{c}")).otherwise(F.col(f"s.{c}" if c in update else f"t.{c}"))
    return t.join(s, key, "full_outer").select(*key, *(pick(c).alias(c) for c in cols))


#: What a table takes from new rows of known keys; the links of objects and windows take nothing.
UPDATED = {
    "sources": ["approval_state", "has_rights", "scanned"],
    "objects": ["approval_state", "retired"],
    "windows": ["vector", "model", "model_version"],
    "links": [],
}


def licence_problems(sources: DataFrame, licence: list[str] | None) -> DataFrame:
    """source_id, problem of the sources that may not be loaded together under this licence, or without one.

    A licence must name every source that is loaded, and a quarantined source needs one.
    """
    if licence is None:
        problem = F.when(F.col("approval_state") == "quarantined", F.lit("quarantined without a licence"))
    else:
        problem = F.when(~F.col("source_id").isin(licence), F.lit("not named by the licence"))
    return sources.select("source_id", problem.alias("problem")).filter("problem IS NOT NULL")


def union_last(parts: list[DataFrame], key: str) -> DataFrame:
    """The rows of all parts, of each key that of the last part that has it; a key is once in a part."""
    cols = parts[0].columns
    rows = reduce(DataFrame.unionByName, (p.select(*cols).withColumn("_part", F.lit(n)) for n, p in enumerate(parts)))
    last = rows.groupBy(key).agg(F.max_by(F.struct(*cols), "_part").alias("row"))
    return last.select("row.*")


def load_corpus(artefacts: list[dict[str, DataFrame]], licence: list[str] | None = None) -> dict[str, DataFrame]:
    """One corpus of artefacts (sources, objects, blocks each), or an error that names a source that may not be in it."""
    out = {t: union_last([a[t] for a in artefacts], key) for t, key in (("sources", "source_id"), ("objects", "object_id"), ("blocks", "block_id"))}
    bad = licence_problems(out["sources"], licence).orderBy("source_id").first()
    if bad is not None:
        raise PermissionError(f"{bad['source_id']}: {bad['problem']}")
    return out


def attach_vectors(windows: DataFrame, made: DataFrame) -> DataFrame:
    """Windows with the vector of their text, if one was made; made: text_hash (SHA-256, each once), vector, model."""
    return windows.withColumn("text_hash", F.sha2("search_text", 256)).join(made.select("text_hash", "vector", "model"), "text_hash", "left").drop("text_hash")


def nested_region(rows: DataFrame) -> DataFrame:
    """Flat rows (page, x, y, width, height) with their region as one column; the rest stays as it is."""
    flat = ("page", "x", "y", "width", "height")
    return rows.withColumn("region", F.struct(*flat)).drop(*flat)


def ordered_ids(links: DataFrame, owner: str) -> DataFrame:
    """The block ids of each owner in their order."""
    return links.groupBy(owner).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "block_id"))), lambda x: x["block_id"]).alias("block_ids"))


def cache_key(model: str, kind: str, text: Column) -> Column:
    """Key of an embedding in the cache."""
    return F.concat_ws(":", F.lit(model), F.lit(kind), F.sha2(text, 256))


def rerank_key(model: str, query: Column, documents: Column) -> Column:
    """Key of a rerank call: the model, and a digest of the query and all documents."""
    return F.concat_ws(":", F.lit(model), F.sha2(F.concat(query, F.array_join(F.transform(documents, lambda d: F.concat(F.lit("\u0000"), d)), "")), 256))


def cache_misses(texts: DataFrame, cache: DataFrame, model: str, kind: str) -> DataFrame:
    """Keys that the cache does not hold, each once."""
    return texts.select(cache_key(model, kind, F.col("text")).alias("cache_key")).distinct().join(cache.select("cache_key"), "cache_key", "left_anti")


def cached_vectors(texts: DataFrame, cache: DataFrame, model: str, kind: str, read_only: bool = True) -> DataFrame:
    """Texts with their cached vector; a text that a read-only cache lacks is an error, in another its vector is null."""
    if read_only:
        miss = cache_misses(texts, cache, model, kind).first()
        if miss is not None:
            raise LookupError(f"not in the read-only cache: {miss['cache_key']}")
    return texts.withColumn("cache_key", cache_key(model, kind, F.col("text"))).join(cache.select("cache_key", "vector"), "cache_key", "left")


def sheet_problems(marked: DataFrame, cases: DataFrame) -> DataFrame:
    """Sheet, case_id, problem of marked sheets (sheet, case_id, reviewer, verdict, note).

    A sheet is one person's judgement: one that names nobody or several is refused whole (case_id null). Of the others, rows without
    case or verdict are passed over, unknown cases and disagreement without a note are problems.
    """
    clean = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    rows = marked.select("sheet", *(clean(c).alias(c) for c in ("case_id", "reviewer", "verdict", "note")))
    names = rows.groupBy("sheet").agg(F.count_distinct(F.when(F.col("reviewer") != "", F.col("reviewer"))).alias("reviewers"))
    whole = names.filter("reviewers <> 1").select("sheet", F.lit(None).cast("string").alias("case_id"), F.lit("not exactly one reviewer").alias("problem"))
    known = cases.select(F.col("case_id").cast("string").alias("case_id")).distinct().withColumn("known", F.lit(True))
    kept = rows.filter("case_id <> '' AND verdict <> ''").join(names.filter("reviewers = 1").select("sheet"), "sheet", "left_semi").join(known, "case_id", "left")
    problem = F.when(F.col("known").isNull(), "unknown case").when((F.lower("verdict") == "disagree") & (F.col("note") == ""), "disagreement without a note")
    return whole.unionByName(kept.select("sheet", "case_id", problem.alias("problem")).filter("problem IS NOT NULL"))


def correction_status(corrections: DataFrame, blocks: DataFrame) -> DataFrame:
    """Whether a reviewed correction (block_id, was, now) applies, is applied already, or meets another text."""
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    rows = corrections.join(blocks.select("block_id", "text"), "block_id", "left")
    t = flat(F.col("text"))
    status = F.when(F.col("text").isNull(), "unknown block").when(F.coalesce("now", F.lit("")) == "", "incomplete").when(t == flat(F.col("now")), "already applied").when(t == flat(F.col("was")), "applies").otherwise("text differs")
    return rows.select("block_id", status.alias("status"))


def formula_status(reviews: DataFrame, blocks: DataFrame) -> DataFrame:
    """Whether a reviewed formula (block_id, latex, reader, checker) may be attached."""
    rows = reviews.withColumnRenamed("latex", "new").join(blocks.select("block_id", "block_type", "latex"), "block_id", "left")
    status = (
        F.when(F.col("block_type").isNull(), "unknown block")
        .when(F.col("reader") == F.col("checker"), "one person read and checked")
        .when(F.col("block_type") != "formula", "not a formula")
        .when(F.coalesce("latex", F.lit("")).isin("") | (F.col("latex") == F.col("new")), "applies")
        .otherwise("another formula is there")
    )
    return rows.select("block_id", status.alias("status"))


def adjudication(reviews: DataFrame, cases: DataFrame) -> DataFrame:
    """Per case who agreed and whether it is settled, disputed or unsure; two agreeing reviewers settle it.

    reviews: case_id, reviewer, verdict (agree, disagree, unsure), note.
    """
    n = reviews.groupBy("case_id").agg(
        F.count_distinct(F.when(F.col("verdict") == "agree", F.col("reviewer"))).alias("agreed"), F.bool_or(F.col("verdict") == "disagree").alias("disputed"),
        F.bool_or(F.col("verdict") == "unsure").alias("unsure"), F.bool_or((F.col("verdict") == "disagree") & (F.coalesce("note", F.lit("")) == "")).alias("note_missing"),
    )
    rows = n.join(cases.select("case_id", F.lit(True).alias("known")), "case_id", "left")
    state = F.when(F.col("known").isNull(), "unknown case").when(F.col("disputed"), "disputed").when(F.col("agreed") >= 2, "adjudicated").when(F.col("unsure"), "unsure").otherwise("open")
    return rows.select("case_id", "agreed", state.alias("state"), "note_missing")


def broken_gold(gold: DataFrame, blocks: DataFrame) -> DataFrame:
    """Gold blocks that are no blocks."""
    return gold.join(blocks.select("block_id"), "block_id", "left_anti")


def orphan_gold(gold: DataFrame, blocks: DataFrame, cited: DataFrame) -> DataFrame:
    """Gold blocks that exist but that no object or window cites."""
    return gold.join(blocks.select("block_id"), "block_id", "left_semi").join(cited.select("block_id"), "block_id", "left_anti")


def drift(before: DataFrame, after: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Keys that went, came, or changed, null being equal to null."""
    a, b = (d.select(key, F.struct(*values).alias(n)) for d, n in ((before, "a"), (after, "b")))
    what = F.when(F.col("b").isNull(), "gone").when(F.col("a").isNull(), "new").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return a.join(b, key, "full_outer").select(key, what.alias("what")).filter("what is not null")


def triage(formulas: DataFrame) -> DataFrame:
    """Formula blocks (block_id, attached, readable) by what has to be done about them."""
    state = F.when(F.col("attached"), "attached").when(F.col("readable"), "readable").otherwise("needs human")
    return formulas.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def screen_summary(cases: DataFrame, screens: DataFrame) -> DataFrame:
    """Counts of verdicts; cases without one are errors."""
    rows = cases.select("case_id").join(screens.select("case_id", "verdict"), "case_id", "left")
    return rows.groupBy(F.coalesce("verdict", F.lit("error")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


