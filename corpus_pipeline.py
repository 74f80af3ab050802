"""A training corpus from raw documents: five stages, each calling one operator of evidara.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.llm import decontaminate, jaccard, langid, linededup, packing, scratch


#: Languages to keep; None keeps all that the labels teach.
LANGUAGES: frozenset[str] | None = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose language cannot be told, as they are null or hold no letter, and those in no wanted language.

    A document without ``lang`` gets the predicted one. Where no row has a label nothing is learned, and every text with a letter
    stays as it is. Rows without doc_id go; rows that repeat a doc_id are one document, of which the row with the smallest values,
    text first, stays; further columns are carried along. An empty table stays empty.
    """
    docs = _single(docs)
    model = langid.train(docs)
    if not model.langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    lang = _free("lang", docs)
    known = langid.identify(docs, model).filter(F.col("lang_pred") != langid.UNDETERMINED)
    if LANGUAGES is not None:
        known = known.filter(F.col("lang_pred").isin(sorted(LANGUAGES)))
    told = docs.join(known.select("doc_id", F.col("lang_pred").alias(lang)), "doc_id")
    return told.withColumn("lang", F.coalesce("lang", lang)).select(docs.columns)


def _free(name: str, docs: DataFrame) -> str:
    """A column name that docs does not have."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def _single(docs: DataFrame) -> DataFrame:
    """One row a doc_id: the one with the smallest values, text first."""
    row, rest = _free("row", docs), [c for c in docs.columns if c != "doc_id"]
    first = sorted(rest, key=lambda c: c != "text")
    one = docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.struct(*first)).alias(row))
    return one.select("doc_id", *(F.col(row)[c].alias(c) for c in rest)).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents hold stay in the last of them; n_chars follows the text, and a null text becomes an empty one.

    Rows without doc_id go, rows that repeat one are one document as in the first stage; further columns are carried along.
    """
    docs, name = _single(docs), _free("kept", docs)
    kept = linededup.clean(docs, linededup.LineIndex.build(docs)).select("doc_id", F.col("kept").alias(name))
    rest = docs.drop("text", "n_chars").join(kept, "doc_id")
    return rest.withColumn("text", F.col(name)).withColumn("n_chars", F.length(name).cast("long")).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group that the Jaccard join links, the one with the smallest id; documents without words link with none.

    Rows without doc_id go; rows that repeat the id of a document that stays all stay.
    """
    first = jaccard.join(docs).filter(F.col("component_id") == F.col("doc_id"))
    return docs.join(first.select("doc_id").distinct(), "doc_id", "left_semi").select(docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that hold a passage of the benchmark; null and empty texts, and rows without doc_id, stay."""
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of tokens; a null or empty text is its end id alone, rows without doc_id are left out."""
    return packing.pack(docs, added=True)


STAGES = [("language_id", language), ("line_dedup", lines), ("ngram_jaccard_join", near_copies), ("decontamination", benchmark), ("best_fit_packing", sequences)]

#: The first stage is a trained classifier and the last a packing heuristic over tokens, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written and read again, and its scratch tables are removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = scratch.mark()
        docs = scratch.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        scratch.release(before | {scratch.last()})
    return STAGES[-1][1](spark, docs, sf_dir)
