"""Which recovered formula belongs to which damaged block."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import columns as C
from .retrieve import top

CONFIDENCE, MARGIN, NEAR = 0.90, 0.20, 8


@F.pandas_udf(DoubleType())
def order_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """M4: Ratcliff-Obershelp ratio; no built-in expression has it."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def order_similarity(pairs: DataFrame) -> DataFrame:
    """pairs (block_id, degraded, candidate) with ``order``: how far the symbols come in the same sequence."""
    return pairs.withColumn("order", F.round(order_ratio(C.symbol_text(F.col("degraded")), C.symbol_text(F.col("candidate"))), 6))


def best_match(pairs: DataFrame) -> DataFrame:
    """M5: for each block the candidate piece that says it in the best order, ties to the shorter.

    The margin is taken to the best piece that is neither contained in the chosen one nor contains it.
    """
    pieces = pairs.select("block_id", "degraded", F.explode(C.formula_segments(F.col("candidate"))).alias("candidate")).distinct()
    scored = order_similarity(pieces).withColumn("score", F.col("order"))
    ranked = top(scored, ["block_id"], None, F.desc("order"), F.length("candidate"), F.asc("candidate"))
    best = ranked.filter("rank = 1").select("block_id", "degraded", F.col("candidate").alias("latex"), "order")
    syms = lambda c: C.symbols(F.col(c))
    holds = lambda a, b: F.forall(F.array_distinct(b), lambda x: F.size(F.filter(b, lambda y: y == x)) <= F.size(F.filter(a, lambda y: y == x)))
    rest = ranked.filter("rank > 1").select("block_id", "candidate", F.col("order").alias("rival")).join(best.select("block_id", "latex"), "block_id")
    rivals = rest.filter(~holds(syms("candidate"), syms("latex")) & ~holds(syms("latex"), syms("candidate"))).groupBy("block_id").agg(F.max("rival").alias("rival"))
    out = best.join(rivals, "block_id", "left").withColumn("margin", F.round(F.col("order") - F.coalesce("rival", F.lit(0.0)), 6))
    out = out.withColumn("confidence", F.round(C.multiset_similarity(F.col("degraded"), F.col("latex")), 6))
    return out.select("block_id", "latex", "order", "confidence", "margin", ((F.col("confidence") >= CONFIDENCE) & (F.col("margin") >= MARGIN)).alias("confident"))


def attach(blocks: DataFrame, matches: DataFrame) -> DataFrame:
    """M6: only confident matches become a block's formula; the rest wait for review."""
    rows = blocks.join(matches.select("block_id", "latex", "confident"), "block_id", "left")
    state = F.when(F.col("confident"), "attached").when(F.col("latex").isNotNull(), "review").otherwise("no candidate")
    return rows.select("block_id", F.when(F.col("confident"), F.col("latex")).alias("latex"), state.alias("state"))


def near_page_candidates(blocks: DataFrame, candidates: DataFrame, most: int = NEAR) -> DataFrame:
    """M7: the most similar candidates of a block's page and the pages beside it; equal texts count once.

    The range is turned into three equal keys, so the join is an equi-join. blocks: document_id, block_id, page, degraded;
    candidates: document_id, page, candidate.
    """
    spread = blocks.select("document_id", "block_id", "degraded", F.explode(F.array(F.col("page") - 1, "page", F.col("page") + 1)).alias("page"))
    met = spread.join(candidates, ["document_id", "page"]).select("block_id", "degraded", "candidate").distinct()
    scored = met.withColumn("similarity", F.round(C.multiset_similarity(F.col("degraded"), F.col("candidate")), 6))
    ranked = top(scored, ["block_id"], most, F.desc("similarity"), F.length("candidate"), F.asc("candidate"))
    return ranked.select("block_id", "rank", "candidate", "similarity")


