"""Scoring and ranking. Every retriever takes plans and what they may see, and returns candidate rows.

Scores are rounded to PLACES before they rank, which is far below any threshold's step, so that equal texts tie whatever the order of sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.stage import cut
from .access import CURRICULUM, OF_OBJECT, OF_PLAN, may

K1, B, PLACES, K = 1.2, 0.75, 9, 20
#: Hybrid: constant of reciprocal rank fusion. Windows an object may fill, and how near to its best they must be.
FUSION, BUDGET_WINDOWS, BUDGET_GAP = 60, 3, 0.02
#: Rows of queries that are sent to every task.
FEW = 100_000


def top(rows: DataFrame, by: list[str], k: int | None, *order: Column) -> DataFrame:
    """Rank from 1 within ``by``, at most k."""
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    return out if k is None else out.filter(F.col("rank") <= k)


def by_score(*ties: str) -> list[Column]:
    return [F.desc("score"), *(F.asc(t) for t in ties)]


def idf(terms: DataFrame, key: str) -> DataFrame:
    """Term, idf = ln(1 + n / (1 + df)) over all keys of ``terms`` (key, term)."""
    n = terms.agg(F.count_distinct(key).alias("n"))
    df = terms.groupBy("term").agg(F.count_distinct(key).alias("df"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.log(1 + F.col("n") / (1 + F.col("df"))).alias("idf"))


def query_terms(plans: DataFrame, text: str) -> DataFrame:
    return plans.select("plan_id", F.explode(F.array_distinct(C.tokens(F.col(text)))).alias("term"))


def weighted(query: DataFrame, weights: DataFrame) -> DataFrame:
    """plan_id, term, w: a query's terms with their weights; a term that is nowhere weighs as much as any."""
    most = weights.agg(F.coalesce(F.max("w"), F.lit(1.0)).alias("most"))
    return query.join(weights, "term", "left").crossJoin(F.broadcast(most)).select("plan_id", "term", F.coalesce("w", "most").alias("w"))


def keyword_scores(plans: DataFrame, docs: DataFrame, key: str, text: Column, allowed: DataFrame) -> DataFrame:
    """Share of the raw query's idf mass that an allowed row holds; statistics over all rows."""
    terms = docs.select(key, F.explode(F.array_distinct(C.tokens(text))).alias("term"))
    q = weighted(query_terms(plans, "query"), idf(terms, key).select("term", F.col("idf").alias("w")))
    mass = q.groupBy("plan_id").agg(F.sum("w").alias("mass"))
    hit = terms.join(q, "term").join(allowed, ["plan_id", key]).groupBy("plan_id", key).agg(F.sum("w").alias("got"))
    return hit.join(mass, "plan_id").select("plan_id", key, F.round(F.col("got") / F.col("mass"), PLACES).alias("score"))


def frequencies(windows: DataFrame) -> DataFrame:
    """term, df over all windows. Texts are dealt by window once, so that no word travels with its window's id."""
    own = windows.select("representation_id", "search_text").repartition("representation_id")
    return own.select("representation_id", F.explode(F.array_distinct(C.tokens(F.col("search_text")))).alias("term")).distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def bm25_stats(windows: DataFrame, df: DataFrame | None = None) -> DataFrame:
    """Term, df, w over all windows; df: their ``frequencies``, if they are there already."""
    df = frequencies(windows) if df is None else df
    n = windows.agg(F.count(F.lit(1)).alias("n"))
    raw = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.greatest(F.lit(0.0), raw).alias("w"))


def facts(windows: DataFrame) -> Row:
    """Of all windows, in one pass: n, their number; worded, how many have a word; mean, their mean length in words."""
    size = F.size(C.tokens(F.col("search_text")))
    return windows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(size > 0, F.col("representation_id"))).alias("worded"), F.avg(size).alias("mean")).first()


def _terms(plans: DataFrame, text: str, weights: DataFrame) -> DataFrame:
    """plan_id, term, w, total: as ``weighted``, with the sum of a query's weights. Statistics come as numbers, not as joins, of which each takes its share of the driver."""
    most = weights.agg(F.coalesce(F.max("w"), F.lit(1.0))).first()[0]
    q = query_terms(plans.filter(F.col("plan_id").isNotNull()), text).join(weights, "term", "left").select("plan_id", "term", F.coalesce("w", F.lit(most)).alias("w"))
    return q.withColumn("total", F.sum("w").over(Window.partitionBy("plan_id")))


def bm25_terms(plans: DataFrame, windows: DataFrame, df: DataFrame | None = None, known: Row | None = None) -> DataFrame:
    """plan_id, term, w of the scoped queries, with the query's ceiling (total) and the mean length; statistics over all windows.

    df, known: their ``frequencies`` and ``facts``, if they are there already.
    """
    df, known = cut(frequencies(windows)) if df is None else df, facts(windows) if known is None else known
    raw = F.log(1 + (F.lit(known.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    q = _terms(plans, "scoped", df.select("term", F.greatest(F.lit(0.0), raw).alias("w")))
    return q.withColumns({"total": F.col("total") * (K1 + 1) / K1, "mean": F.lit(known.mean).cast("double")})


def keyword_terms(plans: DataFrame, windows: DataFrame, df: DataFrame | None = None, known: Row | None = None) -> DataFrame:
    """plan_id, term, w of the raw queries, with the query's idf mass (total); statistics over all windows that have a word, as R1 has them."""
    df, known = cut(frequencies(windows)) if df is None else df, facts(windows) if known is None else known
    return _terms(plans, "query", df.select("term", F.log(1 + F.lit(known.worded) / (1 + F.col("df"))).alias("w")))


def few(rows: DataFrame) -> DataFrame:
    """rows, sent to every task if they are at most FEW, which is counted first; else they are joined by a shuffle."""
    return F.broadcast(rows) if is_few(rows) else shuffled(rows)


def shuffled(rows: DataFrame) -> DataFrame:
    """rows, joined by a shuffle. Spark guesses rows' size from that of their files, where objects take a few bytes each, and would gather them in the driver."""
    return rows.hint("merge")


def is_few(rows: DataFrame) -> bool:
    return rows.limit(FEW + 1).count() <= FEW


def matched(plans: DataFrame, terms: DataFrame, windows: DataFrame, objects: DataFrame) -> DataFrame:
    """plan_id, representation_id, object_id, len, tf and what ``terms`` holds, of every term that a plan's query shares with a window it may see.

    objects: ``access.scoped``. A window meets only queries that may see it, and stays in the task of its object, where all of an object's
    scores are then summed and ranked without another shuffle.
    """
    own = windows.select("object_id", "representation_id", "search_text").join(objects, "object_id")
    own = own.withColumn("tokens", C.tokens(F.col("search_text")))
    words = own.select("object_id", "representation_id", *CURRICULUM, *OF_OBJECT, F.size("tokens").alias("len"), F.explode("tokens").alias("term"))
    # Written, so that they are joined once and not again to be counted and to be sent.
    q = cut(terms.join(plans.select("plan_id", *CURRICULUM, *OF_PLAN), "plan_id"))
    sent = F.broadcast if is_few(q) else lambda rows: rows
    asked = words.join(sent(q.select("term")), "term", "left_semi")
    tf = asked.groupBy("object_id", "representation_id", "len", *CURRICULUM, *OF_OBJECT, "term").agg(F.count(F.lit(1)).alias("tf"))
    return tf.join(sent(q), [*CURRICULUM, "term"]).filter(may())


def counted(windows: DataFrame, allowed: DataFrame) -> DataFrame:
    """plan_id, object_id, representation_id, len, term, tf: all words of given pairs (plan_id, representation_id), which should be few windows a plan."""
    own = windows.select("object_id", "representation_id", "search_text").join(allowed.select("plan_id", "representation_id"), "representation_id")
    own = own.withColumn("tokens", C.tokens(F.col("search_text")))
    words = own.select("plan_id", "object_id", "representation_id", F.size("tokens").alias("len"), F.explode("tokens").alias("term"))
    return words.groupBy("plan_id", "object_id", "representation_id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))


def matched_pairs(terms: DataFrame, windows: DataFrame, allowed: DataFrame) -> DataFrame:
    """What ``matched`` has, for given pairs."""
    return counted(windows, allowed).join(terms, ["plan_id", "term"])


def bm25_of(hits: DataFrame) -> DataFrame:
    """BM25 over the scoped query's ceiling, of ``matched`` terms. Only scores above 0."""
    norm = K1 * (1 - B + B * F.col("len") / F.col("mean"))
    part = F.col("w") * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
    got = hits.groupBy("plan_id", "representation_id", "object_id").agg(F.sum(part).alias("got"), F.max("total").alias("total"))
    return got.select("plan_id", "representation_id", "object_id", F.round(F.col("got") / F.col("total"), PLACES).alias("score")).filter("score > 0")


def keyword_of(hits: DataFrame) -> DataFrame:
    """Share of the raw query's idf mass that a window holds, of ``matched`` terms."""
    got = hits.groupBy("plan_id", "representation_id", "object_id").agg(F.sum("w").alias("got"), F.max("total").alias("total"))
    return got.select("plan_id", "representation_id", "object_id", F.round(F.col("got") / F.col("total"), PLACES).alias("score"))


def bm25_scores(plans: DataFrame, windows: DataFrame, allowed: DataFrame) -> DataFrame:
    """R5 of given pairs; statistics over all windows."""
    return bm25_of(matched_pairs(bm25_terms(plans, windows), windows, allowed))


def best_window(scores: DataFrame) -> DataFrame:
    """The best window of each object, ties to the smaller id."""
    return top(scores, ["plan_id", "object_id"], 1, *by_score("representation_id")).drop("rank")


def object_topk(scores: DataFrame, k: int = K) -> DataFrame:
    """Best window per object, then the k best objects."""
    return top(best_window(scores), ["plan_id"], k, *by_score("object_id"))


def dense_scores(plan_vectors: DataFrame, vectors: DataFrame, allowed: DataFrame) -> DataFrame:
    """(cosine + 1) / 2 of allowed windows that have a vector; a vector's length is computed once, before it meets others."""
    v, q = _sized(plan_vectors, vectors)
    return _dense(allowed.select("plan_id", "representation_id", "object_id").join(v.drop("object_id"), "representation_id").join(q, "plan_id"))


def dense_matched(plans: DataFrame, plan_vectors: DataFrame, vectors: DataFrame, objects: DataFrame) -> DataFrame:
    """R7 of all windows that a plan may see. objects: ``access.scoped``. As in ``matched``, all of an object's scores are in one task."""
    v, q = _sized(plan_vectors, vectors)
    q = cut(q.join(plans.select("plan_id", *CURRICULUM, *OF_PLAN), "plan_id"))
    return _dense(v.join(shuffled(objects), "object_id").join(few(q), CURRICULUM).filter(may()))


def _sized(plan_vectors: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    v = vectors.filter(F.col("vector").isNotNull()).select("representation_id", "object_id", "vector", C.norm(F.col("vector")).alias("size"))
    return v, plan_vectors.select("plan_id", "query_vector", C.norm(F.col("query_vector")).alias("query_size"))


def _dense(met: DataFrame) -> DataFrame:
    sizes = F.col("query_size") * F.col("size")
    return met.select("plan_id", "representation_id", "object_id", F.round((F.when(sizes == 0, 0.0).otherwise(C.dot(F.col("query_vector"), F.col("vector")) / sizes) + 1) / 2, PLACES).alias("score"))


def skipped(plans: DataFrame, vectors: DataFrame, objects: DataFrame) -> DataFrame:
    """plan_id, skipped, windows: of the windows that a plan may see, how many have no vector, counted for all objects alike before plans meet them."""
    kinds = vectors.join(objects, "object_id").groupBy(*CURRICULUM, *OF_OBJECT).agg(F.count_if(F.col("vector").isNull()).alias("without"), F.count(F.lit(1)).alias("n"))
    met = kinds.join(plans.select("plan_id", *CURRICULUM, *OF_PLAN), CURRICULUM).filter(may())
    return met.groupBy("plan_id").agg(F.sum("without").alias("skipped"), F.sum("n").alias("windows"))


def window_budget(scores: DataFrame) -> DataFrame:
    """At most BUDGET_WINDOWS windows an object, each within BUDGET_GAP of its best."""
    w = Window.partitionBy("plan_id", "object_id")
    near = scores.withColumn("best", F.max("score").over(w)).withColumn("nth", F.row_number().over(w.orderBy(*by_score("representation_id"))))
    return near.filter((F.col("nth") <= BUDGET_WINDOWS) & (F.round(F.col("best") - F.col("score"), PLACES) <= BUDGET_GAP)).drop("best", "nth")


def dense_topk(scores: DataFrame, k: int = K) -> DataFrame:
    """The k best items, of which an object may fill several."""
    return top(window_budget(scores), ["plan_id"], k, *by_score("object_id", "representation_id"))


def hybrid_topk(lexical: DataFrame, dense: DataFrame, dense_all: DataFrame, k: int = K) -> DataFrame:
    """Reciprocal rank fusion of two ranked runs by object.

    The window comes from the run with the higher raw score, the lexical one on ties; the reported score is that window's
    dense score if it has one, else its own. The fused score orders.
    """
    objects = lambda run, n: top(top(run.drop("rank"), ["plan_id", "object_id"], 1, *by_score("representation_id")).drop("rank"), ["plan_id"], None, *by_score("object_id")).withColumn("run", F.lit(n))
    both = objects(lexical, 0).unionByName(objects(dense, 1))
    pick = F.min_by(F.struct("representation_id", "score"), F.struct(-F.col("score"), F.col("run")))
    fused = both.groupBy("plan_id", "object_id").agg(F.sum(1 / (FUSION + F.col("rank"))).alias("fused"), pick.alias("own"))
    fused = fused.select("plan_id", "object_id", F.round("fused", 9).alias("fused"), "own.representation_id", F.col("own.score").alias("raw"))
    scored = fused.join(dense_all.select("plan_id", "representation_id", F.col("score").alias("dense")), ["plan_id", "representation_id"], "left")
    ranked = top(scored, ["plan_id"], k, F.desc("fused"), F.asc("object_id"))
    return ranked.select("plan_id", "object_id", "representation_id", F.coalesce("dense", "raw").alias("score"), "fused", "rank")


def identity_rerank(items: DataFrame) -> DataFrame:
    """(n - i) / n by position from 0; R11 ranks again by the new score."""
    n = F.count(F.lit(1)).over(Window.partitionBy("plan_id"))
    again = items.withColumn("score", F.round((n - (F.col("rank") - 1)) / n, PLACES))
    return top(again.drop("rank"), ["plan_id"], None, *by_score("object_id"))


def rerank(items: DataFrame, plans: DataFrame, texts: DataFrame, scorer, k: int = K) -> DataFrame:
    """New scores for the candidates from ``scorer(pdf with query, document) -> scores``; fewer than two stay as they are.

    The set of candidates does not change. The port is called with batches of rows in the executors.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy("plan_id"))
    rows = items.withColumn("n", n).join(plans.select("plan_id", F.col("scoped").alias("query")), "plan_id").join(texts.select("representation_id", F.col("search_text").alias("document")), "representation_id", "left")
    cols = "plan_id string, object_id string, representation_id string, score double"

    def run(batches):
        for pdf in batches:
            new = pdf["score"].copy()
            many = pdf["n"] > 1
            new[many] = scorer(pdf[many])
            yield pdf.assign(score=new)[["plan_id", "object_id", "representation_id", "score"]]

    scored = rows.select("plan_id", "object_id", "representation_id", "score", "n", "query", "document").mapInPandas(run, cols)
    return top(scored.withColumn("score", F.round("score", PLACES)), ["plan_id"], k, *by_score("object_id"))


def random_topk(allowed: DataFrame, seed: str, k: int = K) -> DataFrame:
    """A ranking that a hash of seed, plan and object shuffles."""
    key = F.sha2(F.concat_ws("|", F.lit(seed), "plan_id", "object_id"), 256)
    n = allowed.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n"))
    ranked = top(allowed.select("plan_id", "object_id", key.alias("key")), ["plan_id"], k, F.asc("key")).join(n, "plan_id")
    return ranked.select("plan_id", "object_id", F.round(1 - (F.col("rank") - 1) / F.col("n"), PLACES).alias("score"), "rank")


def overlap(plans: DataFrame, objects: DataFrame, *more: str) -> DataFrame:
    """plan_id, object_id, share of the query's terms that an object has, and more of the object; no filter is applied. An object's rows stay in one task."""
    own = objects.select("object_id", *more, F.concat_ws(" ", "heading_path", "text").alias("whole")).repartition("object_id")
    terms = own.select("object_id", *more, F.explode(F.array_distinct(C.tokens(F.col("whole")))).alias("term"))
    q = query_terms(plans, "query")
    n = q.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n"))
    met = terms.join(few(q.join(n, "plan_id")), "term").groupBy("plan_id", "object_id", *more).agg(F.count(F.lit(1)).alias("hit"), F.max("n").alias("n"))
    return met.select("plan_id", "object_id", *more, (F.col("hit") / F.col("n")).alias("base"))


def broken_topk(plans: DataFrame, objects: DataFrame, kind: str, k: int = K) -> DataFrame:
    """Retrievers that must be caught: they see all and prefer a wrong grade, protected types, or other tenants."""
    p = plans.select("plan_id", F.col("grade").alias("plan_grade"), "tenant")
    best = lambda rows: top(rows.select("plan_id", "object_id", F.round("score", PLACES).alias("score")), ["plan_id"], k, *by_score("object_id"))
    if kind == "wrong_grade":
        return best(overlap(plans, objects, "grade").join(few(p), "plan_id").withColumn("score", F.col("base") + F.when(F.col("grade") != F.col("plan_grade"), 1).otherwise(0)))
    liked = F.when(F.col("object_type").isin("solution", "rubric", "answer"), "") if kind == "answer_only" else F.col("tenant_scope")
    objects = objects.withColumn("scope", liked)
    seen = best(overlap(plans, objects, "scope").join(few(p), "plan_id").withColumn("score", F.col("base") + F.when(F.col("scope") != F.col("tenant"), 2).otherwise(0)))
    # Liked objects without overlap all score alike, so of each scope only the k smallest ids can be among the k best. One with overlap
    # scores more than this, so its row here comes after its own, or after the k that leave that out.
    first = top(objects.filter(F.col("scope").isNotNull()).select("object_id", "scope"), ["scope"], k, F.asc("object_id")).drop("rank")
    extra = p.join(F.broadcast(first), F.col("scope") != F.col("tenant")).select("plan_id", "object_id", F.lit(2.0).alias("score"))
    rows = seen.drop("rank").unionByName(extra).groupBy("plan_id", "object_id").agg(F.max("score").alias("score"))
    return best(rows)
