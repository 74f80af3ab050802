"""Approximate nearest neighbours by a permutation index (operator 5).

A vector is represented by the order in which it meets a fixed set of pivots, nearest first, and posted in
the inverted files of its nearest pivots. A query is sent to the files of its own nearest pivots only, keeps
what lies within a bound of the footrule distance between the pivot orders, and reranks that by cosine
on the original vectors. How many files a query opens, and the bound, are measured on the sample
that the pivots come from: few where vectors cluster, about half of the files on plain noise.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch

#: Least number of pivots; the square root of the number of rows, and at most half of the sample, where that is more.
PIVOTS = 256
#: Pivot files in which a row is posted.
POSTED = 2
#: Share of the sample's true neighbours whose file must be opened, and whose footrule the bound must admit.
REACHED = 0.97
#: Rows of a file that a query reranks at least.
RERANKED_LEAST = 16
#: Rows in a slice of a file, and queries in a block, about; a task holds one of each.
SLICE_ROWS, QUERY_BLOCK = 8192, 2048
#: Bound on the rows from which pivots are drawn, and of them on the queries that the measurement asks.
SAMPLE_ROWS, SAMPLE_QUERIES = 4096, 512


def _matrix(column) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in column], dtype=np.float64).reshape(len(column), -1)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Each row divided by the power of two next to its largest component, which leaves cosines as they are and lets no square overflow or vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def usable(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """Rows that take part: an id, no null or non-finite component, and one that is not zero."""
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    some = F.exists(vec, lambda x: x != 0)
    return vectors.filter(F.col("vec_id").isNotNull() & F.col(vec).isNotNull() & ok & some)


def orders(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Position of every pivot in each row's order, nearest first; ties to the earlier pivot."""
    near = np.argsort(-(x @ pivots.T), axis=1, kind="stable")
    out = np.empty_like(near, dtype=np.int16)
    np.put_along_axis(out, near, np.arange(len(pivots), dtype=np.int16)[None, :], axis=1)
    return out


class Pivots:
    """The pivots of one vector length, the number of files a query opens, and the bound on the footrule."""

    def __init__(self, x: np.ndarray, most: int, k: int):
        x = np.unique(x, axis=0)
        x = x[np.random.default_rng(0).permutation(len(x))]
        n = min(most, max(1, len(x) // 2))
        self.near, rest = x[:n], x[n:]
        self.opened, self.bound = n, np.inf
        if len(rest) > max(k, n):
            asked = rest[:SAMPLE_QUERIES]
            like = asked @ rest.T
            like[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
            best = np.argpartition(-like, k, axis=1)[:, :k]
            own, order = orders(asked, self.near), orders(rest, self.near)
            files = np.argsort(order, axis=1)[:, :POSTED]
            need = np.array([own[i][files[best[i]]].min(axis=1) + 1 for i in range(len(asked))])
            far = np.array([_footrule(order[best[i]], own[i]) for i in range(len(asked))])
            self.opened = int(np.quantile(need, REACHED, method="higher"))
            self.bound = int(np.quantile(far, REACHED, method="higher"))


def _footrule(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    return np.abs(rows - order).sum(axis=1, dtype=np.int32)


def pivot_sets(vectors: DataFrame, vec: str, most: int, k: int, sample_rows: int) -> dict[int, Pivots]:
    """Pivots for each length among the ``sample_rows`` rows with the smallest hashes."""
    rows = vectors.select("vec_id", vec).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).collect()
    out = {}
    for n in {len(r[vec]) for r in rows}:
        x = _scaled(_matrix([r[vec] for r in rows if len(r[vec]) == n]))
        out[n] = Pivots(x / np.sqrt((x * x).sum(axis=1, keepdims=True)), most, k)
    return out


def _units(column) -> tuple[np.ndarray, np.ndarray]:
    x = _scaled(_matrix(column))
    return x, np.sqrt((x * x).sum(axis=1))


def _files(vectors: DataFrame, sent, n_files) -> DataFrame:
    """vec_id, v, n, file, place, opened: a row for each of the ``n_files(pivots, order)`` nearest pivots, -1 without pivots."""

    def run(batches):
        for pdf in batches:
            sizes = pdf["v"].map(len)
            for n in sizes.unique():
                own = pdf[sizes == n]
                if n not in sent.value:
                    yield own.assign(n=n, file=-1, place=0, opened=1)
                    continue
                x, norm = _units(own["v"])
                order = orders(x / norm[:, None], sent.value[n].near)
                opened = n_files(n, order)
                row, file = np.nonzero(order < opened[:, None])
                yield own.iloc[row].assign(n=n, file=file, place=order[row, file], opened=opened[row])

    return vectors.mapInPandas(run, vectors.select("vec_id", "v", *(F.lit(0).alias(c) for c in ("n", "file", "place", "opened"))).schema)


def _met(own: pd.DataFrame, ask: pd.DataFrame, found: Pivots | None, file: int, k: int) -> pd.DataFrame:
    """query_id, vec_id, score: the k best of a slice of one file for each query, ties to the smaller id.

    A row that a query could meet in several files is looked at in the nearest to the row of those that the query opens.
    """
    own = own.sort_values("vec_id")
    ids, (x, norm) = own["vec_id"].to_numpy(), _units(own["v"])
    q, size = _units(ask["v"])
    if found is not None:
        order, wanted = orders(x / norm[:, None], found.near), orders(q / size[:, None], found.near)
        files = np.argsort(order, axis=1)[:, :POSTED]
    out = []
    for i, (query_id, opened) in enumerate(zip(ask["vec_id"], ask["opened"])):
        here = ids != query_id
        if found is not None:
            first = (wanted[i][files] < opened).argmax(axis=1)
            here &= files[np.arange(len(files)), first] == file
        at = np.flatnonzero(here)
        if found is not None and len(at) > RERANKED_LEAST:
            far = _footrule(order[at], wanted[i])
            at = at[far <= max(found.bound, np.partition(far, RERANKED_LEAST)[RERANKED_LEAST])]
        score = (x[at] * q[i]).sum(axis=1) / (norm[at] * size[i])
        best = np.lexsort((ids[at], -score))[:k]
        out.append((np.full(len(best), query_id), ids[at][best], score[best]))
    return pd.DataFrame({c: np.concatenate(v) for c, v in zip(("query_id", "vec_id", "score"), zip(*out))})


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, vec: str = "embedding", pivots: int = PIVOTS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows of vectors to each row of queries, both (vec_id, vec).

    Nearness is the cosine in double precision; a row is never its own neighbour; ties go to the smaller vec_id. Rows
    whose vector is null, empty, zero, or has null or non-finite components take no part; of rows that repeat an id the
    least usable vector is searched and found. A vector is compared with those of its own length only, and a length that the sample
    has missed is compared without pivots. Components of any size are scaled before they are squared. With fewer candidates than k all are returned; empty
    tables give no rows. Of equal vectors the k + 1 smallest ids are indexed, which no answer can tell from all of them.
    Sent to the driver: the sample, and the number of rows in each file. Files are cut into slices and the queries of a file into blocks by size.
    """
    schema = "query_id long, vec_id long, score double"
    spark = vectors.sparkSession
    rows, asked = (usable(df.select("vec_id", F.col(vec).alias("v")), "v").groupBy("vec_id").agg(F.min("v").alias("v")) for df in (vectors, queries))
    alike = Window.partitionBy("v").orderBy("vec_id")
    rows = scratch.materialize(rows.withColumn("again", F.row_number().over(alike)).filter(F.col("again") <= k + 1).drop("again"), "vectors")
    most = min(sample_rows // 2 or 1, max(pivots, int(rows.count() ** 0.5)))
    sent = spark.sparkContext.broadcast(pivot_sets(rows, "v", most, k, sample_rows))

    posted = scratch.materialize(_files(rows, sent, lambda n, order: np.full(len(order), POSTED)), "postings")
    held = {(r["n"], r["file"]): r["count"] for r in posted.filter("place = 0 and file >= 0").groupBy("n", "file").count().collect()}

    def opened(n: int, order: np.ndarray) -> np.ndarray:
        """The measured number of files, or more where those hold fewer than k + 1 rows."""
        found = sent.value[n]
        size = np.array([held.get((n, p), 0) for p in range(len(found.near))])
        sums = size[np.argsort(order, axis=1)].cumsum(axis=1)
        enough = (sums >= min(k + 1, size.sum())).argmax(axis=1) + 1
        return np.maximum(found.opened, enough)

    routed = scratch.materialize(_files(asked, sent, opened), "routes")
    parts = lambda df, own, size: df.groupBy("n", "file").agg(F.ceil(F.count("*") / size).cast("int").alias(own))
    files = parts(posted, "slices", SLICE_ROWS).join(parts(routed, "blocks", QUERY_BLOCK), ["n", "file"])
    dealt = lambda df, own, other: df.join(files, ["n", "file"]).withColumn(own[:-1], F.pmod(F.xxhash64("vec_id"), F.col(own)).cast("int")).withColumn(other[:-1], F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
    key = ["n", "file", "slice", "block"]

    def run(key, own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if own.empty or ask.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        return _met(own, ask, sent.value.get(int(key[0])), int(key[1]), k)

    left = dealt(posted, "slices", "blocks").select(*key, "vec_id", "v")
    right = dealt(routed, "blocks", "slices").select(*key, "vec_id", "v", "opened")
    found = left.groupBy(key).cogroup(right.groupBy(key)).applyInPandas(run, schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


QUERIES = {"op5_permutation_index": op5_permutation_index}
ORACLES: dict[str, str] = {}
