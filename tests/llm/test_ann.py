import math

import numpy as np
import pytest

from evidara.llm import ann

SCHEMA = "vec_id long, embedding array<float>, v int, shard string"


def brute(ids, x, queries, k):
    x = x.astype(np.float64)
    norm = np.sqrt((x * x).sum(axis=1))
    out = {}
    for q in queries:
        i = int(np.flatnonzero(ids == q)[0])
        s = (x * x[i]).sum(axis=1) / (norm * norm[i])
        at = np.lexsort((ids, -s))
        out[q] = [(int(ids[j]), float(s[j])) for j in at if ids[j] != q][:k]
    return out


@pytest.mark.parametrize("n,kind", [(6000, "noise"), (20000, "clusters"), (3000, "copies")])
def test_recall(spark, n, kind):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 64))
    if kind == "clusters":
        x = x * 0.3 + rng.normal(size=(10, 64))[rng.integers(0, 10, n)]
    if kind == "copies":
        x[: n // 3] = x[0]
    x = x.astype(np.float32)
    ids = np.arange(n) * 3
    docs = spark.createDataFrame([(int(i), v.tolist(), 0, "s") for i, v in zip(ids, x)], SCHEMA).repartition(4)
    got = ann.search(docs, docs.filter("vec_id % 50 = 0")).collect()
    want = brute(ids, x, [i for i in ids if i % 50 == 0], 5)
    hits = 0
    for r in got:
        hits += r.vec_id in [v for v, _ in want[r.query_id]]
        i, j = np.searchsorted(ids, [r.query_id, r.vec_id])
        a, b = x[i].astype(np.float64), x[j].astype(np.float64)
        assert math.isclose(r.score, (a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum()), rel_tol=1e-12, abs_tol=1e-15)
    assert len(got) == 5 * len(want) and hits >= 0.9 * len(got)
    if kind == "copies":
        assert sorted(r.vec_id for r in got if r.query_id == 0) == [3, 6, 9, 12, 15]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [-1.0, 0.0]), (8, [-1.0, 0.0]), (None, [1.0, 2.0])]
    docs = spark.createDataFrame([(i, v, 1, "s") for i, v in rows], SCHEMA)
    got = ann.search(docs, docs.filter("vec_id in (0, 1, 3)"))
    assert [(r.query_id, r.rank, r.vec_id) for r in got.orderBy("rank").collect()] == [(0, 1, 6), (0, 2, 7), (0, 3, 8)]
    none = spark.createDataFrame([], SCHEMA)
    assert ann.search(none, none).count() == 0 and ann.search(docs, none).count() == 0


def test_vectors_of_any_size_and_length(spark):
    rows = [(0, [1e200, 0.0]), (1, [1e200, 1e199]), (2, [1.0, 1.0]), (3, [1e-300, 1e-302]), (4, [1.0, 0.0, 0.0]), (5, [1.0, 1.0, 0.0]), (6, [3.0]), (7, []), (2, [2.0, 1.0]), (2, [1.0, 1.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(docs, docs).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 6)))
    assert got[0] == [(3, 0.99995), (1, 0.995037), (2, 0.707107)]
    assert got[4] == [(5, 0.707107)] and got[5] == [(4, 0.707107)] and 6 not in got and 7 not in got
    assert sorted(got) == [0, 1, 2, 3, 4, 5]
    few = ann.search(docs, docs, sample_rows=1)
    assert few.count() == 14
