import random
import re

import pytest

from evidara.llm import components, jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t):
    ws = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")))
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    up = {d: d for d, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return sorted((d, len(s), find(d)) for d, s in sets)


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"v{k}" for k in range(500)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    line = words(12)
    rows = []
    for family in range(12):
        base = words(rng.randint(5, 90))
        for _ in range(rng.randint(1, 12)):
            base = list(base)
            for _ in range(rng.randint(0, 3)):
                base[rng.randrange(len(base))] = rng.choice(vocab)  # drifts from copy to copy
            rows.append(base + (line if rng.random() < 0.4 else []))
    rows += [line + words(rng.randint(0, 3)) for _ in range(30)] + [words(rng.randint(1, 4)) for _ in range(5)]
    rng.shuffle(rows)
    out = [(i * 3, rng.choice([" ", "\n"]).join(r)) for i, r in enumerate(rows)]
    return out + [(1001, None), (1002, ""), (1003, " \t"), (1004, "a b"), (1005, "A\tB"), (1006, "x " * 9000), (1007, "X " * 9000 + "x"), (1008, " ".join(f"q{k}" for k in range(8000)))]


@pytest.mark.parametrize("seed,most", [(1, 1000), (2, 1000), (3, 6)])
def test_matches_brute_force(spark, seed, most):
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, "g", 1) for d, t in rows], "doc_id long, text string, token string, n int").repartition(3)
    got = jaccard.join(docs, group_members=most)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == brute(rows)


def test_large_group_is_split(spark):
    rng = random.Random(9)
    base = [f"b{k}" for k in range(200)]
    rows = []
    for i in range(120):
        t = list(base)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(200)] = f"x{rng.random()}"
        rows.append((i, " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, jaccard.join(docs, group_members=10).collect())) == brute(rows)


def test_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.join(none).count() == 0
    rows = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (7, "A B C")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.join(rows).collect())) == [(4, 1, 4), (4, 1, 4), (7, 1, 4)]


def test_components(spark):
    rng = random.Random(3)
    pairs = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    up = {x: x for p in pairs for x in p}
    for _ in range(200):
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
    assert got == {k: v for k, v in up.items() if k != v}
