import random
import re

from evidara.llm import decontaminate as D

WORD = re.compile(r"[^\W_]+")


def brute(docs, items):
    out = {}
    for d, t in docs:
        dw = WORD.findall((t or "").lower())
        for item, q in items:
            g = WORD.findall((q or "").lower())
            if d is None or item is None or len(g) < D.LEAST:
                continue
            w = min(len(g), D.SPAN)
            starts = sorted({*range(0, len(g) - w + 1, D.STRIDE), len(g) - w})
            for i in range(len(dw) - w + 1):
                for j in starts:
                    same = sum(dw[i + k] == g[j + k] for k in range(w))
                    if same >= (D.SPAN - D.ALLOWED if w == D.SPAN else w):
                        first, most = out.get((d, item), (i, 0))
                        out[d, item] = (min(first, i), max(most, same))
    return sorted((*k, *v) for k, v in out.items())


def data():
    rng = random.Random(4)
    vocab = [f"w{k}" for k in range(30)] + ["É", "ß", "the", "of"]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(words(n))) for i, n in enumerate([3, 4, 5, 7, 11, 12, 13, 16, 30, 55])]
    items += [(50, None), (51, ""), (None, items[8][1]), (52, items[8][1]), (8, items[8][1])]
    docs = []
    for d in range(80):
        p = rng.choice(items[2:10])[1].split()
        for _ in range(rng.randint(0, 4)):
            p[rng.randrange(len(p))] = "changed"
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(words(rng.randint(0, 40)) + p + words(rng.randint(0, 40)))))
    return docs + [(90, None), (91, ""), (92, "the of " * 20000 + items[9][1].upper()), (None, items[9][1]), (93, items[9][1]), (93, items[9][1])], items


def make(spark, docs, items):
    return (
        spark.createDataFrame([(a, b, "x", 1) for a, b in docs], "doc_id long, text string, seed string, i int").repartition(3),
        spark.createDataFrame([(a, b, 7) for a, b in items], "item_id long, text string, doc_id int"),
    )


def test_matches_brute_force(spark, monkeypatch):
    docs, items = data()
    want = brute(docs, items)
    assert len(want) > 40
    got = D.contaminated(*make(spark, docs, items))
    assert sorted(map(tuple, got.select("doc_id", "item_id", "first_word", "n_equal").collect())) == want
    monkeypatch.setattr(D, "SENT_SEEDS", 0)
    got = D.contaminated(*make(spark, docs, items))
    assert sorted(map(tuple, got.select("doc_id", "item_id", "first_word", "n_equal").collect())) == want


def test_empty_tables(spark):
    docs, items = data()
    assert D.contaminated(*make(spark, [], items)).count() == 0
    assert D.contaminated(*make(spark, docs, [])).count() == 0


def test_plan_is_native(spark):
    docs, items = data()
    plan = D.contaminated(*make(spark, docs, items))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_every_window_of_an_item_is_seeded(spark):
    """Passages inside the tolerance that start at no fourth word of the item."""
    item = [f"w{k}" for k in range(40)]
    passage = lambda low, high, replaced: " ".join("changed" if k in replaced else item[k] for k in range(low, high))
    docs = [(1, passage(2, 14, {7})), (2, passage(1, 14, {3, 9})), (3, "before " + passage(5, 17, {7, 12}) + " after"), (4, passage(2, 14, {5, 8, 11}))]
    got = D.contaminated(*make(spark, docs, [(0, " ".join(item))]))
    assert sorted(map(tuple, got.select("doc_id", "item_id", "first_word", "n_equal").collect())) == [(1, 0, 0, 11), (2, 0, 0, 10), (3, 0, 1, 10)]
