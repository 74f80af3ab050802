import hashlib
import random

import numpy as np

from evidara.llm import linededup as L

WS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WS))


def brute(rows, min_docs=3, min_chars=20):
    where = {}
    for d, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                where.setdefault(k, []).append(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(where.get(key(x), [])) >= min_docs and max(where[key(x)]) != d)]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def make(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, h1 string, lost int").repartition(3)


def got(df):
    return sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect())


def rows():
    rng = random.Random(1)
    pool = ["A line that many documents share", "a LINE that many documents share  ", "\tüber die Brücke gehen wir zusammen", "short", "", "exactly twenty chars", "nineteen characters", "İstanbul is a town in a country"]
    out = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"only here {rng.random()} and nowhere else" for _ in range(rng.randint(0, 9)))) for i in range(60)]
    return out + [(60, None), (61, ""), (62, "\n"), (63, "exactly twenty chars\n" * 3), (64, "long " * 60000 + "\nexactly twenty chars\r")]


def test_matches_brute_force(spark):
    r = rows()
    docs = make(spark, r)
    assert got(L.clean(docs, L.LineIndex.build(docs))) == brute(r)


def test_empty(spark):
    docs = make(spark, [])
    assert L.clean(docs, L.LineIndex.build(docs)).count() == 0


def test_adding_and_removing_restore_every_decision(spark):
    r = rows()
    a, b = r[:40], r[40:]
    docs_a, docs_b = make(spark, a), make(spark, b)
    base = L.LineIndex.build(docs_a, shards=4)
    both = base.add(docs_b)
    assert got(L.clean(make(spark, r), both)) == brute(r)
    back = both.remove(docs_b)
    assert got(L.clean(docs_a, back)) == brute(a)
    held = back.seen(back.counts).filter("not maybe").count()
    gone = both.counts.join(back.counts, ["h1", "h2"], "left_anti")
    assert held == 0 and both.seen(gone).filter("not maybe").count() == 0
    assert back.seen(gone).filter("maybe").count() <= 1


def test_cuckoo_filter():
    keys = np.random.default_rng(3).integers(1, 1 << 62, 5000).astype(np.uint64)
    f = L.CuckooFilter(len(keys))
    f.insert(keys[:4000])
    assert f.contains(keys[:4000]).all() and f.contains(keys[4000:]).mean() < 0.01
    f.delete(keys[:2000])
    assert f.contains(keys[2000:4000]).all() and f.contains(keys[:2000]).mean() < 0.01
    tight = L.CuckooFilter(1)
    tight.insert(keys[:40])
    assert tight.overflow and tight.contains(keys[:40]).all()
    tight.delete(keys[:40])
    assert not tight.overflow and not tight.table.any()


def test_repeated_rows_are_one_document(spark):
    line = "this line is in two documents"
    docs = make(spark, [(1, line), (1, line), (2, line)])
    assert [x[2] for x in got(L.clean(docs, L.LineIndex.build(docs)))] == [0, 0, 0]
    docs = make(spark, [(1, line), (1, "other\n" + line), (2, line), (3, line)])
    assert [x[:3] for x in got(L.clean(docs, L.LineIndex.build(docs)))] == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 1, 0)]
    index = L.LineIndex.build(make(spark, [(1, line), (2, line)]))
    assert index.add(make(spark, [(2, line)])).counts.first()["n_docs"] == 2


def test_thue_morse_lines_differ(spark):
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
    other = word.translate(str.maketrans("ab", "ba"))
    docs = make(spark, [(1, word), (2, word), (3, other)])
    assert [x[2] for x in got(L.clean(docs, L.LineIndex.build(docs)))] == [0, 0, 0]


def test_filters_that_stream(spark, monkeypatch):
    monkeypatch.setattr(L, "SENT_BYTES", 0)
    monkeypatch.setattr(L, "STREAM_ROWS", 1)
    test_matches_brute_force(spark)
    test_adding_and_removing_restore_every_decision(spark)


def test_many_keys_stay_held_through_adding_and_removing(spark):
    n, per = 150_000, 30
    lines = lambda lo, hi: spark.range(lo // per, hi // per).selectExpr("id as doc_id", f"array_join(transform(sequence(id * {per}, id * {per} + {per - 1}), k -> concat('a line of its own, number ', k)), '\n') as text")
    base = L.LineIndex.build(lines(0, n))
    base.filters.count()
    both = base.add(lines(n, 2 * n))
    assert both.keys == 2 * n == both.counts.count() and both.shards == base.shards
    back = both.remove(lines(n, 2 * n))
    assert back.keys == n and back.seen(back.counts).filter("not maybe").count() == 0
    assert both.seen(both.counts).filter("not maybe").count() == 0
    gone = both.counts.join(back.counts, ["h1", "h2"], "left_anti")
    assert back.seen(gone).filter("maybe").count() < n // 500
    more = both.add(lines(2 * n, 5 * n))
    assert more.room[0] == 10 * n and more.seen(more.counts).filter("not maybe").count() == 0
