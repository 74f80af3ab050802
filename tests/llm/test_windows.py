import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from evidara.llm import anchored, hashing, substrings, suffixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_words(rows, width=20):
    first, out = {}, []
    for d, t in sorted(rows, key=lambda r: r[0]):
        ws = WORD.findall(t or "")
        gone = np.zeros(len(ws), bool)
        for s in range(len(ws) - width + 1):
            if first.setdefault(tuple(ws[s : s + width]), (d, s)) < (d, s):
                gone[s : s + width] = True
        kept = " ".join(w for w, g in zip(ws, gone) if not g)
        out.append((d, len(ws), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def brute_bytes(rows, width=50):
    first, out = {}, []
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - width + 1):
            if first.setdefault(b[s : s + width], d) < d:
                gone[s : s + width] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé日") for _ in range(rng.randint(1, 6))) for _ in range(40)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    passages = [words(rng.randint(19, 60)) for _ in range(5)]
    rows = []
    for d in range(70):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = list(rng.choice(passages))
            if rng.random() < 0.5:
                p[rng.randrange(len(p))] = "edit"
            cut = rng.randint(0, 8)
            parts += words(rng.randint(0, 30)) + p[cut:]
        rows.append((d * 7 % 71, rng.choice([" ", "\n", "\t ", "  "]).join(parts)))
    copy = rows[5][1]
    rows += [(100 + k, copy) for k in range(6)] + [(200, None), (201, ""), (202, " \n "), (203, "a " * 3000), (204, "a " * 50 + "b"), (205, "x\x85y z　w " * 15), (206, "\x00" * 120), (207, "\x00" * 119 + "a"), (208, "long tail " + " ".join(map(str, range(9000)))), (209, " ".join(map(str, range(2000, 2300))))]
    return rows


def make(spark, rows):
    return spark.createDataFrame([(d, t, b"x", 3) for d, t in rows], "doc_id long, text string, bucket binary, what int").repartition(4)


@pytest.mark.parametrize("seed", [1, 2])
def test_words(spark, seed, monkeypatch):
    rows = corpus(seed)
    got = substrings.substring_dedup(make(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_words(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes(spark, seed):
    rows = corpus(seed)
    got = suffixes.byte_dedup(make(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_bytes(rows)


def test_many_small_chunks(spark, monkeypatch):
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(30)
    for mine, brute, cols in ((substrings.substring_dedup, brute_words, 4), (suffixes.byte_dedup, brute_bytes, 5)):
        got = mine(df, text=False).collect()
        assert sorted(tuple(r)[:cols] for r in got) == brute(rows)


def test_odd_tables(spark):
    none = make(spark, [])
    assert substrings.substring_dedup(none).count() == 0 and suffixes.byte_dedup(none).count() == 0
    t = " ".join(f"w{i}" for i in range(40))
    rows = [(None, t), (5, t), (5, t), (6, t)]
    for mine in (substrings.substring_dedup, suffixes.byte_dedup):
        got = sorted((r.doc_id, r.n_removed > 0) for r in mine(make(spark, rows)).collect())
        assert got == [(5, False), (5, False), (6, True)]


def test_cover_and_runs():
    period, cover = substrings.PERIOD, substrings.COVER
    assert all(any((i + d) % period in cover and (j + d) % period in cover for d in range(period)) for i in range(period) for j in range(period))
    gone, n, runs = anchored.removed_runs(np.array([0, 1, 10]), 3, 13)
    assert (n, runs) == (7, 2) and gone.tolist() == [True] * 4 + [False] * 6 + [True] * 3


def test_repeated_ids_with_other_texts(spark):
    one, two = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, one), (1, two), (2, two + " " + one), (3, one)]
    for mine in (substrings.substring_dedup, suffixes.byte_dedup):
        got = sorted((r.doc_id, r.n_removed) for r in mine(make(spark, rows)).collect())
        assert [d for d, n in got if n] == [2, 3] and got[0][1] == got[1][1] == 0


def thue_morse(n):
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_thue_morse_words_differ(spark):
    for n in (64, 1024, 4096):
        x, y = thue_morse(n)
        rest = " ".join(f"w{i}" for i in range(19))
        got = {r.doc_id: r.n_removed for r in substrings.substring_dedup(make(spark, [(1, f"{x} {rest}"), (2, f"{y} {rest}"), (3, f"{x} {rest}")])).collect()}
        assert got == {1: 0, 2: 0, 3: 20}


def test_families_agree_with_plain_arithmetic():
    rng = random.Random(5)
    data = np.array([rng.randrange(256) for _ in range(70_000)], dtype=np.uint8)
    start = np.array(sorted(rng.randrange(len(data) - 90) for _ in range(50)))
    end = start + np.array([rng.randrange(80) for _ in start])
    family, p = hashing.BYTES, hashing.PRIME
    plain = []
    for s, e in zip(start, end):
        a, b = (sum(int(family.codes[k][x]) * pow(family.bases[k], i, p) for i, x in enumerate(data[s:e])) % p for k in range(2))
        plain.append(int(hashing.mix(np.array([(a << 31 | b) + int(e - s) * 0xD6E8FEB86659FD93 & (1 << 64) - 1], dtype=np.uint64))[0]))
    assert family.span(family.prefix(data), start, end).tolist() == plain == family.short(data, start, end).tolist()


def stream(table, n):
    return [table.slice(i, n).to_batches()[0] for i in range(0, table.num_rows, n)]


@pytest.mark.parametrize("within", [False, True])
@pytest.mark.parametrize("wide", [3, 1000])
def test_streams_are_the_same_however_they_are_cut(within, wide, monkeypatch):
    monkeypatch.setattr(anchored, "WIDE", wide)
    rng = random.Random(wide)
    rows = sorted((a, rng.randrange(6) if a % 3 else 1, rng.randrange(40), rng.randrange(9) << anchored.POS) for a in range(30) for _ in range(rng.choice([1, 2, 30])))
    table = pa.table(dict(zip(("a", "u", "doc", "mark"), map(list, zip(*rows)), strict=True)))
    seen, ask = [], []
    for a, _, d, m in rows:
        first = min((d2, m2) for a2, u2, d2, m2 in rows if (a2, u2) == (a, _))
        several = len({u2 for a2, u2, *_2 in rows if a2 == a}) > 1
        if d > first[0] or within and d == first[0] and m > first[1]:
            seen.append((d, m))
        elif several:
            ask.append((a, d, m))
    for n in (7, 64, 10_000):
        monkeypatch.setattr(anchored, "ROWS", n)
        got = [r for b in anchored.find_seen(stream(table, n), within) for r in b.to_pylist()]
        assert sorted((r["doc"], r["mark"]) for r in got if r["what"] == anchored.SEEN) == sorted(seen)
        assert sorted((r["a"], r["doc"], r["mark"]) for r in got if r["what"] != anchored.SEEN) == sorted(ask)
        for a in range(30):
            assert len({r["what"] for r in got if r["what"] != anchored.SEEN and r["a"] == a}) < 2 or wide == 3


@pytest.mark.parametrize("within", [False, True])
def test_windows_by_both_orders(within, monkeypatch):
    rng = random.Random(8)
    width, rows = 6, []
    for d in range(300):
        a, left, more = rng.randrange(4), rng.randrange(4), rng.randrange(3)
        n = left + more + 1  # windows start left before the anchor up to it
        n = min(n, left + 1)
        pos = left + d * 10  # no two places of a document are one
        sym = bytes(rng.choice(b"\x00ab") for _ in range(n - 1 + width))
        sym = sym[:left] + b"zz" + sym[left + 2 :]
        rows.append((a, d // 2, pos << anchored.POS | left << 5 | n - 1, sym))
    rows.sort(key=lambda r: r[:3])
    table = pa.table({"a": [r[0] for r in rows], "doc": [r[1] for r in rows], "mark": [r[2] for r in rows], "sym": pa.array([r[3] for r in rows], type=pa.binary())})
    windows = []
    for a, d, m, sym in rows:
        lo, hi = (int(x[0]) for x in anchored.starts_of(np.array([m])))
        back = (m >> 5) & 31
        windows += [((a, back - k, sym[k : k + width]), (d, lo + k), (d, m), k) for k in range(hi - lo + 1)]
    first = {}
    for key, at, *_ in windows:
        first[key] = min(first.get(key, at), at)
    want = {}
    for key, at, row, k in windows:
        if at[0] > first[key][0] or within and at > first[key]:
            want[row] = want.get(row, 0) | 1 << k
    for n in (5, 40, 1000):
        monkeypatch.setattr(anchored, "PHRASES", n)
        got = [r for b in anchored.find_windows(stream(table, n), np.uint8, width, within) for r in b.to_pylist()]
        assert sorted((r["doc"], r["mark"], r["mask"]) for r in got) == sorted((*r, m) for r, m in want.items())
