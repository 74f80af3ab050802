import itertools
import random
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from evidara.llm import packing


def best(lengths, capacity):
    """Fewest bins by exhaustive search."""
    n = len(lengths)
    fits = [m for m in range(1, 1 << n) if sum(x for i, x in enumerate(lengths) if m >> i & 1) <= capacity]
    cost = {0: 0}
    for mask in range(1, 1 << n):
        low = mask & -mask
        cost[mask] = min(1 + cost[mask & ~m] for m in fits if m & low and m & mask == m)
    return cost[(1 << n) - 1]


def bins(patterns):
    return sum(c for c, _ in patterns)


def check_plan(counts, capacity):
    patterns = packing.plan(counts, capacity)
    got = defaultdict(int)
    for copies, inside in patterns:
        assert copies > 0 and sum(a * b for a, b in inside) <= capacity
        for size, n in inside:
            got[size] += n * copies
    assert dict(got) == counts
    return patterns


def test_plans_are_whole_and_near_optimal():
    rng, over = random.Random(5), 0
    for _ in range(120):
        lengths = [rng.randint(1, 20) for _ in range(rng.randint(1, 8))]
        counts = {x: lengths.count(x) for x in lengths}
        over += bins(check_plan(counts, 20)) - best(lengths, 20)
    assert over <= 4


def test_reduction_keeps_an_optimum():
    rng = random.Random(6)
    for _ in range(120):
        lengths = [rng.randint(3, 20) for _ in range(rng.randint(1, 8))]
        rest = {x: lengths.count(x) for x in lengths}
        fixed = packing.reduce_instance(rest, 20)
        left = list(itertools.chain(*([x] * n for x, n in rest.items())))
        assert bins(fixed) + (best(left, 20) if left else 0) == best(lengths, 20)


def lower_bound(counts, c):
    """The largest of the bounds that long pieces and volume give together."""
    most = 0
    for a in range(c // 2 + 1):
        alone = sum(n for x, n in counts.items() if x > c - a)
        long = [(x, n) for x, n in counts.items() if c / 2 < x <= c - a]
        room = sum((c - x) * n for x, n in long)
        short = sum(x * n for x, n in counts.items() if a <= x <= c / 2)
        most = max(most, alone + sum(n for _, n in long) + max(0, -(-(short - room) // c)))
    return most


def test_large_histogram_is_close_to_the_lower_bound():
    rng = random.Random(7)
    counts = {x: rng.randint(1, 5000) for x in range(1, 2049)}
    patterns = check_plan(counts, 2048)
    assert bins(patterns) <= 1.002 * lower_bound(counts, 2048) + 1


def test_cut():
    assert packing.cut(1, 4) == [(0, 1)] and packing.cut(4, 4) == [(0, 4)]
    assert packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)]


def test_pack_round_trip(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    texts = [None, "", "a", "same text", "same text", "héllo wörld <|endoftext|> \x00", "word " * 5000, "x" * 3000, "日本語 " * 900, " \n\t "]
    docs = spark.createDataFrame([(i, t, "z", 5) for i, t in enumerate(texts)] + [(3, "same text", "z", 5)], "doc_id long, text string, length string, part int").repartition(3)
    out = packing.pack(docs).toPandas()
    at = defaultdict(list)
    for r in out.itertuples():
        ids = [*tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 0]
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes())
        at[r.sequence_id].append((r.offset, r.length))
    for own in at.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(out[out.doc_id == 3]) == 2
    for i, t in enumerate(texts):
        n = len(tok.encode(t or "", add_special_tokens=False).ids) + 1
        assert sorted(zip(out[out.doc_id == i].start, out[out.doc_id == i].length))[: -(-n // 2048)] == (packing.cut(n) if i != 3 else packing.cut(n) * 2)[: -(-n // 2048)]


def test_pack_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_and_stage_encode_added_tokens_as_tokenizers_does(spark, tmp_path):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [None, "", "a<|endoftext|>b", "<|endoftext|>", " <|endoftext|> <|endoftext|>\n", "<|endoftext|", "<|endoftext|><|endoftext|>x " * 900, "plain"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert tok.encode(texts[2], add_special_tokens=False).ids == [64, 50256, 65]
    for out in (packing.op4_best_fit_packing(spark, str(tmp_path)), corpus_pipeline.sequences(spark, docs, str(tmp_path))):
        got = defaultdict(list)
        for r in out.collect():
            got[r.doc_id].append((r.start, r.length, r.ids_crc32))
        for i, t in enumerate(texts):
            ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
            assert sorted(got[i]) == [(s, n, zlib.crc32(ids[s : s + n].tobytes())) for s, n in packing.cut(len(ids))]
