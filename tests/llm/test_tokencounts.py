import os
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from evidara.llm import tokencounts as T


def test_scan_stitches_blocks(spark, tmp_path):
    rng = random.Random(2)
    want = []
    for f in range(4):
        lengths = [rng.choice([0, 1, 2, 7, 8, 9, 40]) for _ in range(50)]
        ids = [x for n in lengths for x in [*(rng.randint(0, 50255) for _ in range(n)), T.SEPARATOR]]
        if f == 3:
            ids, lengths = [*ids, 5, 6, 7], [*lengths, 3]
        np.array(ids, dtype="<u2").tofile(tmp_path / f"part-{f}.bin")
        at = 0
        for k, n in enumerate(lengths):
            want.append((f"part-{f}.bin", k, at, n))
            at += n + 1
    (tmp_path / "empty.bin").write_bytes(b"")
    for block in (1, 3, 8, 1000):
        got = T.scan(spark, f"file://{tmp_path}", block_tokens=block).collect()
        assert sorted((os.path.basename(r.file), r.doc_no, r.first_token, r.n_tokens) for r in got) == sorted(want)


def test_counts_match_tokenizer(spark, tmp_path):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    texts = [None, "", "a", "Ä line\nand more", "same", "same", "word " * 90000, "<|endoftext|>", "日本 \x00 ÿ"] * 3
    spark.createDataFrame([(i, t, i, 0) for i, t in enumerate(texts)], "doc_id long, text string, doc_no long, n_tokens int").repartition(4).write.parquet(str(tmp_path / "d"))
    got = T.count_documents(spark.read.parquet(str(tmp_path / "d")), block_tokens=1000)
    assert {r.doc_id: r.n_tokens for r in got.collect()} == {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    none = spark.createDataFrame([], "doc_id long, text string")
    none.write.parquet(str(tmp_path / "e"))
    assert T.count_documents(spark.read.parquet(str(tmp_path / "e"))).count() == 0


def test_large_files_are_read_in_ranges(spark, tmp_path, monkeypatch):
    rng, want = random.Random(3), []
    for f, lengths in enumerate([[3, 0, 50, 1, 200, 7], [4, 4], [90]]):
        ids = [x for n in lengths for x in [*(rng.randint(0, 50255) for _ in range(n)), T.SEPARATOR]][: -1 if f == 2 else None]
        np.array(ids, dtype="<u2").tofile(tmp_path / f"part {f}.bin")
        at = 0
        for k, n in enumerate(lengths):
            want.append((f"part {f}.bin", k, at, n))
            at += n + 1
    with open(tmp_path / "part 2.bin", "ab") as out:
        out.write(b"x")  # half a token is none
    monkeypatch.setattr(T, "MOST_FILE_BYTES", 40)
    monkeypatch.setattr(T, "RANGE_BYTES", 36, raising=False)
    for block in (5, 1000):
        got = T.scan(spark, f"file://{tmp_path}", block_tokens=block).collect()
        assert sorted((os.path.basename(r.file), r.doc_no, r.first_token, r.n_tokens) for r in got) == sorted(want)
    folder, origin = T.ranges(spark, [(f"file:{tmp_path}/part 0.bin", os.path.getsize(tmp_path / "part 0.bin"))])
    sizes = [os.path.getsize(f"{folder.removeprefix('file://')}/{name.split('/')[1]}") for name in origin]
    assert len(sizes) > 10 and max(sizes) == 36 and sum(sizes) == os.path.getsize(tmp_path / "part 0.bin")


def test_index_of_odd_rows(spark, monkeypatch):
    rows = [(None, "a b"), (5, "a"), (5, "a"), (5, ""), ((1 << 62) + 1, "b"), (-3, None)]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, kind int").repartition(3)
    got = T.count_documents(docs)
    assert sorted(((r.doc_id or 0), r.n_tokens) for r in got.collect()) == sorted(((d or 0), {"a b": 2, "a": 1, "b": 1}.get(t, 0)) for d, t in rows)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_index_keeps_the_order_of_many_rows(spark):
    docs = spark.range(40_000).selectExpr("id * 7 % 40009 as doc_id", "repeat('a ', cast(id % 13 as int)) as text").coalesce(2)
    want = {r.doc_id: len(r.text) // 2 for r in docs.collect()}
    got = {r.doc_id: r.n_tokens for r in T.count_documents(docs).collect()}
    assert len(got) == 40_000 and {k: v > 0 for k, v in got.items()} == {k: v > 0 for k, v in want.items()}
    assert len({(want[d], n) for d, n in got.items()}) == 13
