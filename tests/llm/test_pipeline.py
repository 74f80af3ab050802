import random

import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rng = random.Random(8)
    vocab = {k: [f"{k}{rng.choice('aeiou')}{rng.choice('bcdfg')}{n}x" for n in range(200)] for k in ("en", "de", "fr", "es")}
    words = lambda k, n: " ".join(rng.choice(vocab[k]) for _ in range(n))
    items = [(i, words("en", 30)) for i in range(3)]
    rows = []
    for d in range(80):
        k = sorted(vocab)[d % 4]
        rows.append((d, "\n".join([words(k, 90), "This line stands in a lot of documents", words(k, 85)]), k))
    rows += [(100, rows[0][1] + " tail", "en"), (101, "head " + items[1][1] + " more of it", "en"), (102, "123 456", "en"), (103, None, "en"), (104, "", "de")]
    return [(d, t, k, "src0", len(t or "")) for d, t, k in rows], items


def test_stages(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == COLUMNS
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append({r.doc_id: r for r in docs.collect()})
    assert set(seen[0]) == {*range(80), 100, 101}
    assert set(seen[1]) == set(seen[0])
    assert [d for d, r in seen[1].items() if "This line stands" in r.text] == [100]
    assert all(r.n_chars == len(r.text) for r in seen[1].values())
    assert set(seen[2]) == set(seen[1]) - {100}
    assert set(seen[3]) == set(seen[2]) - {101}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(seen[3]) and all(r.offset + r.length <= 2048 for r in packed)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, row int"
    texts = [" ".join(f"{a}{i}" for i in range(30)) for a in "abcd"]
    rows = [(i, t, None, "s", len(t), "k", i) for i, t in enumerate(texts)] + [(1, "zz " + texts[1], None, None, None, None, None), (None, texts[0], None, "s", 1, "k", 1), (9, "12 34", None, "s", 5, "k", 9), (8, None, None, "s", 0, "k", 8)]
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows, schema)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [f.split()[0] for f in schema.split(", ")]
        got = sorted(docs.collect(), key=lambda r: r.doc_id)
        assert [(r.doc_id, r.text, r.row) for r in got] == [(i, t, i) for i, t in enumerate(texts)], name
        docs = spark.createDataFrame(got, schema)


def test_language_is_filled_in(spark, tmp_path):
    rows, _ = corpus()
    docs = spark.createDataFrame([(d, t, None if d == 7 else k, s, n) for d, t, k, s, n in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.lang for r in corpus_pipeline.language(spark, docs, str(tmp_path)).collect()}
    assert got == {d: k for d, t, k, *_ in rows if d < 102}
