import random
import tracemalloc

import numpy as np

from evidara.llm import langid, toxicity

WORDS = {
    "en": "the of and with that from this have which their would there about could other".split(),
    "de": "und der die nicht mit einer schon über auch werden können zwischen durch gegen".split(),
    "fr": "les des une dans pour avec sont cette entre leurs mais aussi être après où".split(),
    "es": "los del una para como pero más este también entre cuando muy desde ñandú".split(),
}


def rows(n, seed=1):
    rng = random.Random(seed)
    langs = sorted(WORDS)
    out = []
    for i in range(n):
        lang = langs[i % 4]
        words = [rng.choice(WORDS[lang]) + rng.choice(["", "", "s"]) for _ in range(rng.randint(8, 60))]
        toxic = rng.random() < 0.3
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["vileword", "badword", "uglyterm"]))
        out.append((i, " ".join(words), lang, int(toxic)))
    return out


def test_language_machines_on_sparse_rows_equal_dense_ones():
    rng = np.random.default_rng(3)
    dense = (rng.random((90, 500)) * (rng.random((90, 500)) < 0.05)).astype(np.float32)
    dense[7] = 0
    row, at = np.nonzero(dense)
    sparse = langid.Sparse(row.astype(np.int32), at.astype("<u2"), dense[row, at], dense.shape)
    langs = [["a", "b", "c", "d"][i % 4] for i in range(90)]
    one, two = langid.Model(dense, langs), langid.Model(sparse, langs)
    assert one.groups == two.groups and one.pairs == two.pairs
    assert np.allclose(one.w, two.w, atol=1e-5) and np.allclose(one.b, two.b, atol=1e-5)


def test_language_sample_stays_sparse_on_the_driver(spark):
    docs = spark.createDataFrame([r[:3] for r in rows(600)], "doc_id long, text string, lang string")
    langid.train(docs)
    tracemalloc.start()
    try:
        langid.train(docs)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 400 * langid.DIM * 4 / 2


def test_language_id(spark):
    data = rows(600)
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "123 %$ \n", None), (1003, "the of and " * 30000, None), (1003, "the of and " * 30000, None)]
    docs = spark.createDataFrame([(i, t, lang, 1.0) for i, t, lang in [r[:3] for r in data] + odd], "doc_id long, text string, lang string, score double").repartition(3)
    model = langid.train(docs)
    assert len(model.groups) == 2 and sorted(sum(model.groups, [])) == sorted(WORDS)
    got = langid.identify(docs, model).withColumn("held", langid.held_out()).collect()
    want = {r[0]: r[2] for r in data}
    held = [r for r in got if r.held and r.doc_id < 1000]
    assert len(held) > 80 and sum(r.lang_pred == want[r.doc_id] for r in held) >= 0.97 * len(held)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1000, 1001, 1002)) and by[1003].lang_pred == "en"
    assert len(got) == len(data) + len(odd) and all(0 <= r.score <= 1 for r in got)


def test_language_id_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.identify(docs, langid.train(docs)).collect()] == ["und"]
    assert langid.identify(docs.limit(0), langid.train(docs.limit(0))).count() == 0


def test_toxicity(spark):
    data = rows(1600, 2)
    odd = [(9000, None, None), (9001, "", "en"), (9002, "badword " * 40000, "en"), (9003, "BADWORD", "xx"), (9003, "BADWORD", "xx")]
    docs = spark.createDataFrame([(i, t, lang, 1) for i, t, lang in [r[:3] for r in data] + odd], "doc_id long, text string, lang string, toxic int").repartition(3)
    labels = spark.createDataFrame([(r[0], r[3], 1, "x") for r in data] + [(9001, None, 0, "x")], "doc_id long, toxic int, quality int, text string")
    got = toxicity.score(docs, toxicity.train(docs, labels)).withColumn("held", langid.held_out("doc_id", 4, 2)).collect()
    want = {r[0]: r[3] for r in data}
    held = [r for r in got if r.held and r.doc_id < 9000]
    assert len(held) > 300 and sum(r.predicted == want[r.doc_id] for r in held) >= 0.95 * len(held)
    by = {r.doc_id: r for r in got}
    assert by[9000].predicted == by[9001].predicted == 0 and by[9002].predicted == by[9003].predicted == 1
    assert len(got) == len(data) + len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity.score(docs, toxicity.train(docs, none)).collect()] == [0]
