"""Convolutional toxicity classifier (operator 7), trained in numpy.

Each word is the mean of hashed embeddings of the word and of its first four and six bytes. Filters of
several widths slide over the words, each keeps its maximum over the whole text, and a logistic
layer scores the maxima. Scores are calibrated on validation rows, thresholds by language.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import BYTES, Batch, chunks
from .langid import held_out, smallest_hashes
from .scratch import small_batches

ROWS = 1 << 16
EMBED, FILTERS, WIDTHS = 16, 12, (1, 2, 3)
PARTS = (1 << 30, 4, 6)
#: Bound on the labelled rows, per label, that the model is fitted on.
SAMPLE_PER_LABEL = 2000
THRESHOLD = 0.3
#: Small samples are gone through until so many steps are made.
MIN_STEPS = 200
PAD = max(WIDTHS) - 1


def word_ids(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of every word (n, 3), PAD rows of zeros after each text; and each text's start."""
    batch = Batch(texts, lower=True)
    start, end, first = batch.words()
    ids = np.stack([1 + k * (ROWS // 4) + (BYTES.spans(batch.bytes, start, np.minimum(end, start + n)) % np.uint64(ROWS // 4)).astype(np.int64) for k, n in enumerate(PARTS)], axis=1)
    starts = first + PAD * np.arange(len(first))
    out = np.zeros((starts[-1], len(PARTS)), dtype=np.int32)
    out[np.arange(len(ids)) + PAD * np.repeat(np.arange(len(texts)), np.diff(first))] = ids
    return out, starts


class Model:
    """Embedding table, filters per width, logistic layer, and calibration."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.table = (rng.normal(size=(ROWS, EMBED)) * 0.3).astype(np.float32)
        self.table[0] = 0
        self.filters = [(rng.normal(size=(w * EMBED, FILTERS)) / np.sqrt(w * EMBED)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, dtype=np.float32)
        self.out = (rng.normal(size=len(WIDTHS) * FILTERS) * 0.1).astype(np.float32)
        self.out_bias = np.zeros(1, dtype=np.float32)
        self.scale, self.shift = 1.0, 0.0
        self.thresholds: dict[str, float] = {}

    def maps(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word vectors, and all filter responses at each position; PAD keeps a filter from running from word to word over an end."""
        x = self.table[ids[:, 0]]
        for k in range(1, len(PARTS)):
            x = x + self.table[ids[:, k]]
        z = np.zeros((len(x), len(self.bias)), dtype=np.float32)
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            for j in range(w):
                z[: len(x) - j, k * FILTERS : (k + 1) * FILTERS] += x[j:] @ f[j * EMBED : (j + 1) * EMBED]
        return x, z

    def logits(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        _, z = self.maps(ids)
        pooled = np.maximum(np.maximum.reduceat(z, starts[:-1], axis=0) + self.bias, 0)
        return pooled @ self.out + self.out_bias[0]

    def scores(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        raw = self.scale * self.logits(ids, starts).astype(np.float64) + self.shift
        return 1 / (1 + np.exp(-np.clip(raw, -35, 35)))

    def step(self, ids: np.ndarray, starts: np.ndarray, y: np.ndarray, adam: "Adam") -> None:
        x, z = self.maps(ids)
        top = np.maximum.reduceat(z, starts[:-1], axis=0)
        doc = np.repeat(np.arange(len(y)), np.diff(starts))
        where = np.where(z == top[doc], np.arange(len(z))[:, None], len(z))
        at = np.minimum.reduceat(where, starts[:-1], axis=0)
        pooled = np.maximum(top + self.bias, 0)
        p = 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.out_bias[0], -30, 30)))
        d = ((p - y) / len(y)).astype(np.float32)
        d_pool = d[:, None] * self.out * (pooled > 0)
        grads = {"out": pooled.T @ d, "out_bias": d.sum(keepdims=True), "bias": d_pool.sum(axis=0)}
        touched, change = [], []
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            own = slice(k * FILTERS, (k + 1) * FILTERS)
            g, a = d_pool[:, own].ravel(), at[:, own].ravel()
            which = np.tile(np.arange(FILTERS), len(y))
            live = g != 0
            g, a, which = g[live], a[live], which[live]
            grad = np.zeros_like(f)
            for j in range(w):
                pos = np.minimum(a + j, len(x) - 1)
                for c in range(FILTERS):
                    m = which == c
                    grad[j * EMBED : (j + 1) * EMBED, c] = g[m] @ x[pos[m]]
                touched.append(ids[pos].ravel())
                change.append(np.repeat(g[:, None] * f[j * EMBED : (j + 1) * EMBED, which].T, len(PARTS), axis=0))
            grads[f"f{k}"] = grad
        rows, inverse = np.unique(np.concatenate(touched), return_inverse=True)
        dense = np.zeros((len(rows), EMBED), dtype=np.float32)
        np.add.at(dense, inverse, np.concatenate(change))
        dense[rows == 0] = 0
        adam.tick()
        for k in range(len(WIDTHS)):
            adam.apply(self.filters[k], grads.pop(f"f{k}"), f"f{k}")
        for name, g in grads.items():
            adam.apply(getattr(self, name), g, name)
        adam.apply(self.table, dense, "table", rows)


class Adam:
    def __init__(self, rate: float = 0.01):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def tick(self) -> None:
        self.t += 1

    def apply(self, value: np.ndarray, grad: np.ndarray, name: str, rows=slice(None)) -> None:
        m, v = self.m.setdefault(name, np.zeros_like(value)), self.v.setdefault(name, np.zeros_like(value))
        m[rows] = 0.9 * m[rows] + 0.1 * grad
        v[rows] = 0.99 * v[rows] + 0.01 * grad * grad
        value[rows] -= self.rate * (m[rows] / (1 - 0.9**self.t)) / (np.sqrt(v[rows] / (1 - 0.99**self.t)) + 1e-6)


def best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The middle of the gap around the cut with the best weighted F1."""
    order = np.argsort(-p, kind="stable")
    p, y, weight = p[order], y[order], weight[order]
    hit, all_ = np.cumsum(weight * y), np.cumsum(weight)
    f1 = 2 * hit / (all_ + (weight * y).sum())
    f1[:-1][p[:-1] == p[1:]] = -1
    k = int(f1.argmax())
    return float((p[k] + (p[k + 1] if k + 1 < len(p) else 0.0)) / 2)


def fit(ids: list[np.ndarray], y: np.ndarray, langs: list[str], negative_weight: float, epochs: int = 6, batch: int = 64, seed: int = 0) -> Model:
    """Train on three quarters of the rows, calibrate on the rest.

    ``negative_weight`` is how many clean rows of the corpus a clean row of the sample stands for,
    against one for a toxic row. Calibration maps the best cut to THRESHOLD.
    """
    model, adam, rng = Model(seed), Adam(), np.random.default_rng(seed)
    if not len(y) or y.min() == y.max():
        model.out[:], model.out_bias[:] = 0, (-3 if not len(y) or y[0] == 0 else 3)
        return model

    def join(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([ids[i] for i in which]), np.append(0, np.cumsum([len(ids[i]) for i in which]))

    order = rng.permutation(len(y))
    valid, learn = order[: len(y) // 4], order[len(y) // 4 :]
    for _ in range(max(epochs, -(-MIN_STEPS * batch // len(learn)))):
        rng.shuffle(learn)
        for k in range(0, len(learn), batch):
            model.step(*join(learn[k : k + batch]), y[learn[k : k + batch]], adam)
    raw = np.concatenate([model.logits(*join(valid[k : k + batch])) for k in range(0, len(valid), batch)]).astype(np.float64)
    weight = np.where(y[valid] > 0, 1.0, negative_weight)
    a, b = 1.0, 0.0
    for _ in range(200):  # Platt scaling by gradient steps
        g = (1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30))) - y[valid]) * weight / weight.sum()
        a, b = a - 2.0 * (g * raw).sum() / max(1.0, raw.var()), b - 2.0 * g.sum()
    model.scale, model.shift = max(a, 0.05), b
    p = 1 / (1 + np.exp(-np.clip(model.scale * raw + b, -35, 35)))
    cut = np.clip(best_threshold(p, y[valid], weight), 1e-6, 1 - 1e-6)
    model.shift += np.log(THRESHOLD / (1 - THRESHOLD)) - np.log(cut / (1 - cut))
    p = 1 / (1 + np.exp(-np.clip(model.scale * raw + model.shift, -35, 35)))
    names = np.array([langs[i] or "" for i in valid])
    for lang in sorted(set(names)):
        own = names == lang
        if y[valid][own].sum() >= 20:
            model.thresholds[lang] = best_threshold(p[own], y[valid][own], weight[own])
    return model


def train(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, folds: int = 4, fold: int = 2) -> Model:
    """Fit on at most ``per_label`` rows of each label outside the held-out fold; the labels' rates are counted over all rows."""
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", folds, fold)).select("doc_id", "toxic").dropDuplicates(["doc_id"])
    count = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    chosen = {r["doc_id"]: r["toxic"] for r in smallest_hashes(usable, "toxic", count, per_label).collect()}
    if not chosen:
        return fit([], np.zeros(0), [], 1.0)
    rows = docs.filter(F.col("doc_id").isin(list(chosen))).select("doc_id", "text", "lang").dropDuplicates(["doc_id"])

    def run(batches):
        for pdf in batches:
            for part in chunks(pdf, most=500_000):
                ids, starts = word_ids(part["text"].tolist())
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "lang": part["lang"].to_numpy(), "ids": [ids[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]})

    got = sorted(rows.mapInPandas(run, "doc_id long, lang string, ids binary").collect(), key=lambda r: r["doc_id"])
    y = np.array([chosen[r["doc_id"]] for r in got], dtype=np.float32)
    rate = {k: count.get(k, 0) / max(1, (y == k).sum()) for k in (0, 1)}
    ids = [np.frombuffer(r["ids"], dtype=np.int32).reshape(-1, len(PARTS)) for r in got]
    return fit(ids, y, [r["lang"] for r in got], rate[0] / max(rate[1], 1e-9))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted for every row, from its whole text alone; flagged by the language's own threshold.

    A null or empty text is scored as a text without words. Rows without doc_id are left out, repeated rows are scored each; an empty
    table gives no rows. ``flagged`` reads lang only to choose a threshold (THRESHOLD if it has none).
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for pdf in batches:
            for part in chunks(pdf, most=500_000):
                p = m.scores(*word_ids(part["text"].tolist()))
                cut = np.array([m.thresholds.get(x or "", THRESHOLD) for x in part["lang"]])
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "score": p, "predicted": (p >= THRESHOLD).astype(np.int32), "flagged": p >= cut})

    return docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text", "lang").mapInPandas(run, "doc_id long, score double, predicted int, flagged boolean")


def op7_convolutional_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score(docs, train(docs, labels))
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted", "flagged")


QUERIES = {"op7_convolutional_toxicity": op7_convolutional_toxicity}
ORACLES: dict[str, str] = {}
