"""Hierarchical language identification (operator 8).

Languages are grouped into families by the likeness of their training centroids. A linear
support vector machine per family, one against the rest, picks the family; inside it, one
against one machines vote. Features are hashed byte 2- and 3-grams of the whole text.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .hashing import Batch, chunks
from .scratch import small_batches

DIM = 1 << 14
#: Bound on the rows that the classifier is fitted on, shared evenly by the languages; but LEAST_OF_EACH of every language.
SAMPLE_ROWS, LEAST_OF_EACH = 2000, 5
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")


def features(texts: list[str | None], dim: int = DIM) -> np.ndarray:
    """L2-normed log counts of hashed byte 2- and 3-grams, one row a text."""
    batch = Batch(texts, lower=True)
    b = batch.bytes.astype(np.uint32)
    doc = np.repeat(np.arange(len(texts), dtype=np.int64) * dim, batch.sizes + 1)
    out = np.zeros(len(texts) * dim, dtype=np.float32)
    shift = np.uint32(32 - (dim - 1).bit_length())
    for n, seed in ((2, 0x9E3779B1), (3, 0x85EBCA77)):
        if len(b) < n:
            continue
        gram = b[: len(b) - n + 1] + np.uint32(n << 24)
        for k in range(1, n):
            gram = gram | (b[k : len(b) - n + 1 + k] << np.uint32(8 * k))
        slot = ((gram * np.uint32(seed)) ^ (gram >> np.uint32(7))) * np.uint32(0xC2B2AE3D) >> shift
        same = doc[: len(gram)] == doc[n - 1 :]
        out += np.bincount((doc[: len(gram)] + slot)[same], minlength=len(out))
    rows = np.log1p(out.reshape(len(texts), dim))
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


class Sparse:
    """Rows of few features: x of row and feature ``at``, for the products that ``linear_svm`` takes. A dense sample would be most of the driver's memory."""

    def __init__(self, row: np.ndarray, at: np.ndarray, x: np.ndarray, shape: tuple[int, int]):
        self.row, self.at, self.x, self.shape = row, at, x, shape

    def __getitem__(self, rows: np.ndarray) -> Sparse:
        own = rows[self.row]
        return Sparse((rows.cumsum(dtype=np.int32) - 1)[self.row[own]], self.at[own], self.x[own], (int(rows.sum()), self.shape[1]))

    def __matmul__(self, z: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.x * z[self.at], self.shape[0]).astype(np.float32)

    @property
    def T(self) -> Sparse:
        return Sparse(self.at, self.row, self.x, self.shape[::-1])

    def mean(self, axis: int = 0) -> np.ndarray:
        """Of the columns."""
        return self.T @ np.full(self.shape[0], 1 / max(1, self.shape[0]), dtype=np.float32)


def linear_svm(x: np.ndarray | Sparse, y: np.ndarray, steps: int = 60, reg: float = 1e-3) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by accelerated full gradients; y holds +1 and -1, classes weigh the same."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = z = np.zeros(x.shape[1] + 1, dtype=np.float32)
    rate, t = 1 / (4 + reg), 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ z[:-1] + z[-1])) * y * weight
        new = z + rate * 2 * np.append(x.T @ slack - reg * z[:-1] / 2, slack.sum()).astype(np.float32)
        t, was = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        w, z = new, new + np.float32((was - 1) / t) * (new - w)
    return w[:-1], float(w[-1])


def families(centroids: dict[str, np.ndarray]) -> list[list[str]]:
    """Average-linkage groups of languages, about the square root of their number."""
    groups = [[k] for k in sorted(centroids)]
    while len(groups) > max(2, round(len(centroids) ** 0.5)):
        near = lambda a, b: np.mean([centroids[p] @ centroids[q] for p in a for q in b])
        i, j = max(combinations(range(len(groups)), 2), key=lambda ij: near(groups[ij[0]], groups[ij[1]]))
        groups[i] += groups.pop(j)
    return groups


class Model:
    """Family machines, then pair machines; ``predict`` takes feature rows."""

    def __init__(self, x: np.ndarray | Sparse, langs: list[str]):
        y = np.array(langs)
        self.langs = sorted(set(langs))
        self.groups = families({k: x[y == k].mean(axis=0) for k in self.langs}) if langs else []
        columns, self.pairs = [], []
        for g in self.groups if len(self.groups) > 1 else []:
            columns.append(linear_svm(x, np.where(np.isin(y, g), 1.0, -1.0).astype(np.float32)))
        for k, g in enumerate(self.groups):
            for a, b in combinations(sorted(g), 2):
                own = (y == a) | (y == b)
                columns.append(linear_svm(x[own], np.where(y[own] == a, 1.0, -1.0).astype(np.float32)))
                self.pairs.append((k, a, b))
        self.w = np.array([w for w, _ in columns], dtype=np.float32).reshape(len(columns), x.shape[1])
        self.b = np.array([b for _, b in columns], dtype=np.float32)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        margin = x @ self.w.T + self.b
        n = len(self.groups) if len(self.groups) > 1 else 0
        family = margin[:, :n].argmax(axis=1) if n else np.zeros(len(x), dtype=int)
        prob = 1 / (1 + np.exp(-4.0 * margin))
        score = prob[np.arange(len(x)), family] if n else np.ones(len(x))
        name = []
        for i, k in enumerate(family):
            own = sorted(self.groups[k])
            votes = {a: 0.0 for a in own}
            sure = {a: [1.0] for a in own}
            for j, (g, a, b) in enumerate(self.pairs):
                if g == k:
                    p = prob[i, n + j]
                    votes[a if p >= 0.5 else b] += 1
                    votes[a] += 1e-3 * p
                    votes[b] += 1e-3 * (1 - p)
                    sure[a].append(p)
                    sure[b].append(1 - p)
            best = max(own, key=lambda a: (votes[a], a))
            name.append(best)
            score[i] *= min(sure[best])
        return name, score


def held_out(doc_id: str = "doc_id", folds: int = 5, fold: int = 0):
    """Whether crc32 of the id as text falls into the fold that is never learned from."""
    return F.crc32(F.col(doc_id).cast("string")) % folds == fold


def smallest_hashes(rows: DataFrame, key: str, counts: dict, most: int) -> DataFrame:
    """doc_id and key of the ``most`` rows of each key with the smallest hashes of doc_id.

    ``counts`` holds the number of rows of each key. Rows whose hash is beyond twice the share that is wanted go before the
    rows of a key meet, so a common key is no hot spot.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31))
    limit = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, (2 * most + 50) / n) * (1 << 31)))))[F.col(key)] if counts else F.lit(0)
    few = rows.select("doc_id", key, place.alias("place")).filter(F.col("place") < limit)
    order = Window.partitionBy(key).orderBy("place", "doc_id")
    return few.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most).select("doc_id", key)


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, folds: int = 5, fold: int = 0) -> Model:
    """Fit on about ``sample_rows`` labelled rows outside the held-out fold, spread over all languages.

    Sent to the driver: the languages with their numbers of rows, and the features of the sample. A language with fewer rows than
    its share gives all; every language gives LEAST_OF_EACH if it has them, so many languages make a larger sample. Of rows that repeat a
    doc_id the one with the smallest language and text is learned, whatever their order.
    """
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", folds, fold))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    ids = smallest_hashes(usable, "lang", counts, max(LEAST_OF_EACH, sample_rows // max(1, len(counts))))
    chosen = sorted({r["doc_id"] for r in ids.collect()})
    rows = usable.filter(F.col("doc_id").isin(chosen)).groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("r")).select("r.text", "r.lang") if chosen else None

    def run(batches):
        for pdf in batches:
            for part in chunks(pdf, most=500_000):
                for lang, v in zip(part["lang"], features(part["text"].tolist())):
                    at = np.flatnonzero(v)
                    yield pd.DataFrame({"at": [at.astype("<u2").tobytes()], "x": [v[at].astype(np.float16).tobytes()], "lang": [lang]})

    got = rows.mapInPandas(run, "at binary, x binary, lang string").collect() if rows is not None else []
    got.sort(key=lambda r: (r["lang"], bytes(r["at"]), bytes(r["x"])))
    join = lambda c, kind: np.frombuffer(b"".join(r[c] for r in got), dtype=kind)
    row = np.repeat(np.arange(len(got), dtype=np.int32), [len(r["at"]) // 2 for r in got])
    x = Sparse(row, join("at", "<u2"), join("x", np.float16).astype(np.float32), (len(got), DIM))
    return Model(x, [r["lang"] for r in got])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs, from its whole text alone.

    A null text, or one without a letter, is ``und`` with score 0, as is every text when nothing was
    learned. Rows without doc_id are left out, repeated rows are predicted each; an empty table gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for pdf in batches:
            for part in chunks(pdf, most=500_000):
                texts = part["text"].tolist()
                lang, score = np.full(len(part), UNDETERMINED, dtype=object), np.zeros(len(part))
                letters = np.array([bool(t and _LETTER.search(t)) for t in texts]) & bool(m.langs)
                for at in np.array_split(np.flatnonzero(letters), 1 + letters.sum() // 256):
                    if len(at):
                        name, p = m.predict(features([texts[i] for i in at]))
                        lang[at], score[at] = name, p
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "lang_pred": lang, "score": score})

    return docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInPandas(run, "doc_id long, lang_pred string, score double")


def op8_hierarchical_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs, train(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op8_hierarchical_language_id": op8_hierarchical_language_id}
ORACLES: dict[str, str] = {}
