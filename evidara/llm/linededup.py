"""Reversible incremental line dedup (operator 10).

Lines are keyed by two unrelated hashes of 62 bits and dealt over shards, whose number follows that of the keys. A shard
has two cuckoo filters: of the keys that it holds, by which new keys are told without a look at the
exact table, and of the keys that are repeated, by which the references that may lose lines are told. Exact
are the references (key, document, lines) and the counts per key that they add up to; whatever a filter
answers "maybe" is asked of them. A document is taken back by taking its references out, which restores filters,
counts and every later decision.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import BYTES, BYTES2, IS_SPACE, LOWER, chunks, mix, signed
from .scratch import materialize, small_batches

MIN_CHARS, MIN_DOCS = 20, 3
#: Keys that a shard holds at most on average, and the least number of shards. Beyond, the filters are built anew from the counts over more shards.
SHARD_KEYS, LEAST_SHARDS = 500_000, 64
FILTERS = "shard int, kind int, blob binary, overflow array<long>"
HELD, REPEATED = 0, 1
#: Filters up to this size are sent to all tasks; larger ones stream with what they are asked.
SENT_BYTES = 32 << 20
#: Rows that are asked of a shard in one stream, about.
STREAM_ROWS = 4_000_000
REFS = "h1 long, h2 long, doc_id long, n_lines long"


class CuckooFilter:
    """16-bit fingerprints in buckets of four, two buckets a key; holds, inserts and deletes keys given as uint64.

    Keys that find no room after ``KICKS`` moves go to an exact overflow set, so nothing is lost.
    """

    SLOTS, KICKS = 4, 200

    def __init__(self, capacity: int):
        self.buckets = 1 << max(2, int(np.ceil(np.log2(max(1, capacity) / (self.SLOTS * 0.85)))))
        self.table = np.zeros((self.buckets, self.SLOTS), dtype=np.uint16)
        self.overflow: set[int] = set()

    def _where(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        finger = (keys >> np.uint64(48)).astype(np.uint16)
        finger[finger == 0] = 1
        first = (keys & np.uint64(self.buckets - 1)).astype(np.int64)
        return finger, first, first ^ self._step(finger)

    def _step(self, finger: np.ndarray) -> np.ndarray:
        return (mix(finger.astype(np.uint64)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        finger, a, b = self._where(keys)
        found = (self.table[a] == finger[:, None]).any(axis=1) | (self.table[b] == finger[:, None]).any(axis=1)
        return found | np.isin(keys, np.fromiter(self.overflow, dtype=np.uint64, count=len(self.overflow))) if self.overflow else found

    def insert(self, keys: np.ndarray) -> None:
        """Insert distinct keys that are not held yet: whole rounds of free slots first, then single moves."""
        finger, a, b = self._where(keys)
        left = np.arange(len(keys))
        for bucket in (a, b):
            for slot in range(self.SLOTS):
                if not len(left):
                    return
                free = left[self.table[bucket[left], slot] == 0]
                _, one = np.unique(bucket[free], return_index=True)
                won = free[one]
                self.table[bucket[won], slot] = finger[won]
                left = np.setdiff1d(left, won, assume_unique=True)
        rng = np.random.default_rng(len(keys))
        for i in left:
            self._kick(int(keys[i]), finger[i], int(a[i]), rng)

    def _kick(self, key: int, finger: np.uint16, at: int, rng: np.random.Generator) -> None:
        moved = []
        for _ in range(self.KICKS):
            empty = np.flatnonzero(self.table[at] == 0)
            if len(empty):
                self.table[at, empty[0]] = finger
                return
            slot = int(rng.integers(self.SLOTS))
            moved.append((at, slot, finger))
            finger, self.table[at, slot] = self.table[at, slot], finger
            at ^= int(self._step(np.array([finger]))[0])
        for at, slot, put in reversed(moved):  # undo, then keep the key aside
            finger, self.table[at, slot] = self.table[at, slot], finger
        self.overflow.add(key)

    def delete(self, keys: np.ndarray) -> None:
        """Take out distinct keys that are held."""
        finger, a, b = self._where(keys)
        for i in range(len(keys)):
            if int(keys[i]) in self.overflow:
                self.overflow.discard(int(keys[i]))
                continue
            for at in (a[i], b[i]):
                hit = np.flatnonzero(self.table[at] == finger[i])
                if len(hit):
                    self.table[at, hit[0]] = 0
                    break


def line_keys(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text: both hashes of its lines' keys, and the keys' code points."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    b = LOWER[np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)]
    end = np.flatnonzero(b == 10)
    start = np.append(0, end[:-1] + 1)
    solid = np.flatnonzero(~IS_SPACE[b])
    lo, hi = np.searchsorted(solid, start), np.searchsorted(solid, end)
    some = hi > lo
    solid = np.append(solid, 0)
    first, last = np.where(some, solid[lo], start), np.where(some, solid[np.maximum(hi, 1) - 1] + 1, start)
    points = np.append(0, np.cumsum((b & 0xC0) != 0x80))
    h1, h2 = BYTES.spans(b, first, last), BYTES2.spans(b, first, last)
    cut = np.searchsorted(end, np.cumsum([len(r) + 1 for r in raw]) - 1) + 1
    return [(h1[s:e], h2[s:e], points[last[s:e]] - points[first[s:e]]) for s, e in zip(np.append(0, cut[:-1]), cut, strict=True)]


def references(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per key of at least ``min_chars`` code points and row of docs that has it."""

    def run(batches):
        for pdf in batches:
            for part in chunks(pdf, most=500_000):
                rows = []
                for doc_id, (h1, h2, n) in zip(part["doc_id"], line_keys(part["text"].tolist()), strict=True):
                    long = n >= min_chars
                    if long.any():
                        order = np.lexsort((h2[long], h1[long]))
                        x, y = h1[long][order], h2[long][order]
                        at = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
                        rows.append((signed(x[at]), signed(y[at]), np.full(len(at), doc_id, dtype=np.int64), np.diff(np.append(at, len(x)))))
                if rows:
                    yield pd.DataFrame(dict(zip(["h1", "h2", "doc_id", "n_lines"], map(np.concatenate, zip(*rows, strict=True)), strict=True)))

    small_batches(docs.sparkSession)
    return docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInPandas(run, REFS)


def _distinct(refs: DataFrame) -> DataFrame:
    """One row per key and document, whatever rows repeat its id."""
    return refs.groupBy("h1", "h2", "doc_id").agg(F.sum("n_lines").alias("n_lines"))


def _counts(refs: DataFrame) -> DataFrame:
    """Documents and largest document of each key of distinct references; partial sums are made before the shuffle, so a hot key is small."""
    return refs.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))


def shards_for(keys: int) -> int:
    """A power of two that leaves at most SHARD_KEYS to a shard."""
    return max(LEAST_SHARDS, 1 << max(0, -(-keys // SHARD_KEYS) - 1).bit_length())


class LineIndex:
    """References, counts per key, and two cuckoo filters a shard, as tables; every change makes a new index.

    ``room``: held and repeated keys that the filters have room for, twice those that they were built with. An index that
    outgrows it or its shards builds its filters anew from the counts.
    """

    def __init__(self, refs: DataFrame, counts: DataFrame, keys: int, shards: int, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, filters: DataFrame | None = None, room: tuple[int, int] | None = None):
        self.refs, self.counts, self.keys, self.shards, self.min_chars, self.min_docs, self._filters = refs, counts, keys, shards, min_chars, min_docs, filters
        self.n_repeated = counts.filter(self._repeats()).count()
        self.room = room or (2 * keys, 2 * self.n_repeated)

    @classmethod
    def build(cls, docs: DataFrame, shards: int | None = None, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> "LineIndex":
        refs = materialize(_distinct(references(docs, min_chars)), "line-refs")
        counts = materialize(_counts(refs), "line-counts")
        keys = counts.count()
        return cls(refs, counts, keys, shards or shards_for(keys), min_chars, min_docs)

    def _shard(self):
        return F.pmod(F.col("h1"), F.lit(self.shards)).cast("int").alias("shard")

    def _repeats(self):
        return F.col("n_docs") >= self.min_docs

    @property
    def filters(self) -> DataFrame:
        """shard, kind, blob of the filter's table, overflow keys; a shard holds SHARD_KEYS keys or so, a hot key counts once."""
        if self._filters is None:
            kinds = F.explode(F.when(self._repeats(), F.array(F.lit(HELD), F.lit(REPEATED))).otherwise(F.array(F.lit(HELD)))).alias("kind")
            keyed = self.counts.select(self._shard(), kinds, "h1", "h2")
            self._filters = materialize(keyed.groupBy("shard", "kind").applyInPandas(_build_filter, FILTERS), "line-filters")
        return self._filters

    def add(self, docs: DataFrame) -> "LineIndex":
        """The index with the rows of docs. Keys that the filters do not hold are new without a look at the counts, the
        others are asked of them; a reference that the index has already changes nothing."""
        fresh = _distinct(references(docs, self.min_chars)).join(self.refs.select("h1", "h2", "doc_id"), ["h1", "h2", "doc_id"], "left_anti")
        fresh = materialize(fresh, "line-refs")
        asked = materialize(self.seen(_counts(fresh).withColumnRenamed("n_docs", "more").withColumnRenamed("last_doc", "late")), "line-asked")
        old = self.counts.join(asked.filter("maybe").select("h1", "h2", "more", "late"), ["h1", "h2"])
        old = materialize(old, "line-known")
        new = asked.join(old.select("h1", "h2"), ["h1", "h2"], "left_anti").select("h1", "h2", F.col("more").alias("n_docs"), F.col("late").alias("last_doc"))
        grown = old.select("h1", "h2", (F.col("n_docs") + F.col("more")).alias("n_docs"), F.greatest("last_doc", "late").alias("last_doc"))
        counts = self.counts.join(old.select("h1", "h2"), ["h1", "h2"], "left_anti").unionByName(grown).unionByName(new)
        counts, keys = materialize(counts, "line-counts"), self.keys + new.count()
        refs = self.refs.unionByName(fresh)
        crossed = old.filter(~self._repeats() & (F.col("n_docs") + F.col("more") >= self.min_docs)).select("h1", "h2").unionByName(new.filter(self._repeats()).select("h1", "h2"))
        if shards_for(keys) > self.shards or keys > self.room[0] or self.n_repeated + crossed.count() > self.room[1]:
            return LineIndex(refs, counts, keys, max(self.shards, shards_for(keys)), self.min_chars, self.min_docs)
        filters = self._changed((new.select("h1", "h2"), HELD, True), (crossed, REPEATED, True))
        return LineIndex(refs, counts, keys, self.shards, self.min_chars, self.min_docs, filters, self.room)

    def remove(self, doc_ids: DataFrame) -> "LineIndex":
        """The index without the documents whose ids are given; keys that no document holds leave the filters."""
        ids = doc_ids.select("doc_id").distinct()
        kept = materialize(self.refs.join(ids, "doc_id", "left_anti"), "line-refs")
        touched = self.refs.join(ids, "doc_id", "left_semi").select("h1", "h2").distinct()
        old = materialize(self.counts.join(touched, ["h1", "h2"], "left_semi"), "line-known")
        now = materialize(_counts(kept.join(old.select("h1", "h2"), ["h1", "h2"], "left_semi")), "line-counts")
        counts = materialize(self.counts.join(old.select("h1", "h2"), ["h1", "h2"], "left_anti").unionByName(now), "line-counts")
        gone = old.join(now.select("h1", "h2"), ["h1", "h2"], "left_anti").select("h1", "h2")
        fell = old.filter(self._repeats()).join(now.filter(self._repeats()).select("h1", "h2"), ["h1", "h2"], "left_anti").select("h1", "h2")
        filters = self._changed((gone, HELD, False), (fell, REPEATED, False))
        return LineIndex(kept, counts, self.keys - gone.count(), self.shards, self.min_chars, self.min_docs, filters, self.room)

    def _changed(self, *changes: tuple[DataFrame, int, bool]) -> DataFrame:
        """The filters with distinct keys put in that are not held, or taken out that are."""

        def change(key, old: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
            f = _filter(old["blob"].iloc[0], old["overflow"].iloc[0]) if len(old) else None
            if len(keys):
                h, put = _mixed(keys), keys["put"].to_numpy(dtype=bool)
                f = f or CuckooFilter(2 * int(put.sum()))
                f.delete(h[~put])
                f.insert(h[put])
            return _row(*key, f)

        rows = [keys.select(self._shard(), F.lit(kind).alias("kind"), "h1", "h2", F.lit(put).alias("put")) for keys, kind, put in changes]
        keyed = rows[0].unionByName(rows[1])
        return materialize(self.filters.groupBy("shard", "kind").cogroup(keyed.groupBy("shard", "kind")).applyInPandas(change, FILTERS), "line-filters")

    def _asked(self, rows: DataFrame, kind: int) -> DataFrame:
        """rows (h1, h2, ...) with ``maybe``, what the filters of a kind answer; false: the key was never put in."""
        filters = self.filters.filter(F.col("kind") == kind).select("shard", "blob", "overflow")
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", maybe boolean"
        size, shards, names = filters.agg(F.sum(F.octet_length("blob"))).first()[0] or 0, self.shards, rows.columns
        if size <= SENT_BYTES:
            sent = rows.sparkSession.sparkContext.broadcast({r["shard"]: (bytes(r["blob"]), r["overflow"]) for r in filters.collect()})

            def probe(batches):
                held = {k: _filter(*v) for k, v in sent.value.items()}
                for pdf in batches:
                    shard, keys, maybe = pdf["h1"].to_numpy(dtype=np.int64) % shards, _mixed(pdf), np.zeros(len(pdf), dtype=bool)
                    for k in np.unique(shard):
                        if k in held:
                            maybe[shard == k] = held[k].contains(keys[shard == k])
                    yield pdf.assign(maybe=maybe)

            return rows.mapInPandas(probe, schema)
        # Each stream has a shard's filter first, then some of the rows that are asked of it.
        streams = -(-rows.count() // (STREAM_ROWS * shards)) + 1
        salt = F.pmod(F.xxhash64(*names), F.lit(streams)).cast("int").alias("salt")
        empty = [F.lit(0).cast(f.dataType).alias(f.name) for f in rows.schema]
        left = filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(streams - 1))).alias("salt"), F.lit(0).alias("role"), "blob", "overflow", *empty)
        right = rows.select(self._shard(), salt, F.lit(1).alias("role"), F.lit(None).cast("binary").alias("blob"), F.lit(None).cast("array<long>").alias("overflow"), *names)
        both = left.unionByName(right).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "role")

        def stream(batches):
            at, held = None, None
            for pdf in batches:
                for (shard, salt), part in pdf.groupby(["shard", "salt"], sort=True):
                    if at != (shard, salt):
                        at, held = (shard, salt), None
                    if part["role"].iloc[0] == 0:
                        held = _filter(part["blob"].iloc[0], part["overflow"].iloc[0])
                    asked = part[part["role"] == 1][names]
                    if len(asked):
                        yield asked.assign(maybe=held.contains(_mixed(asked)) if held else False)

        return both.mapInPandas(stream, schema)

    def seen(self, keys: DataFrame) -> DataFrame:
        """keys (h1, h2, ..., all long) with ``maybe``: false where the shard's filter says that the index does not hold the key."""
        return self._asked(keys, HELD)

    def repeated(self) -> DataFrame:
        """Keys in at least ``min_docs`` documents, with the document that keeps its lines."""
        return self.counts.filter(self._repeats()).select("h1", "h2", "last_doc")

    def decide(self) -> DataFrame:
        """doc_id and the hashes (lost1, lost2) of the keys that it loses.

        References meet the filters of repeated keys, and only what passes is joined with the exact counts.
        """
        maybe = self._asked(self.refs, REPEATED).filter("maybe").drop("maybe")
        lost = maybe.join(self.repeated(), ["h1", "h2"]).filter(F.col("doc_id") != F.col("last_doc"))
        lost = lost.groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias("lost"))
        return lost.select("doc_id", F.col("lost.h1").alias("lost1"), F.col("lost.h2").alias("lost2"))


def _mixed(pdf: pd.DataFrame) -> np.ndarray:
    """The 64 bits of both hashes by which a filter knows a key."""
    h1, h2 = (pdf[c].to_numpy(dtype=np.int64).view(np.uint64) for c in ("h1", "h2"))
    return mix(h1 ^ mix(h2))


def _filter(blob: bytes, overflow) -> CuckooFilter:
    f = CuckooFilter(1)
    f.table = np.frombuffer(blob, dtype=np.uint16).reshape(-1, CuckooFilter.SLOTS).copy()
    f.buckets = len(f.table)
    f.overflow = {int(np.int64(k).view(np.uint64)) for k in overflow}
    return f


def _row(shard: int, kind: int, f: CuckooFilter) -> pd.DataFrame:
    return pd.DataFrame({"shard": [shard], "kind": [kind], "blob": [f.table.tobytes()], "overflow": [[int(np.uint64(k).view(np.int64)) for k in f.overflow]]})


def _build_filter(pdf: pd.DataFrame) -> pd.DataFrame:
    keys = _mixed(pdf)
    f = CuckooFilter(2 * len(keys))
    f.insert(keys)
    return _row(pdf["shard"].iloc[0], pdf["kind"].iloc[0], f)


def _held(keys: np.ndarray, others: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether the pairs (keys, others) are among the pairs (one, two)."""
    pairs = set(zip(one.tolist(), two.tolist(), strict=True))
    near = np.isin(keys, one)
    near[near] = [p in pairs for p in zip(keys[near].tolist(), others[near].tolist(), strict=True)]
    return near


def clean(docs: DataFrame, index: LineIndex, text: bool = True) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 and, if asked, the kept text of every row of docs.

    Lines end at \\n alone; a null or empty text is one empty line. A line whose key has at least
    min_chars code points and stands in at least the index's ``min_docs`` documents goes, except from the largest
    doc_id that has it, which keeps all of them. Rows that repeat a doc_id are one document, and each gives
    a row; rows without doc_id are left out. Other columns are
    ignored; an empty table gives no rows.
    """
    rows, lost = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text"), index.decide()
    joined, min_chars = rows.join(lost, "doc_id", "left"), index.min_chars

    def run(batches):
        for pdf in batches:
            for part in chunks(pdf, most=500_000):
                rows = []
                hit = [i for i, x in enumerate(part["lost1"]) if x is not None]
                keys = dict(zip(hit, line_keys([part["text"].iloc[i] for i in hit]), strict=True)) if hit else {}
                for i, (doc_id, t, drop) in enumerate(zip(part["doc_id"], part["text"], zip(part["lost1"], part["lost2"], strict=True), strict=True)):
                    t = t or ""
                    lines = t.split("\n") if i in keys else None
                    n = len(lines) if lines else t.count("\n") + 1
                    if lines:
                        h1, h2, points = keys[i]
                        stay = ~(_held(signed(h1), signed(h2), *drop) & (points >= min_chars))
                        t = "\n".join([x for x, keep in zip(lines, stay, strict=True) if keep])
                        rows.append((doc_id, n, int(n - stay.sum()), t))
                    else:
                        rows.append((doc_id, n, 0, t))
                out = pd.DataFrame(rows, columns=["doc_id", "n_lines", "n_dropped", "kept"])
                out["kept_sha256"] = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in out["kept"]]
                yield out if text else out.drop(columns="kept")

    return joined.mapInPandas(run, f"doc_id long, n_lines long, n_dropped long{', kept string' if text else ''}, kept_sha256 string")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return clean(docs, LineIndex.build(docs), text=False)


_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT doc_id, line, pos, {_LOWER.format(f'trim(line, {_SPACE})')} AS key FROM split),
hot AS (SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= {MIN_CHARS}
        GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
judged AS (SELECT k.*, h.key IS NOT NULL AND h.last_doc <> k.doc_id AS dropped FROM keyed k LEFT JOIN hot h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
QUERIES = {"op10_line_dedup": op10_line_dedup}
ORACLES = {"op10_line_dedup": SQL}
