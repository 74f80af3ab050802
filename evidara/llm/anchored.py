"""Exact removal of windows that were seen before, found by way of anchors.

A mode (words with a difference cover, or bytes with phrase triggers) gives each text its anchors. An anchor has a
key ``a`` of its own content, a key ``u`` of the whole stretch of windows that it owns, and those windows'
starts lo..hi. Every pair of equal windows shares an anchor key, so:

1. one row a stretch is sorted by (a, u, document) and read as a stream: what repeats an earlier document's stretch is
   seen before, and where one a has several stretches the earliest document of each is asked;
2. the asked stretches themselves are sorted by (a, document). Their symbols are compared outward from the anchor:
   sorted once by what stands before it and once by what follows, with the length that neighbours share. A window is a
   piece before and a piece after, so its place in both orders tells its class, and the first row its earliest document.

A chunk of texts sends a stretch once and settles its own repeats, so copies are few rows. Anchors that a sample of the
texts shows to be common are dealt by their stretches, and anchors with over ``WIDE`` stretches send windows one by
one, by the window's content. The sample and the limit decide where rows go, not what is found. Sorts spill; a
stream holds a batch and the stretches of one anchor, at most WIDE.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import U, chunks, mix, signed
from .scratch import materialize, small_batches

BUCKET_BYTES, CHUNK = 4 << 20, 500_000
#: Bytes of text for a partition of stretches, and the most partitions; larger ones spill.
PARTITION_BYTES, MOST_PARTITIONS = 32 << 20, 100_000
#: Texts that are looked at for common anchors, and how often one is met there to be dealt by its stretches.
SAMPLE_BYTES, COMMON = 16 << 20, 64
#: Stretches of one anchor that are compared together.
WIDE = 8192
#: Rows that a stream works on at once.
ROWS, PHRASES = 200_000, 20_000
#: A mark holds a position above POS bits, TAG_BITS of the text's checksum, whether the stretch recurs in its document, how far before the position its windows start (5 bits), and their number less one (5 bits). The bit COMMON_AT says that the anchor is common.
POS, TAG_BITS, AGAIN, COMMON_AT = 31, 20, 10, 62
STRETCHES = "a long, u long, doc long, mark long"
FOUND = "what int, a long, doc long, mark long"
PHRASES_OUT = "a long, doc long, mark long, sym binary"
MASKS = "doc long, mark long, mask long"
SETTLED = -1  # u of a row that its chunk has settled
SEEN, ASK, ASK_WIDE = 0, 1, 2


class Anchors(NamedTuple):
    """Arrays with one value an anchor; doc is a row of the batch, the rest is in units of that row."""

    doc: np.ndarray
    pos: np.ndarray
    a: np.ndarray
    u: np.ndarray
    lo: np.ndarray
    hi: np.ndarray


def place(mark: np.ndarray) -> np.ndarray:
    return (mark & ~(1 << COMMON_AT)) >> POS


def starts_of(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window start of marks."""
    lo = place(mark) - (mark >> 5 & 31)
    return lo, lo + (mark & 31)


def tags(texts) -> np.ndarray:
    """Checksums that tell the texts of a repeated doc_id apart."""
    return np.fromiter((zlib.crc32((t or "").encode("utf-8", "surrogatepass")) & (1 << TAG_BITS) - 1 for t in texts), dtype=np.int64, count=len(texts))


def runs(*keys: np.ndarray) -> np.ndarray:
    """True where a run of equal keys begins."""
    out = np.ones(len(keys[0]), dtype=bool)
    if len(out):
        out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


def spread(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, start) of all the starts lo..hi."""
    n = hi - lo + 1
    return np.repeat(row, n), np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())


def _after(own: np.ndarray, doc: np.ndarray, at: np.ndarray, within: bool) -> np.ndarray:
    """Whether each row comes after the row ``own`` of it; within: also inside that one document."""
    return (doc > doc[own]) | (within & (doc == doc[own]) & (at > at[own]))


def settle(a: np.ndarray, u: np.ndarray, doc: np.ndarray, mark: np.ndarray, within: bool) -> tuple[np.ndarray, ...]:
    """(keep, later, again) over the rows of one chunk, which ascend by document and place: the first of each (a, u), what its document or place comes after, and whether the first recurs in its document."""
    order = np.argsort(a ^ mix(u), kind="stable")
    x, y = a[order], u[order]
    first = runs(x, y)
    own = np.flatnonzero(first)[np.cumsum(first) - 1]
    later = _after(own, doc[order], place(mark[order]), within)
    again = np.add.reduceat(~later, np.flatnonzero(first)) > 1 if len(order) else first
    tag = mark[order] >> POS - TAG_BITS & (1 << TAG_BITS) - 1
    keep = np.zeros(len(order), dtype=bool)
    keep[order[first | ~later & (tag != tag[own])]] = True  # another text of the same document speaks for itself
    out, recurs = np.zeros(len(order), dtype=bool), np.zeros(len(order), dtype=bool)
    out[order] = later
    recurs[order[first]] = again
    return keep, out, recurs


def _table(schema: str, *columns) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, type=types[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def gathered(batches, least: int):
    """(columns, whether it is the last) of Arrow batches put together to at least so many rows."""
    held, n = [], 0

    def columns():
        whole = pa.Table.from_batches(held)
        return {c: whole[c].to_numpy() if whole.schema.field(c).type != pa.binary() else whole[c].to_pylist() for c in whole.column_names}

    for batch in batches:
        if n >= least:
            yield columns(), False
            held, n = [], 0
        held.append(batch)
        n += batch.num_rows
    if held:
        yield columns(), True


def find_seen(batches, within: bool):
    """FOUND of stretches that come sorted by (a, u, doc, mark)."""
    carry, told = [np.zeros(0, dtype=np.int64)] * 4, False  # rows of the last anchor that may still be asked; told: they were
    for rows, last in gathered(batches, ROWS):
        a, u, doc, mark = (rows[c] for c in ("a", "u", "doc", "mark"))
        done = u == SETTLED
        yield _table(FOUND, np.full(done.sum(), SEEN), a[done] * 0, doc[done], mark[done])
        old = len(carry[0])
        a, u, doc, mark = (np.concatenate((c, x[~done])) for c, x in zip(carry, (a, u, doc, mark), strict=True))
        if not len(a):
            continue
        first, new = runs(a, u), runs(a)
        own = np.flatnonzero(first)[np.cumsum(first) - 1]
        later = _after(own, doc, place(mark), within)
        later[:old] = False
        yield _table(FOUND, np.full(later.sum(), SEEN), a[later] * 0, doc[later], mark[later])
        group = np.cumsum(new) - 1
        several = np.bincount(group, weights=first)[group]
        common = mark >> COMMON_AT & 1 > 0
        wide = common | (several > WIDE) | (told & (group == 0) & (old > 0))
        open_ = np.zeros(len(a), dtype=bool) if last else group == group[-1]
        ask = ~later & (wide | (~open_ & (several > 1)))
        if told:
            ask[:old] = False
        yield _table(FOUND, np.where(wide[ask], ASK_WIDE, ASK), a[ask], doc[ask], mark[ask])
        told = bool(open_.any() and wide[-1])
        # Of an anchor whose rows are asked anyway, the last stretch's first row is enough to go on.
        keep = np.flatnonzero(open_ & ~later)
        keep = keep[keep >= own[-1]][:1] if told else keep
        carry = [x[keep] for x in (a, u, doc, mark)]


def _orders(run: np.ndarray, symbols: np.ndarray, depths: np.ndarray) -> np.ndarray:
    """For rows of a run and each depth: a number that rows share iff their first ``depth`` symbols are equal."""
    m, width = symbols.shape
    raw = np.concatenate((run.astype(">u4").view(np.uint8).reshape(m, 4), np.ascontiguousarray(symbols).view(np.uint8).reshape(m, -1)), axis=1)
    order = np.argsort(np.ascontiguousarray(raw).view(f"S{raw.shape[1]}").ravel(), kind="stable")
    s, r = symbols[order], run[order]
    differs = s[1:] != s[:-1]
    shared = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    shared[r[1:] != r[:-1]] = -1
    out = np.empty((m, len(depths)), dtype=np.int64)
    for k, depth in enumerate(depths):
        out[order, k] = np.append(0, np.cumsum(shared < depth))
    return out


def compare(a: np.ndarray, doc: np.ndarray, mark: np.ndarray, flat: np.ndarray, size: np.ndarray, width: int, within: bool) -> tuple[np.ndarray, np.ndarray]:
    """(mask of each row's windows that were seen before, whether some window is the first of its class).

    Rows come sorted by (a, doc, mark); flat holds their symbols one after another, size how many each has.
    """
    m = len(a)
    lo, hi = starts_of(mark)
    pos = place(mark)
    left, base = pos - lo, np.append(0, np.cumsum(size)[:-1])
    deep = int(left.max()) if m else 0
    run = np.cumsum(runs(a)) - 1
    anchor = base + left
    before = np.arange(deep)[None, :]
    before = np.where(before < left[:, None], flat[np.maximum(anchor[:, None] - 1 - before, 0)], flat.dtype.type(0))
    after = np.arange(width)[None, :]
    after = np.where(after < (size - left)[:, None], flat[np.minimum(anchor[:, None] + after, len(flat) - 1)], flat.dtype.type(0))
    of_left = _orders(run, before, np.arange(deep + 1)) if deep else run[:, None]
    of_right = _orders(run, after, np.arange(width - deep, width + 1))
    row, start = spread(np.arange(m), lo, hi)
    back = pos[row] - start
    key = (back * m + of_left[row, back]) * m + of_right[row, deep - back]
    _, first, member = np.unique(key, return_index=True, return_inverse=True)
    own = first[member]
    seen = _after(own, doc[row], start, within)
    bits = np.where(seen, np.int64(1) << (start - lo[row]), 0)
    cuts = np.append(0, np.cumsum(hi - lo + 1)[:-1])
    leads = np.zeros(m, dtype=bool)
    leads[row[first]] = True
    return np.add.reduceat(bits, cuts) if m else bits, leads


def find_windows(batches, dtype, width: int, within: bool):
    """MASKS of phrases that come sorted by (a, doc, mark)."""
    kind = np.dtype(dtype)
    carry = [np.zeros(0, dtype=np.int64)] * 3 + [[]]
    for rows, last in gathered(batches, PHRASES):
        done = np.array([not s for s in rows["sym"]], dtype=bool)
        yield _table(MASKS, rows["doc"][done], rows["mark"][done], np.full(done.sum(), 1))
        live, old = np.flatnonzero(~done), len(carry[0])
        a, doc, mark = (np.concatenate((c, rows[n][live])) for c, n in zip(carry, ("a", "doc", "mark"), strict=False))
        sym = carry[3] + [rows["sym"][i] for i in live]
        if not len(a):
            continue
        size = np.fromiter(map(len, sym), dtype=np.int64, count=len(sym)) // kind.itemsize
        mask, leads = compare(a, doc, mark, np.frombuffer(b"".join(sym), dtype=kind), size, width, within)
        tell = np.flatnonzero(mask[old:] != 0) + old
        yield _table(MASKS, doc[tell], mark[tell], mask[tell])
        keep = np.flatnonzero((a == a[-1]) & leads) if not last else np.zeros(0, dtype=np.int64)
        carry = [a[keep], doc[keep], mark[keep], [sym[i] for i in keep]]


class Marks:
    """The marks of a home's documents, by document."""

    def __init__(self, doc: np.ndarray, mark: np.ndarray, mask: np.ndarray):
        order = np.lexsort((mark, doc))
        self.doc, self.mark, self.mask = doc[order], mark[order], mask[order]

    def of(self, ids: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, mark, mask) of every mark of the texts with these ids and tags, by row."""
        lo, hi = np.searchsorted(self.doc, ids, "left"), np.searchsorted(self.doc, ids, "right")
        n = hi - lo
        at = np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        row = np.repeat(np.arange(len(ids)), n)
        own = (self.mark[at] >> POS - TAG_BITS & (1 << TAG_BITS) - 1) == tag[row]
        return row[own], self.mark[at][own], self.mask[at][own]


def common_anchors(docs: DataFrame, mode, total: int) -> np.ndarray:
    """Anchors that a sample of the texts has at least COMMON times; the sample is bounded by SAMPLE_BYTES, so their number is too."""

    def run(batches):
        for pdf in batches:
            for part in chunks(pdf, most=CHUNK):
                a, n = np.unique(mode.anchors(part["text"].tolist()).a, return_counts=True)
                yield pd.DataFrame({"a": signed(a[n > 1]), "n": n[n > 1]})

    sample = docs.select("text").sample(min(1.0, SAMPLE_BYTES / max(1, total)), seed=1)
    found = sample.mapInPandas(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON)
    return np.sort(np.array([r["a"] for r in found.select("a").collect()], dtype=np.int64).view(U))


def seen_windows(docs: DataFrame, mode, finish, schema: str) -> DataFrame:
    """Run both steps, then ``finish(pdf, starts)`` over chunks of (doc_id, text).

    starts: for each row, the starts of its windows that were seen before, ascending. ``mode`` has ``width``, the
    ``dtype`` of its symbols, anchors(texts), symbols(texts) -> (all symbols, where each text's begin), key(symbols of
    windows), alike(texts, starts) -> (row, start) of all windows equal to some of a text's own, and ``within``:
    whether earlier places in the same document count. Rows without doc_id are left out.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull())
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width, within, dtype = mode.width, mode.within, mode.dtype
    homes_n = int(total // BUCKET_BYTES) + 8
    parts = min(MOST_PARTITIONS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total // PARTITION_BYTES) + 1))
    sent = spark.sparkContext.broadcast(common_anchors(docs, mode, total))

    def stretches(batches):
        common = sent.value
        for pdf in batches:
            for part in chunks(pdf, most=CHUNK):
                part = part.sort_values("doc_id", kind="stable")
                texts = part["text"].tolist()
                x = mode.anchors(texts)
                if not len(x.doc):
                    continue
                doc = part["doc_id"].to_numpy()[x.doc]
                mark = x.pos.astype(np.int64) << POS | tags(texts)[x.doc] << POS - TAG_BITS | (x.pos - x.lo) << 5 | (x.hi - x.lo)
                a, u = x.a, x.u
                u = np.where(u == ~U(0), U(0), u)
                if len(common):
                    often = np.isin(a, common)
                    a = np.where(often, mix(a + u % U(1021)), a)
                    mark |= often.astype(np.int64) << COMMON_AT
                keep, later, again = settle(a, u, doc, mark, within)
                mark |= again.astype(np.int64) << AGAIN
                a, u = np.where(later, mix(a + doc.view(U) * U(31)), a), np.where(later, ~U(0), u)
                keep |= later
                yield pd.DataFrame({"a": signed(a[keep]), "u": signed(u[keep]), "doc": doc[keep], "mark": mark[keep]})

    rows = docs.mapInPandas(stretches, STRETCHES).repartition(parts, "a").sortWithinPartitions("a", "u", "doc", "mark")
    found = materialize(rows.mapInArrow(lambda batches: find_seen(batches, within), FOUND), "seen")
    homes = docs.select(F.pmod("doc_id", F.lit(homes_n)).cast("int").alias("bucket"), "doc_id", "text")
    home = F.pmod("doc", F.lit(homes_n)).cast("int").alias("bucket")

    def phrases(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """What is asked of the texts of a home: stretches, and the windows of wide ones, whose later copies in a chunk are settled."""
        out = []
        asked = Marks(right["doc"].to_numpy(), right["mark"].to_numpy(), np.arange(len(right)))
        keys, wide = right["a"].to_numpy(), right["what"].to_numpy() == ASK_WIDE
        for part in chunks(left[np.isin(left["doc_id"], asked.doc)].sort_values("doc_id", kind="stable"), most=CHUNK) if len(right) else []:
            ids, texts = part["doc_id"].to_numpy(), part["text"].tolist()
            row, mark, at = asked.of(ids, tags(texts))
            flat, base = mode.symbols(texts)
            lo, hi = starts_of(mark)
            one = ~wide[at]
            s, e = (base[row] + lo)[one], (base[row] + hi + width)[one]
            out.append(pd.DataFrame({"a": keys[at[one]], "doc": ids[row[one]], "mark": mark[one], "sym": [flat[x:y].tobytes() for x, y in zip(s, e, strict=True)]}))
            if not one.all():
                at, start = spread(np.flatnonzero(~one), lo[~one], hi[~one])
                order = np.lexsort((start, row[at]))
                at, start = at[order], start[order]
                s = base[row[at]] + start
                key = mode.key(flat, s)
                doc, m = ids[row[at]], start << POS | mark[at] & ((1 << POS) - (1 << AGAIN))
                keep, later, again = settle(key, key, doc, m, within)
                m |= again.astype(np.int64) << AGAIN
                key = np.where(later, mix(key + doc.view(U) * U(31)), key)
                keep = np.flatnonzero(keep | later)
                sym = [b"" if later[i] else flat[s[i] : s[i] + width].tobytes() for i in keep]
                out.append(pd.DataFrame({"a": signed(key[keep]), "doc": doc[keep], "mark": m[keep], "sym": sym}))
        return pd.concat(out) if out else pd.DataFrame({c.split()[0]: [] for c in PHRASES_OUT.split(", ")})

    asked = found.filter(F.col("what") != SEEN).select(home, "what", "a", "doc", "mark")
    cut = homes.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInPandas(phrases, PHRASES_OUT)
    cut = cut.repartition(parts, "a").sortWithinPartitions("a", "doc", "mark")
    masks = materialize(cut.mapInArrow(lambda batches: find_windows(batches, dtype, width, within), MASKS), "windows")

    def end(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = Marks(*(right[c].to_numpy() for c in ("doc", "mark", "mask")))
        out = []
        for part in chunks(left, most=CHUNK):
            ids, texts = part["doc_id"].to_numpy(), part["text"].tolist()
            row, mark, mask = found.of(ids, tags(texts)) if len(right) else [np.zeros(0, dtype=np.int64)] * 3
            lo, hi = starts_of(mark)
            r, s = spread(np.arange(len(row)), lo, hi)
            on = mask[r] >> (s - lo[r]) & 1 > 0
            r, s = row[r[on]], s[on]
            # A stretch or window that recurs in its own document was sent once.
            recurs = np.unique(row[mark >> AGAIN & 1 > 0]) if not within else []
            if len(recurs):
                own = [np.unique(s[r == k]) for k in recurs]
                r2, s2 = mode.alike([texts[k] for k in recurs], own)
                r, s = np.concatenate((r, recurs[r2])), np.concatenate((s, s2))
            key = np.unique(r << 32 | s)
            at = np.searchsorted(key >> 32, np.arange(len(part) + 1))
            out.append(finish(part, [key[a:b] & 0xFFFFFFFF for a, b in zip(at[:-1], at[1:], strict=True)]))
        return pd.concat(out) if out else pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})

    seen = found.filter(F.col("what") == SEEN).select(home, "doc", "mark", F.lit(-1).cast("long").alias("mask"))
    seen = seen.unionByName(masks.select(home, "doc", "mark", "mask"))
    return homes.groupBy("bucket").cogroup(seen.groupBy("bucket")).applyInPandas(end, schema)


def removed_runs(starts: np.ndarray, width: int, n: int) -> tuple[np.ndarray, int, int]:
    """Mask of the n units that windows at starts cover, their number, and the number of runs."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    gone = np.cumsum(edge[:-1]) > 0
    return gone, int(gone.sum()), int((np.diff(np.append(False, gone).astype(np.int8)) == 1).sum())
