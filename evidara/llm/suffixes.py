"""Byte-level dedup by prefix-free parsing (operator 6).

A rolling hash triggers phrase ends where it is smallest among the places that a window spans, so every
window of WIDTH bytes holds a trigger and equal windows hold it at the same place. What a window has before its trigger is
the end of a phrase; what it has from there is the beginning of the parse that follows. The dictionary holds the
distinct phrases of a trigger; phrases that recur whole are settled in the parse alone, whose first document keeps them.
Where a trigger has several, ``anchored.compare`` sorts the dictionary from the trigger backwards and the parse's
suffixes from the trigger on. A window's place in corpus order is the pair of both: windows of one phrase ending whose
parse suffixes stand together and share the rest of WIDTH bytes are equal, and the first document among them keeps it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .anchored import Anchors, removed_runs, seen_windows
from .hashing import BYTES, U, Batch, choices

WIDTH, TRIGGER = 50, 20
#: Starts of windows that are parsed at once.
SEGMENT = 1 << 20


class ByteMode:
    within, dtype = False, np.uint8

    def __init__(self, width: int = WIDTH, trigger: int = TRIGGER):
        if not 0 < trigger <= width or width - trigger > 31:
            raise ValueError("a trigger must fit into a window, with at most 31 bytes to spare")
        self.width, self.trigger = width, trigger

    def _owners(self, g: np.ndarray) -> np.ndarray:
        """For each window start, the leftmost place of the smallest trigger hash inside it."""
        span, reach = self.width - self.trigger + 1, 1
        v = g.astype(U) << U(32) | np.arange(len(g), dtype=U)
        while reach < span:
            step = min(reach, span - reach)
            v = np.minimum(v[step:], v[:-step])
            reach += step
        return (v & U(0xFFFFFFFF)).astype(np.int64)

    def anchors(self, texts) -> Anchors:
        batch = Batch(texts)
        parts = [self._segment(batch, low) for low in range(0, max(1, len(batch.bytes) - self.width + 1), SEGMENT)]
        return Anchors(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    def _segment(self, batch: Batch, low: int) -> Anchors:
        """Phrases of the windows that start in one segment of the buffer; one that goes on is cut, and compared as two."""
        none = np.zeros(0, dtype=np.int64)
        empty = Anchors(none, none, none.astype(U), none.astype(U), none, none)
        data = batch.bytes[low : low + SEGMENT + self.width - 1]
        if len(data) < self.width:
            return empty
        owner = self._owners(choices(data, self.trigger))
        first = np.searchsorted(batch.base, low, "right") - 1
        last = np.searchsorted(batch.base, low + len(owner), "left")
        edges = np.clip(batch.base[first : last + 1] - low, 0, len(owner))
        doc = np.repeat(np.arange(first, first + len(edges) - 1, dtype=np.int64), np.diff(edges))
        at = np.arange(len(doc))
        start = np.flatnonzero(at + low + self.width <= batch.base[doc] + batch.sizes[doc])
        if not len(start):
            return empty
        owner, doc = owner[start], doc[start]
        new = np.append(True, (owner[1:] != owner[:-1]) | (doc[1:] != doc[:-1]))
        lo, hi = start[new], start[np.append(np.flatnonzero(new)[1:], len(start)) - 1]
        t, doc = owner[new], doc[new]
        prefix = BYTES.prefix(data)
        a = BYTES.span(prefix, t, t + self.trigger)
        u = BYTES.span(prefix, lo, hi + self.width) + (t - lo).astype(U)
        base = batch.base[doc] - low
        return Anchors(doc, t - base, a, u, lo - base, hi - base)

    def symbols(self, texts):
        batch = Batch(texts)
        return batch.bytes, batch.base

    def key(self, flat, start):
        return BYTES.short(flat, start, start + self.width)

    def alike(self, texts, starts):
        """All windows of a text that equal one of those at starts."""
        row, place = [], []
        for k, (t, s) in enumerate(zip(texts, starts, strict=True)):
            if len(s):
                data = Batch([t]).bytes[:-1]
                wanted = np.unique(self.key(data, s))
                for low in range(0, len(data) - self.width + 1, SEGMENT):
                    part = data[low : low + SEGMENT + self.width - 1]
                    at = np.arange(len(part) - self.width + 1)
                    hit = np.flatnonzero(np.isin(BYTES.span(BYTES.prefix(part), at, at + self.width), wanted))
                    row.append(np.full(len(hit), k))
                    place.append(low + hit)
        return (np.concatenate(row), np.concatenate(place)) if row else (np.zeros(0, dtype=np.int64),) * 2


def byte_dedup(docs: DataFrame, width: int = WIDTH, text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked, the kept bytes of every row with a doc_id.

    Texts are UTF-8 bytes, null being none. Each byte goes that is covered by a string of ``width`` bytes that also starts
    in a document with a smaller doc_id; matches never cross documents, overlaps count, and the input is judged, not
    what is left. n_spans counts the maximal removed runs. Texts shorter than ``width`` bytes keep all. Rows that repeat a
    doc_id are one document. An empty table gives no rows; other columns are ignored.
    """
    schema = f"doc_id long, n_bytes long, n_removed long, n_spans long{', kept binary' if text else ''}, kept_sha256 string"

    def finish(part: pd.DataFrame, starts) -> pd.DataFrame:
        rows = []
        for doc_id, t, s in zip(part["doc_id"], part["text"], starts, strict=True):
            raw = (t or "").encode("utf-8", "surrogatepass")
            removed = spans = 0
            kept = raw
            if len(s):
                gone, removed, spans = removed_runs(s, width, len(raw))
                kept = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
            rows.append((doc_id, len(raw), removed, spans, kept if text else b"", hashlib.sha256(kept).hexdigest()))
        out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])
        return out if text else out.drop(columns="kept")

    return seen_windows(docs, ByteMode(width), finish, schema)


def op6_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), text=False)


QUERIES = {"op6_prefix_free_parsing": op6_prefix_free_parsing}
ORACLES: dict[str, str] = {}
