"""Substring dedup of word windows by difference-cover anchors (operator 2).

Positions of a document whose residue modulo PERIOD lies in COVER are anchors. The cover has two members
at every distance, so of two places that share a window, whatever their alignment, one of the first PERIOD offsets is an
anchor in both; the ANCHOR words from there lie inside the window. Anchors that meet are extended
to whole windows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .anchored import Anchors, removed_runs, seen_windows
from .hashing import WORDS, Batch

WINDOW = 20
#: A perfect difference set modulo 13.
PERIOD, COVER = 13, (0, 1, 3, 9)


class WordMode:
    within, dtype = True, np.uint64

    def __init__(self, window: int = WINDOW):
        self.width, self.anchor = window, window - PERIOD + 1
        if self.anchor < 1:
            raise ValueError(f"a window needs at least {PERIOD} words")

    def symbols(self, texts):
        return Batch(texts).word_hashes()

    def anchors(self, texts) -> Anchors:
        h, first = self.symbols(texts)
        n = np.diff(first)
        doc = np.repeat(np.arange(len(n)), n)
        pos = np.arange(len(h)) - first[doc]
        cover = np.zeros(PERIOD, dtype=bool)
        cover[list(COVER)] = True
        keep = cover[pos % PERIOD] & (pos <= n[doc] - self.anchor) & (n[doc] >= self.width)
        doc, pos = doc[keep], pos[keep]
        lo, hi = np.maximum(0, pos - PERIOD + 1), np.minimum(pos, n[doc] - self.width)
        some = lo <= hi
        doc, pos, lo, hi = doc[some], pos[some], lo[some], hi[some]
        at = first[doc]
        a = WORDS.short(h, at + pos, at + pos + self.anchor)
        u = WORDS.short(h, at + lo, at + hi + self.width) + (pos - lo).astype(np.uint64)
        return Anchors(doc, pos, a, u, lo, hi)

    def key(self, flat, start):
        return WORDS.short(flat, start, start + self.width)

    def alike(self, texts, starts):
        """Windows that share the fate of those at starts: just these, as each place is judged by itself."""
        return np.repeat(np.arange(len(starts)), [len(s) for s in starts]), np.concatenate(starts)


def substring_dedup(docs: DataFrame, window: int = WINDOW, text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked, the kept text of every row with a doc_id.

    Words are runs of anything but ASCII white space. Each word goes that is covered by a window of ``window`` words
    which also starts earlier: in a smaller doc_id, or at an earlier word of the same document; the input is judged, not what
    is left. Kept words are joined by one space. A null or blank text has no words. Rows that repeat a doc_id are one
    place each and are not earlier than each other at the same word. An empty table gives no rows.
    """
    schema = f"doc_id long, n_words long, n_removed long{', kept string' if text else ''}, kept_sha256 string"

    def finish(part: pd.DataFrame, starts) -> pd.DataFrame:
        rows = []
        for doc_id, t, s in zip(part["doc_id"], part["text"], starts, strict=True):
            words = (t or "").encode("utf-8", "surrogatepass").split()
            removed = 0
            if len(s):
                gone, removed, _ = removed_runs(s, window, len(words))
                kept = b" ".join([w for w, g in zip(words, gone, strict=True) if not g])
            else:
                kept = b" ".join(words)
            rows.append((doc_id, len(words), removed, kept.decode("utf-8", "surrogatepass") if text else "", hashlib.sha256(kept).hexdigest()))
        out = pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])
        return out if text else out.drop(columns="kept")

    return seen_windows(docs, WordMode(window), finish, schema)


def op2_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), text=False)


SQL = f"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS s FROM w WHERE len(ws) >= {WINDOW}),
grams AS (SELECT doc_id, s, md5_number(array_to_string(ws[s:s + {WINDOW - 1}], ' ')) AS g FROM starts),
judged AS (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) > 1 AS seen FROM grams),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + {WINDOW})) AS p FROM judged WHERE seen),
lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS t
         FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p WHERE gone.p IS NULL GROUP BY words.doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(len(ps), 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN lists ON w.doc_id = lists.doc_id LEFT JOIN kept ON w.doc_id = kept.doc_id
"""
QUERIES = {"op2_difference_cover": op2_difference_cover}
ORACLES = {"op2_difference_cover": SQL}
