"""Best-fit packing of tokenised documents (operator 4).

Lengths are integers up to the capacity, so the packing problem is a histogram of at
most ``capacity`` counts, whatever the corpus size. The driver sees only that histogram:
Martello-Toth dominance fixes document sets that some optimal packing contains, best-fit
decreasing packs the rest, and both yield patterns with multiplicities. Documents then find
their place by their rank among equally long pieces; ranks are counted per input partition
and shifted by a prefix sum, so no length, however common, is gathered in one task.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, bisect_right, insort
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import materialize, small_batches

CAPACITY = 2048
END_ID = 0
#: The added token of byte_bpe_50k.json.
ADDED = {"<|endoftext|>": 50256}
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
Pattern = tuple[int, list[tuple[int, int]]]  # copies of the sequence, then (length, how many) in order


def default_tokenizer() -> str:
    """Path of the ranks file that holds the vocabulary of byte_bpe_50k.json."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=4)
def encoding(path: str, added: bool = False):
    """A byte-level BPE encoder over a ranks file that knows ADDED on demand; ``encode_ordinary`` takes them as ordinary text in any case."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED if added else {})


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones but for the first, which takes the remainder."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID, added: bool = False) -> DataFrame:
    """One row per piece, with its rank ``nth`` among pieces of its length in its input partition ``part``."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        enc, seen, part = encoding(path, added), {}, TaskContext.get().partitionId()
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = np.array([*(enc.encode(text or "", allowed_special="all") if added else enc.encode_ordinary(text or "")), end_id], dtype="<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    nth = seen.get(length, 0)
                    seen[length] = nth + 1
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes()), part, nth))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])

    return docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInPandas(run, PIECES)


def reduce_instance(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Martello-Toth reduction over a histogram; takes what it fixes out of ``counts``.

    For the largest remaining length w and room r = capacity - w, {w} alone dominates if nothing
    fits; {w, k} dominates if k fills r exactly, if no two others fit together, or if no three others
    fit and no pair is longer than the largest single k. Otherwise w stays for best-fit.
    """
    sizes, fixed = sorted(counts), []

    def take(size: int, n: int) -> None:
        counts[size] -= n
        if not counts[size]:
            del counts[size]
            sizes.pop(bisect_left(sizes, size))

    def smallest(n: int, without: int) -> list[int]:
        out: list[int] = []
        for s in sizes:
            out += [s] * min(n, counts[s] - (s == without))
            if len(out) >= n:
                return out[:n]
        return out

    def longest_pair(room: int, without: int) -> int:
        low, high, best = 0, bisect_right(sizes, room) - 1, 0
        while low <= high:
            a, b = sizes[low], sizes[high]
            if counts[b] <= (b == without):
                high -= 1
            elif counts[a] <= (a == without):
                low += 1
            elif a + b <= room and (a != b or counts[a] - (a == without) >= 2):
                best, low = max(best, a + b), low + 1
            else:
                high -= 1
        return best

    for w in sorted(counts, reverse=True):
        while counts.get(w):
            room = capacity - w
            others = smallest(3, w)
            if not others or others[0] > room:
                n = counts[w]
                fixed.append((n, [(w, 1)]))
                take(w, n)
                continue
            at = bisect_right(sizes, room) - 1
            while sizes[at] == w and counts[w] < 2:
                at -= 1
            k = sizes[at]
            two = len(others) > 1 and others[0] + others[1] <= room
            three = len(others) > 2 and sum(others) <= room
            if k != room and two and (three or longest_pair(room, w) > k):
                break
            n = counts[w] // 2 if k == w else min(counts[w], counts[k])
            if two and k != room:
                n = 1  # what fits may change with each set that is fixed
            fixed.append((n, [(w, 2)] if k == w else [(w, 1), (k, 1)]))
            take(w, 2 * n if k == w else n)
            if k != w:
                take(k, n)
    return fixed


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over a histogram: equal pieces go together to the fullest sequences that hold them."""
    rooms: list[int] = []
    open_: dict[int, list[Pattern]] = {}

    def put(room: int, pattern: Pattern) -> None:
        if room not in open_:
            insort(rooms, room)
            open_[room] = []
        open_[room].append(pattern)

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect_left(rooms, size)
            room = rooms[at] if at < len(rooms) else capacity
            copies, inside = open_[room].pop() if at < len(rooms) else (1 << 62, [])
            if inside and not open_[room]:
                del open_[room]
                rooms.pop(at)
            per = room // size
            full = min(copies, left // per)
            rest = left - full * per if full < copies and full * per < left and left - full * per < per else 0
            if full:
                put(room - per * size, (full, [*inside, (size, per)]))
            if rest:
                put(room - rest * size, (1, [*inside, (size, rest)]))
            if inside and (unused := copies - full - bool(rest)):
                put(room, (unused, inside))
            left -= full * per + rest
    return [p for ps in open_.values() for p in ps]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that pack a histogram of lengths; reduction first, best-fit for the remainder."""
    rest = dict(counts)
    fixed = [(rest.pop(capacity), [(capacity, 1)])] if capacity in rest else []
    return fixed + reduce_instance(rest, capacity) + best_fit(rest, capacity)


def slots(patterns: list[Pattern]) -> pd.DataFrame:
    """For each run of equal lengths in a pattern: the ranks it takes and where they go."""
    rows, taken, sequence = [], {}, 0
    for copies, inside in patterns:
        offset = 0
        for length, per in inside:
            low = taken.get(length, 0)
            taken[length] = low + copies * per
            rows.append((length, low, per, sequence, offset))
            offset += length * per
        sequence += copies
    return pd.DataFrame(rows, columns=["length", "low", "per", "sequence", "offset"]).sort_values(["length", "low"], ignore_index=True)


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID, added: bool = False) -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is the
    end id alone; rows without doc_id are left out; repeated rows are packed as often as they occur; an empty table gives no rows; other
    columns are ignored. Sent to the driver: the histogram, at most ``capacity`` rows. Sent to the
    executors: the slots, at most three patterns a length, each with fewer than 64 distinct lengths.
    added: a literal of ADDED in a text is that one token, as ``tokenizers`` has it by default, and no ordinary text.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    rows = materialize(pieces(docs, capacity, tokenizer, end_id, added), "pieces")
    by_part = rows.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    # The table has one row a length and partition, so a length's window holds at most one row a partition.
    before = materialize(by_part.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")), "ranks")
    counts = {int(r["length"]): int(r["n"]) for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = slots(plan(counts, capacity))
    sent = spark.sparkContext.broadcast({c: table[c].to_numpy(dtype=np.int64) for c in table})

    def place(batches):
        t = sent.value
        size = int(t["low"].max() + 1) if len(t["low"]) else 1
        key = t["length"] * size + t["low"]
        for pdf in batches:
            rank = pdf["before"].to_numpy() + pdf["nth"].to_numpy()
            at = np.searchsorted(key, pdf["length"].to_numpy() * size + np.minimum(rank, size - 1), side="right") - 1
            step = rank - t["low"][at]
            pdf["sequence_id"] = t["sequence"][at] + step // t["per"][at]
            pdf["offset"] = t["offset"][at] + step % t["per"][at] * pdf["length"].to_numpy()
            yield pdf[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    # By a shuffle, since the ranks grow with the number of partitions; a length is spread by its partitions.
    joined = rows.join(before.select("length", "part", "before").hint("merge"), ["length", "part"])
    return joined.mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), added=True)


QUERIES = {"op4_best_fit_packing": op4_best_fit_packing}
ORACLES: dict[str, str] = {}
