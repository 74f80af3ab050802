"""Benchmark decontamination by spaced-seed hashing (operator 1), in native expressions only.

A window of SPAN words is cut into four blocks; each mask keeps two of them and ignores the other positions.
Two windows that differ in at most ALLOWED = 2 words agree on two whole blocks, so they share the hash
of some mask: the seeds miss no window that the check would accept. Hits carry the item's word hashes and
are checked in place, so the only shuffle is that of the final pairs.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN, BLOCK, ALLOWED = 12, 3, 2
#: Words between the starts of an item's windows: every window is taken, here and in the SQL.
STRIDE = 1
#: Items below this many words are too short to tell anything; from here to SPAN - 1 they must match whole.
LEAST = 5
#: Seeds are sent to all tasks up to this many, and joined by a shuffle beyond.
SENT_SEEDS = 200_000
#: Beyond, places are passed over by a bitmap of the seeds' first blocks, of so many words of 64 bits at most.
BITMAP_WORDS = 1 << 20
#: Places of a document that one row holds.
PLACES = 512
MASKS = [tuple(b * BLOCK + k for b in pair for k in range(BLOCK)) for pair in combinations(range(SPAN // BLOCK), 2)]


def words(text: str) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def hashes(text: str) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _block(h: str, at: Column) -> Column:
    """Hash of the block of words at a place; a mask's seed is made of its two blocks' hashes."""
    return F.xxhash64(*(F.get(h, at + k) for k in range(BLOCK)))


class Seeds:
    """The seeds of a place: one per mask whose first kept block stands there, one per length of short items."""

    def __init__(self, short: list[int]):
        self.masks = [(SPAN, a * BLOCK, (b - a) * BLOCK) for a, b in combinations(range(SPAN // BLOCK), 2)] + [(n, 0, 0) for n in short]
        self.least = min(n for n, _, _ in self.masks)

    def at(self, h: str, place: str) -> Column:
        """(seed, from, width) of every mask, the window starting ``from`` words after the start of h; null seeds where it would not fit."""
        p = F.col(place)

        def one(k: int, n: int, before: int, gap: int) -> Column:
            kept = [_block(h, p + gap)] if n == SPAN else [F.get(h, p + j) for j in range(BLOCK, n)]
            seed = F.when((p >= before) & (p - before + n <= F.size(h)), F.xxhash64(F.lit(k), _block(h, p), *kept))
            return F.struct(seed.alias("seed"), (p - before).alias("from"), F.lit(n).alias("width"))

        return F.array(*(one(k, *m) for k, m in enumerate(self.masks)))


def item_windows(items: DataFrame) -> DataFrame:
    """item_id, width and the hashes g of every window of an item."""
    h = items.filter(F.col("item_id").isNotNull()).select("item_id", hashes("text").alias("h")).withColumn("n", F.size("h")).filter(F.col("n") >= LEAST)
    width = F.least("n", F.lit(SPAN))
    starts = F.sequence(F.lit(0), F.col("n") - width, F.lit(STRIDE))
    return h.select("item_id", "h", width.alias("width"), F.explode(starts).alias("at")).select("item_id", "width", F.slice("h", F.col("at") + 1, F.col("width")).alias("g"))


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word, n_equal for each document and benchmark item that overlap.

    They overlap if any SPAN-word window of the item stands in the document with at most
    ALLOWED words replaced; items of LEAST to SPAN - 1 words must stand there whole, shorter ones never match. n_equal
    is the most equal words in a window, first_word where the first such window starts in the document. Null and
    empty texts match nothing, rows without id are left out, repeated rows of an id count as one, other columns are
    ignored. Nothing is sent to the driver but the distinct lengths of short items, at most SPAN - LEAST numbers.
    """
    windows = item_windows(items.select("item_id", "text"))
    masks = Seeds(sorted(r["width"] for r in windows.filter(F.col("width") < SPAN).select("width").distinct().collect()))
    places = windows.select("*", F.explode(F.sequence(F.lit(0), F.lit(SPAN - 2 * BLOCK), F.lit(BLOCK))).alias("p"))
    seeds = places.select("item_id", "g", _block("g", F.col("p")).alias("block"), F.explode(masks.at("g", "p")).alias("s"))
    seeds = seeds.select("item_id", "g", "block", "s.*").filter(F.col("seed").isNotNull() & (F.col("from") == 0) & (F.col("width") == F.size("g"))).drop("from")
    few = seeds.count() <= SENT_SEEDS
    h = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", hashes("text").alias("all")).filter(F.size("all") >= masks.least)
    # Long documents go in pieces that overlap by a window, so a row stays small whatever the document.
    pieces = h.select("doc_id", "all", F.explode(F.sequence(F.lit(0), F.size("all") - 1, F.lit(PLACES))).alias("base"))
    before = F.least("base", F.lit(SPAN))
    pieces = pieces.select("doc_id", (F.col("base") - before).alias("base"), before.alias("skip"), F.slice("all", F.col("base") - before + 1, F.lit(PLACES + 2 * SPAN)).alias("h"))
    probes = pieces.filter(F.size("h") - BLOCK >= F.col("skip")).select("doc_id", "base", "h", F.explode(F.sequence("skip", F.least(F.size("h") - BLOCK, F.col("skip") + PLACES - 1))).alias("p"))
    probes = _near(probes.withColumn("block", _block("h", F.col("p"))), seeds.select("block").distinct(), few)
    probes = probes.select("doc_id", "base", "h", F.explode(masks.at("h", "p")).alias("s")).select("doc_id", "base", "h", "s.seed", "s.from").filter(F.col("seed").isNotNull())
    if few:
        seeds = F.broadcast(seeds)
    else:  # only the window itself is shuffled
        probes = probes.select("doc_id", "seed", F.slice("h", F.col("from") + 1, F.lit(SPAN)).alias("h"), (F.col("base") + F.col("from")).alias("base"), F.lit(0).alias("from"))
    equal = sum((F.coalesce((F.get("h", F.col("from") + k) == F.get("g", F.lit(k))).cast("int"), F.lit(0)) for k in range(SPAN)), F.lit(0))
    hits = probes.join(seeds, "seed").select("doc_id", "item_id", (F.col("base") + F.col("from")).alias("i"), "width", equal.alias("n_equal"))
    kept = hits.filter(F.col("n_equal") >= F.when(F.col("width") == SPAN, F.lit(SPAN - ALLOWED)).otherwise(F.col("width")))
    return kept.groupBy("doc_id", "item_id").agg(F.min("i").cast("long").alias("first_word"), F.max("n_equal").cast("long").alias("n_equal"))


def _near(probes: DataFrame, blocks: DataFrame, few: bool) -> DataFrame:
    """probes whose block is among blocks, and if these are not few, some others."""
    if few:
        return probes.join(F.broadcast(blocks), "block", "left_semi")
    at = lambda f: F.pmod(f, F.lit(64 * BITMAP_WORDS))
    words = blocks.select(F.shiftright(at("block"), 6).alias("word"), (at("block") % 64).cast("int").alias("bit"))
    words = words.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    return probes.withColumn("word", F.shiftright(at("block"), 6)).join(F.broadcast(words), "word").filter(F.getbit("bits", (at("block") % 64).cast("int")) == 1).drop("word", "bits")


def op1_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _keys(w: str, at: str) -> str:
    return "[" + ", ".join("'%d ' || " % k + " || ' ' || ".join(f"{w}[{at} + {o}]" for o in m) for k, m in enumerate(MASKS)) + "]"


def _equal() -> str:
    return " + ".join(f"coalesce(CAST(dw[i + {k}] = iw[j + {k}] AS INT), 0)" for k in range(SPAN))


SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS dw FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS iw FROM benchmark),
bw AS (SELECT item_id, iw, unnest(range(1, len(iw) - {SPAN - 2}, {STRIDE})) AS j FROM b WHERE len(iw) >= {SPAN}),
bs AS (SELECT item_id, iw, j, unnest({_keys('iw', 'j')}) AS seed FROM bw),
dp AS (SELECT doc_id, dw, unnest(range(1, len(dw) - {SPAN - 2})) AS i FROM d WHERE len(dw) >= {SPAN}),
ds AS (SELECT doc_id, i, unnest({_keys('dw', 'i')}) AS seed FROM dp),
hits AS (SELECT DISTINCT ds.doc_id, bs.item_id, ds.i, bs.j FROM ds JOIN bs ON ds.seed = bs.seed),
judged AS (SELECT hits.doc_id, hits.item_id, i, {_equal()} AS n_equal
           FROM hits JOIN d ON hits.doc_id = d.doc_id JOIN b ON hits.item_id = b.item_id),
short AS (SELECT d.doc_id, b.item_id, i, len(iw) AS n_equal
          FROM (SELECT item_id, iw FROM b WHERE len(iw) BETWEEN {LEAST} AND {SPAN - 1}) b, d, unnest(range(1, len(dw) - len(iw) + 2)) AS u(i)
          WHERE dw[i:i + len(iw) - 1] = iw),
found AS (SELECT * FROM judged WHERE n_equal >= {SPAN - ALLOWED} UNION ALL SELECT * FROM short)
SELECT doc_id, item_id, min(i) - 1 AS first_word, CAST(max(n_equal) AS BIGINT) AS n_equal FROM found GROUP BY doc_id, item_id
"""
QUERIES = {"op1_spaced_seeds": op1_spaced_seeds}
ORACLES = {"op1_spaced_seeds": SQL}
