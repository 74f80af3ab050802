"""Exact n-gram Jaccard join by a token-group matrix (operator 3).

Documents are sets of hashed word shingles. Under one order of all shingles, widespread ones last, two sets
with Jaccard similarity of at least 0.8 share some of the first quarter of each. Documents that share too few with
all others are done with. The rest are partitioned into groups of likely kin: all that reach the same
smallest document by such a shingle. The matrix holds each group's union of those shingles. A join with the matrix bounds what a document shares with
a group, and only groups whose overlap and sizes qualify are opened, to be compared with exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .hashing import WORDS, Batch, U, chunks, mix, signed
from .scratch import materialize, small_batches

WIDTH, PERCENT = 5, 80
#: Members of a group that one task compares, and sets that open it; larger groups are split, and split groups are tied together.
GROUP_MEMBERS = 1000
#: Shingles that are known to be widespread: at most so many are sent to the tasks.
WIDESPREAD = 200_000
#: Of n shingles, n // EXTRA more than the prefix principle needs are looked at, which as many more must then be shared.
EXTRA = 20
#: Ids that are sent to all tasks at most; more are joined by a shuffle.
SENT_IDS = 1_000_000
_BLOCK, _LEAST = 4_000_000, 4


def shingle_sets(texts, width: int = WIDTH) -> list[np.ndarray]:
    """Ascending distinct shingle hashes of each text; a shorter text is one shingle, one without words none."""
    batch = Batch(texts, lower=True)
    words, first = batch.word_hashes()
    prefix = WORDS.prefix(words)
    at = np.arange(max(0, len(words) - width + 1))
    full = WORDS.span(prefix, at, at + width)
    out = []
    for s, e in zip(first[:-1], first[1:], strict=True):
        if e - s >= width:
            out.append(np.unique(full[s : e - width + 1]))
        else:
            out.append(WORDS.span(prefix, np.array([s]), np.array([e])) if e > s else np.zeros(0, dtype=U))
    return out


def widespread(docs: DataFrame, width: int, most: int = WIDESPREAD) -> np.ndarray:
    """Shingles that many documents have, by falling count, at most ``most``.

    They only serve to order shingles, and any order gives the same result. Each task counts blocks of its documents' shingles
    and passes on what a block has at least ``_LEAST`` times.
    """

    def run(batches):
        held, size = [], 0

        def flush():
            token, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n >= _LEAST
            return pd.DataFrame({"token": signed(token[keep]), "n": n[keep]})

        for pdf in batches:
            for part in chunks(pdf, most=500_000):
                held += shingle_sets(part["text"].tolist(), width)
                size += sum(map(len, held[-len(part) :]))
                if size >= _BLOCK:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    counts = docs.select("text").mapInPandas(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = counts.orderBy(F.desc("n"), "token").limit(most).collect()
    return np.array([r["token"] for r in rows], dtype=np.int64).view(U)


def profiles(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n, two hashes that identify the set, and its first shingles under the common order."""
    heavy = widespread(docs, width)
    order = np.argsort(heavy)
    sent = docs.sparkSession.sparkContext.broadcast((heavy[order], (len(heavy) - order).astype(np.int64)))

    def run(batches):
        known, place = sent.value
        for pdf in batches:
            for part in chunks(pdf, most=500_000):
                rows = []
                for doc_id, s in zip(part["doc_id"], shingle_sets(part["text"].tolist(), width), strict=True):
                    n = len(s)
                    if n and len(known):
                        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        ranked = s[np.lexsort((s, np.where(known[at] == s, place[at], 0)))]
                    else:
                        ranked = s
                    first = n - -(-percent * n // 100) + 1 + n // EXTRA if n else 0
                    with np.errstate(over="ignore"):
                        ids = int(signed(mix(s).sum(keepdims=True))[0]), int(signed(mix(mix(s) ^ U(77)).sum(keepdims=True))[0])
                    rows.append((doc_id, n, *(ids if n else (0, 0)), signed(ranked[:first])))
                yield pd.DataFrame(rows, columns=["doc_id", "n", "k1", "k2", "tokens"])

    return docs.mapInPandas(run, "doc_id long, n long, k1 long, k2 long, tokens array<long>")


def compare(members: list[np.ndarray], queries: list[np.ndarray], percent: int, among: bool) -> list[tuple[int, int]]:
    """Linked (query or member, member) positions; queries count on from the members. among: members with one another too."""
    if not members:
        return []
    size = np.array([len(s) for s in members])
    owner = np.repeat(np.arange(len(members)), size)
    token = np.concatenate(members)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    out = []
    for k, s in enumerate([*members, *queries]):
        if k < len(members) and not among:
            continue
        lo, hi = np.searchsorted(token, s, "left"), np.searchsorted(token, s, "right")
        n = hi - lo
        hits = np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        common = np.bincount(owner[hits], minlength=len(members))
        linked = np.flatnonzero((100 * common >= percent * (size + len(s) - common)) & (common > 0))
        out += [(k, int(m)) for m in linked if m != k and (k >= len(members) or m < k)]
    return out


def _roots(n: int, pairs: list[tuple[int, int]]) -> np.ndarray:
    up = np.arange(n)

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(n)])


def join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, group_members: int = GROUP_MEMBERS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) of every row with a doc_id.

    Texts are lower-cased (A-Z) and cut at ASCII white space. Two sets link when 100 * common >= percent * union. A text
    with fewer words than ``width`` is one shingle, one without words (or null) an empty set, which links with nothing.
    Equal sets are one node, so copies cost nothing; rows that repeat a doc_id get the component of their own text.
    Every link between different sets is found and tested. Other columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text")
    sets = materialize(profiles(docs, width, percent), "sets")
    classes = materialize(sets.filter("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "classes")
    first = sets.filter("n > 0").join(classes, ["k1", "k2"]).filter(F.col("doc_id") == F.col("rep"))
    entries = first.select("doc_id", F.explode("tokens").alias("token"))
    # Sets that link share at least so many of the shingles looked at, by the prefix principle.
    need = F.floor(F.ceil(F.col("n") * percent / 100) / EXTRA) + 1

    def shared(rows: DataFrame) -> DataFrame:
        tokens = rows.groupBy("token").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last")).filter("leader < last")
        return rows.join(tokens.select("token", "leader"), "token")

    kin = materialize(shared(entries), "kin")
    alive = kin.groupBy("doc_id").agg(F.countDistinct("token").alias("common")).join(first.select("doc_id", "n"), "doc_id").filter(F.col("common") >= need)
    alive = materialize(alive.groupBy("doc_id").agg(F.min("n").alias("n")), "alive")
    kin = materialize(shared(kin.select("doc_id", "token").join(alive, "doc_id")), "kin")
    member = kin.groupBy("doc_id").agg(F.min("leader").alias("g"), F.first("n").alias("n"))
    groups = member.groupBy("g").agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("head"), F.min("n").alias("low"), F.max("n").alias("high"))
    member = materialize(member.join(groups, "g"), "members")
    placed = materialize(kin.select("doc_id", "token").join(member, "doc_id"), "placed")
    matrix = placed.select("token", F.col("g").alias("other"), F.col("size").alias("other_size"), "low", "high").distinct()
    met = placed.select("token", "doc_id", "n", "g").join(matrix, "token").filter(F.col("other") < F.col("g"))
    met = met.filter((F.col("high") * 100 >= F.col("n") * percent) & (F.col("low") * percent <= F.col("n") * 100))
    # A group whose union shares fewer than a link needs holds nothing that links with the set.
    opened = met.groupBy("doc_id", "n", "other", "other_size").agg(F.count(F.lit(1)).alias("common")).filter(F.col("common") >= need)
    parts = lambda size: F.ceil(F.col(size) / group_members).cast("int")
    own_part = F.pmod(F.xxhash64("doc_id"), parts("size").cast("long")).cast("int")
    every_part = lambda size: F.explode(F.sequence(F.lit(0), parts(size) - 1))
    opened = materialize(opened.select("doc_id", F.col("other").alias("g"), every_part("other_size").alias("part"), F.lit(1).alias("role")), "opened")
    needed = opened.select("g").distinct()
    members = member.join(needed.withColumn("wanted", F.lit(True)), "g", "left").filter((F.col("size") > 1) | F.col("wanted"))
    # A group's smallest document stands in every part of it, so what links to it is tied together.
    leads = members.filter((F.col("doc_id") == F.col("head")) & (F.col("size") > group_members))
    inside = members.select("doc_id", "g", own_part.alias("part"), F.lit(0).alias("role"))
    inside = inside.unionByName(leads.select("doc_id", "g", every_part("size").alias("part"), F.lit(0).alias("role"))).distinct()

    def link(among: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["role", "doc_id"], ignore_index=True)
            sets_ = [s for part in chunks(pdf) for s in shingle_sets(part["text"].tolist(), width)]
            m, first = int((pdf["role"] == 0).sum()), pdf["slice"].iloc[0] == 0
            roots = _roots(len(pdf), compare(sets_[:m], sets_[m:], percent, among and first))
            ids = pdf["doc_id"].to_numpy()
            tied = roots == roots[0]
            return pd.DataFrame({"u": ids, "v": ids[roots], "g": pdf["g"], "part": pdf["part"], "role": pdf["role"], "first": first, "tied": tied})

        return run

    found_schema = "u long, v long, g long, part int, role int, first boolean, tied boolean"

    def compared(rows: DataFrame, among: bool) -> DataFrame:
        # Sets that open a part come in slices; its members stand in each, and meet one another in the first.
        slices = rows.filter("role = 1").groupBy("g", "part").agg(F.ceil(F.count(F.lit(1)) / group_members).cast("int").alias("slices"))
        rows = rows.join(slices, ["g", "part"], "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
        every = F.sequence(F.lit(0), F.col("slices") - 1)
        own = F.array(F.pmod(F.xxhash64("doc_id"), F.col("slices").cast("long")).cast("int"))
        rows = rows.select("doc_id", "g", "part", "role", F.explode(F.when(F.col("role") == 0, every).otherwise(own)).alias("slice"))
        ids = rows.select("doc_id").distinct()
        ids = F.broadcast(ids) if ids.count() <= SENT_IDS else ids
        with_text = rows.join(docs.join(ids, "doc_id", "left_semi"), "doc_id").select("doc_id", "g", "part", "role", "slice", "text")
        return with_text.groupBy("g", "part", "slice").applyInPandas(link(among), found_schema)

    found = materialize(compared(inside.unionByName(opened), True), "found")
    links = found.select("u", "v")
    large = member.filter(F.col("size") > group_members).select("g", "size").distinct()
    if not large.isEmpty():
        # In split groups, members that their part does not tie to it are compared with the other parts.
        loose = found.filter("role = 0 and first and not tied").join(large, "g").select(F.col("u").alias("doc_id"), "g", F.col("part").alias("home"), every_part("size").alias("part"))
        loose = loose.filter("part <> home").select("doc_id", "g", "part", F.lit(1).alias("role"))
        again = inside.join(loose.select("g", "part").distinct(), ["g", "part"], "left_semi").unionByName(loose)
        links = links.unionByName(compared(again, False).select("u", "v"))
    reached = components(links)
    whole = sets.join(classes, ["k1", "k2"], "left").join(reached, F.col("rep") == F.col("node"), "left")
    return whole.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))


def op3_token_group_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents),
grams AS (SELECT DISTINCT doc_id, unnest([array_to_string(ws[i:i + {WIDTH - 1}], ' ') FOR i IN range(1, greatest(len(ws) - {WIDTH - 2}, 2))]) AS g FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT u, v FROM pairs JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
reach AS (SELECT u AS doc_id, u AS seen FROM link UNION SELECT r.doc_id, l.v FROM reach r JOIN link l ON l.u = r.seen)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, coalesce(min(seen), w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN reach ON reach.doc_id = w.doc_id GROUP BY w.doc_id
"""
QUERIES = {"op3_token_group_matrix": op3_token_group_matrix}
ORACLES = {"op3_token_group_matrix": SQL}
