"""Windows over the blocks of an object: groups, greedy packing, representations."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..sources import vocabulary as V

#: Characters at which a window is full, may not be passed, and below which a tail is merged.
TARGET, MOST, LEAST = 700, 1400, 120
VERSION = "w1"


def searchable(blocks: DataFrame) -> DataFrame:
    """blocks that are content and not blank, with ``body``, their text or formula source."""
    return blocks.withColumn("body", C.text_of(F.col("text"), F.col("latex"))).filter(~F.col("block_type").isin(V.NON_CONTENT) & (F.col("body") != ""))


def chains(links: pd.DataFrame) -> pd.DataFrame:
    """object, ord, anchor, leader of links (object, ord, target) between blocks of an object, of any length, in time in proportion to them.

    The anchor is the end of a block's chain, or, as a chain may run into a cycle, the last block before one comes again. The
    leader is the block whose group it joins: a block joins its anchor if that stands before it, and its anchor may join another.
    Of several links of a block the first counts.
    """
    links = links.drop_duplicates(["object", "ord"])
    to = {(o, x): (o, t) for o, x, t in zip(links["object"].tolist(), links["ord"].tolist(), links["target"].tolist(), strict=True)}
    anchor: dict = {}
    for start in to:
        path, on = [], {}
        at = start
        while at in to and at not in anchor and at not in on:
            on[at] = len(path)
            path.append(at)
            at = to[at]
        if at in on:  # a cycle: each of its blocks ends at the one before it, what leads to it at the one before its entry
            cycle = path[on[at] :]
            anchor |= {x: cycle[k - 1] for k, x in enumerate(cycle)}
            path = path[: on[at]]
        anchor |= dict.fromkeys(path, anchor.get(at, at))
    seat = lambda x: (min(x[1], anchor.get(x, x)[1]), x[1])
    leader: dict = {}
    for x in sorted(to, key=lambda x: (x[0], *seat(x))):
        a = anchor[x]
        leader[x] = leader.get(a, a) if seat(a) < seat(x) else x
    return pd.DataFrame([(*x, anchor[x][1], leader[x][1]) for x in to], columns=["object", "ord", "anchor", "leader"], dtype="int64")


def objects_of(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by object: the number of each row's object, from 0, and its first row. Rows without object are one object."""
    number = pd.factorize(pdf["object_id"], use_na_sentinel=False)[0]
    return number, np.searchsorted(number, number)


def seats(pdf: pd.DataFrame) -> pd.DataFrame:
    """W1 for whole objects' rows (object_id, block_id, linked_id, block_type, ...), sorted by object, pos and block: with place and grp, in that order."""
    pdf = pdf.reset_index(drop=True)
    number, first = objects_of(pdf)
    at = np.arange(len(pdf))
    ord_ = at - first + 1
    linked = (pdf["linked_id"].notna() & pdf["object_id"].notna()).to_numpy()
    there = pd.DataFrame({"object": number, "name": pdf["block_id"], "target": ord_})
    links = pd.DataFrame({"object": number[linked], "ord": ord_[linked], "name": pdf["linked_id"][linked].to_numpy()}).merge(there, on=["object", "name"])
    links = links[links["ord"] != links["target"]].sort_values(["object", "ord", "target"])
    anchor, leader = ord_.copy(), ord_.copy()
    if len(links):
        c = chains(links)
        row = np.searchsorted(number, c["object"].to_numpy()) + c["ord"].to_numpy() - 1
        anchor[row], leader[row] = c["anchor"], c["leader"]
    order = np.lexsort((ord_, np.minimum(ord_, anchor), number))
    seat = np.empty_like(ord_)
    seat[order] = at - first + 1
    joins = leader != ord_
    begins = ~joins & ~(pdf["block_type"].isin(V.FORMULA_LIKE).to_numpy() & (seat > 1))
    begun = np.concatenate([[0], begins[order].cumsum()])
    run = np.empty_like(ord_)
    run[order] = begun[1:] - begun[first]
    grp = np.where(joins, run[first + leader - 1], run)
    order = np.lexsort((seat, grp, number))
    return pdf.assign(grp=grp).iloc[order].assign(place=ord_)


def fill(pdf: pd.DataFrame) -> pd.DataFrame:
    """W2 for whole objects' rows (object_id, grp, size, ...), sorted by object and group: with number, their window.

    A window closes before a group that would take it over MOST, and after the group that takes it to TARGET; a last
    window below LEAST characters goes to the one before.
    """
    if not len(pdf):
        return pdf.assign(number=np.empty(0, dtype="int64"))
    object_, grp, size = objects_of(pdf)[0], pdf["grp"].to_numpy(), pdf["size"].to_numpy()
    new = np.concatenate([[True], (object_[1:] != object_[:-1]) | (grp[1:] != grp[:-1])])
    starts = np.flatnonzero(new)
    bare = np.add.reduceat(size, starts)
    full = bare + np.diff(np.append(starts, len(size)))
    number, of = [], object_[starts]
    ends = np.append(np.flatnonzero(of[1:] != of[:-1]) + 1, len(of))
    at, bare, full = 0, bare.tolist(), full.tolist()
    for end in ends.tolist():
        length = held = top = 0
        began = at
        for k in range(at, end):
            # A full window stays at its length until the next group begins another.
            if length == 0 or length >= TARGET or length + full[k] > MOST:
                length, held, top, began = 0, 0, top + 1, k
            length, held = length + full[k], held + bare[k]
            number.append(top)
        if top > 1 and held < LEAST:
            number[began:end] = [top - 1] * (end - began)
        at = end
    return pdf.assign(number=np.array(number, dtype="int64")[new.cumsum() - 1])


def by_object(rows: DataFrame, order: list[str], f: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str) -> DataFrame:
    """f of pieces of rows that hold whole objects, sorted by object and ``order``. Rows are dealt by object once; a task holds one object, or a batch."""

    def run(batches):
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if len(pdf):
                last = pdf["object_id"].iloc[-1]
                own = pdf["object_id"].isna() if last is None else pdf["object_id"] == last
                before = held[0]["object_id"].iloc[0] if held else last
                if not own.all() or before != last:
                    yield f(pd.concat([*held, pdf[~own]]))
                    held = []
                held.append(pdf[own])
        if held:
            yield f(pd.concat(held))

    return rows.repartition("object_id").sortWithinPartitions("object_id", *order).mapInPandas(run, schema)


def _own(blocks: DataFrame) -> DataFrame:
    size = F.length("body").cast("long").alias("size")
    return searchable(blocks).select("object_id", "block_id", "linked_id", "pos", "block_type", "body", size)


def block_groups(blocks: DataFrame) -> DataFrame:
    """object_id, block_id, place, grp: the groups that no window boundary may cut, and blocks in the order of groups.

    A block stands where the earlier of it and its anchor does. It joins the group of its anchor if that came before; a
    formula or code joins the group begun last; all others begin one.
    """
    own = _own(blocks)
    kinds = dict(own.dtypes) | {"place": "long", "grp": "long"}
    cols = ["object_id", "block_id", "pos", "place", "grp", "block_type", "body", "size"]
    return by_object(own, ["pos", "block_id"], lambda pdf: seats(pdf)[cols], ", ".join(f"{c} {kinds[c]}" for c in cols))


def greedy_windows(groups: DataFrame) -> DataFrame:
    """The rows of ``block_groups`` with the number of their window, from 1."""
    cols = groups.columns
    schema = T.StructType([*groups.schema.fields, T.StructField("number", T.LongType())])
    return by_object(groups, ["grp", "place"], lambda pdf: fill(pdf)[[*cols, "number"]], schema)


def modality(types: Column) -> Column:
    """Equation before table before diagram before text."""
    has = lambda *k: F.arrays_overlap(types, F.array(*(F.lit(x) for x in k)))
    return F.when(has(*V.FORMULA_LIKE), "equation").when(has("table"), "table").when(has("figure", "image"), "diagram").otherwise("text")


WINDOWS = "object_id string, heading_path string, number long, block_ids array<string>, types array<string>, body string, last_ids array<string>, last_types array<string>, last_bodies array<string>"


def _windows(pdf: pd.DataFrame) -> pd.DataFrame:
    """WINDOWS of whole objects' blocks and, as rows with ``head``, their headings; last: of the window before, up to four blocks, the last first."""
    head = pdf["head"].to_numpy(dtype=bool)
    headings: dict = {}
    for o, h in zip(pdf["object_id"][head], pdf["heading_path"][head], strict=True):
        headings.setdefault(o, []).append(h)
    pdf = fill(seats(pdf[~head]))
    object_, number = pdf["object_id"].tolist(), pdf["number"].tolist()
    ids, types, bodies = (pdf[c].tolist() for c in ("block_id", "block_type", "body"))
    starts = [k for k in range(len(number)) if k == 0 or number[k] != number[k - 1] or object_[k] != object_[k - 1]]
    rows, before = [], 0
    for a, b in zip(starts, [*starts[1:], len(number)], strict=True):
        o = object_[a]
        last = slice(a, a) if number[a] == 1 else slice(max(before, a - 4), a)
        before = a
        for h in headings.get(o, ()) if o is not None else ():
            rows.append((o, h, number[a], ids[a:b], types[a:b], "\n".join(bodies[a:b]), ids[last][::-1], types[last][::-1], bodies[last][::-1]))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in WINDOWS.split(", ")])


def represent(blocks: DataFrame, objects: DataFrame, openers: list[str]) -> DataFrame:
    """representation_id, object_id, number, block_ids, context_id, heading_path, search_text, modality, content_hash.

    The search text is the heading, the last statement among the last four blocks of the window before, and the window's
    own blocks. What is carried over can be found, but is context and not one of the window's blocks.
    """
    none = lambda c: F.lit(None).cast(dict(own.dtypes)[c]).alias(c)
    own = _own(blocks)
    heads = objects.select("object_id", *(none(c) for c in own.columns[1:]), "heading_path", F.lit(True).alias("head"))
    rows = own.withColumns({"heading_path": F.lit(None).cast("string"), "head": F.lit(False)}).unionByName(heads)
    w = by_object(rows, ["head", "pos", "block_id"], _windows, WINDOWS)
    last4 = F.arrays_zip("last_ids", "last_types", "last_bodies")
    said = F.filter(last4, lambda b: ~b["last_types"].isin(V.FORMULA_LIKE) & C.is_statement(b["last_bodies"], openers))
    w = w.withColumn("carried", F.get(said, F.lit(0)))
    parts = F.filter(F.array("heading_path", F.col("carried.last_bodies"), F.col("body")), lambda p: p.isNotNull() & (p != ""))
    text = F.array_join(parts, "\n")
    return w.select(
        F.concat_ws(":", "object_id", F.lit(VERSION), F.col("number").cast("string")).alias("representation_id"), "object_id", "number",
        "block_ids", F.col("carried.last_ids").alias("context_id"), "heading_path", text.alias("search_text"), modality(F.col("types")).alias("modality"),
        F.sha2(text, 256).alias("content_hash"),
    )
