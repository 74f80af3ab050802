"""Parser output to blocks, sections and diffs."""

from __future__ import annotations

import html
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources import vocabulary as V

TEXT_RATIO = 0.5
#: Node types of the tree parser and the block types they become; others are unknown.
TREE_TYPES = {"heading": "heading", "paragraph": "paragraph", "text block": "text_block", "list": "list", "list item": "list_item", "table": "table", "image": "image", "caption": "caption", "header": "page_header", "footer": "page_footer", "formula": "formula"}
CONTAINERS = {"table row", "table cell", "row", "cell"}
DEFAULT_PAGE = (612.0, 792.0)
CHILD_LISTS = ("kids", "list items", "rows", "cells")


def _unescaped(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def _all_unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(lambda xs: [None if x is None else html.unescape(x) for x in xs], na_action="ignore")


def unescape(text: Column) -> Column:
    """Every character reference of HTML, named or numbered; texts without an ampersand do not leave the JVM."""
    return F.coalesce(F.pandas_udf(_unescaped, "string")(F.when(text.contains("&"), text)), text)


def page_text(page: Column) -> Column:
    """Tags become spaces, entities characters, white space single spaces."""
    return C.collapse(unescape(F.regexp_replace(page, "<[^>]+>", " ")))


def tag_bodies(page: Column, tag: str, attribute: str = "") -> Column:
    """The unescaped bodies of all elements of a kind, in order, whatever lines they span; only those with the attribute, if one is named."""
    wanted = f"\\s(?:[^>]*\\s)?{re.escape(attribute)}(?:\\s[^>]*)?" if attribute else "(?:\\s[^>]*)?"
    bodies = F.regexp_extract_all(page, F.lit(f"(?s)<{tag}{wanted}>(.*?)</{tag}>"), F.lit(1))
    return F.coalesce(F.pandas_udf(_all_unescaped, "array<string>")(F.when(F.exists(bodies, lambda x: x.contains("&")), bodies)), bodies)


def walk(documents: DataFrame) -> DataFrame:
    """document_id, position, type, node of every typed node of a JSON tree, depth first, parents before children.

    The tree's depth is not bounded, so rows of documents go to Python in Arrow batches; one document is in one row.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for document_id, raw in zip(pdf["document_id"], pdf["json"], strict=True):
                for k, (n, text) in enumerate(typed_nodes(json.loads(raw)) if raw else []):
                    box = n.get("bounding box") or [None] * 4
                    rows.append((document_id, k, n["type"], n.get("id"), n.get("page number"), *map(lambda v: None if v is None else float(v), box), text, n.get("linked content id"), n.get("source"), table_markdown(n) if n["type"] == "table" else None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in NODES.split(", ")])

    return documents.select("document_id", "json").mapInPandas(run, NODES)


NODES = "document_id string, position long, type string, node_id long, page int, l double, b double, r double, t double, text string, linked_id long, source string, markdown string"


def typed_nodes(tree) -> list[tuple[dict, str]]:
    """The typed nodes of a tree, depth first, parents before children, each with the text of it and of all below it.

    All contents are gathered once in that order; a node's text is the stretch between its first and last. No recursion, so
    any depth will do.
    """
    found, parts, stack = [], [], [(tree, None)]
    while stack:
        node, opened = stack.pop()
        if opened is not None:  # all below the node is done
            opened[2] = len(parts)
        elif isinstance(node, list):
            stack += [(x, None) for x in reversed(node)]
        elif isinstance(node, dict):
            if node.get("type"):
                found.append([node, len(parts), None])
                stack.append((None, found[-1]))
            if isinstance(node.get("content"), str) and node["content"]:
                parts.append(node["content"])
            stack += [(node[key], None) for key in reversed(CHILD_LISTS) if key in node]
    return [(node, " ".join(parts[low:high])) for node, low, high in found]


def text_under(node) -> str:
    """The text of a node and of all below it, joined by spaces."""
    return typed_nodes({"type": "any", "kids": node})[0][1]


def table_markdown(node) -> str:
    """A table as lines of cells between bars; short rows are padded, bars in cells escaped."""
    rows = [[text_under(c).replace("|", "\\|") for c in (r.get("cells") or [])] for r in node.get("rows") or []]
    width = max(map(len, rows), default=0)
    if not width:
        return ""
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "|" + "---|" * width, *lines[1:]])


def markdown(rows: Column) -> Column:
    """P2 for array<array<string>> columns, in built-in expressions."""
    width = F.array_max(F.transform(rows, F.size))
    cell = lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---|"), width), ""))
    lines = F.transform(rows, line)
    return F.when(F.coalesce(width, F.lit(0)) == 0, "").otherwise(F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))), "\n"))


def tree_blocks(nodes: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Blocks of walked nodes. Containers, nodes without page or box, and images without a file are left out.

    The order index is the place among all typed nodes, so it has gaps. A page of unknown size is DEFAULT_PAGE.
    """
    kind = F.coalesce(V.lookup(TREE_TYPES, F.col("type")), F.lit("unknown"))
    rows = nodes.filter(~F.col("type").isin(*CONTAINERS) & F.col("page").isNotNull() & F.col("l").isNotNull())
    rows = rows.filter((F.col("type") != "image") | F.coalesce(F.col("source") != "missing", F.lit(False)))
    if sizes is not None:
        rows = rows.join(sizes.select("document_id", "page", "width", "height"), ["document_id", "page"], "left")
    else:
        rows = rows.select("*", F.lit(None).cast("double").alias("width"), F.lit(None).cast("double").alias("height"))
    w, h = F.coalesce("width", F.lit(DEFAULT_PAGE[0])), F.coalesce("height", F.lit(DEFAULT_PAGE[1]))
    box = C.region(F.col("l"), F.col("b"), F.col("r"), F.col("t"), w, h)
    text = F.when(F.col("type") == "table", F.col("markdown")).otherwise(F.col("text"))
    link = F.when(F.col("linked_id").isNotNull(), F.concat_ws(":", "document_id", F.col("linked_id").cast("string")))
    return rows.select("document_id", F.col("position").alias("order_index"), kind.alias("block_type"), F.col("type").alias("raw_label"), "page", box.alias("region"), text.alias("text"), link.alias("linked_id"))


def grid_markdown(cells: DataFrame) -> DataFrame:
    """document_id, markdown of a grid of cells (row, col, text, n_rows, n_cols, seq): cells outside are ignored, later
    ones win, a grid without text is empty."""
    inside = cells.filter(F.col("row").between(0, F.col("n_rows") - 1) & F.col("col").between(0, F.col("n_cols") - 1))
    last = inside.groupBy("document_id", "row", "col").agg(F.max_by("text", "seq").alias("text"))
    shape = cells.groupBy("document_id").agg(F.max("n_rows").alias("n_rows"), F.max("n_cols").alias("n_cols"))
    spots = shape.select("document_id", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("row"), "n_cols").select("document_id", "row", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)).alias("col"))
    full = spots.join(last, ["document_id", "row", "col"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    ordered = lambda s: F.transform(F.array_sort(F.collect_list(s)), lambda x: x["v"])
    lines = full.groupBy("document_id", "row").agg(ordered(F.struct("col", F.col("text").alias("v"))).alias("v"))
    grids = lines.groupBy("document_id").agg(ordered(F.struct("row", "v")).alias("rows"))
    some = F.exists("rows", lambda r: F.exists(r, lambda c: c != ""))
    return grids.select("document_id", F.when(some, markdown(F.col("rows"))).otherwise("").alias("markdown"))


def layout_blocks(items: DataFrame) -> DataFrame:
    """P5: items (document_id, ref, page, l, t, text) by page, from the top, from the left; empty ones are left out after counting."""
    w = Window.partitionBy("document_id").orderBy("page", F.desc("t"), "l", "ref")
    rows = items.withColumn("order_index", (F.row_number().over(w) - 1).cast("long"))
    return rows.filter(F.coalesce("text", F.lit("")) != "").select("document_id", "order_index", F.concat_ws(":", "document_id", C.reference_suffix(F.col("ref"))).alias("block_id"), "page", "text")


def empty_pages(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pages from 1 to a document's number of pages that no block is on."""
    pages = documents.select("document_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("pages").cast("long"))).alias("page"))
    return pages.join(blocks.select("document_id", F.col("page").cast("long").alias("page")).distinct(), ["document_id", "page"], "left_anti")


def diff(a: DataFrame, b: DataFrame, name_a: str, name_b: str) -> DataFrame:
    """Page by page, why two readings (document_id, page, block_type, text) differ, if they do.

    Formulas are compared only in documents where both readings label any.
    """
    per = lambda d, s: d.groupBy("document_id", "page").agg(F.count(F.lit(1)).alias(f"blocks_{s}"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias(f"chars_{s}"), F.count_if(F.col("block_type") == "formula").alias(f"formulas_{s}"))
    pages = per(a, "a").join(per(b, "b"), ["document_id", "page"], "full_outer").na.fill(0)
    whole = Window.partitionBy("document_id")
    both = (F.sum("formulas_a").over(whole) > 0) & (F.sum("formulas_b").over(whole) > 0)
    none_a, none_b = F.col("blocks_a") == 0, F.col("blocks_b") == 0
    ratio = F.least("chars_a", "chars_b") / F.nullif(F.greatest("chars_a", "chars_b"), F.lit(0))
    thin = ~none_a & ~none_b & (F.col("chars_a") > 0) & (F.col("chars_b") > 0) & (ratio < TEXT_RATIO)
    one = (F.col("formulas_a") == 0) != (F.col("formulas_b") == 0)
    pages = pages.withColumn("both", both)
    reasons = F.array_compact(F.array(
        F.when(none_a & ~none_b, f"{name_a} produced no blocks"), F.when(none_b & ~none_a, f"{name_b} produced no blocks"),
        F.when(thin, F.concat(F.when(F.col("chars_a") < F.col("chars_b"), name_a).otherwise(name_b), F.lit(" recovered less of the text"))),
        F.when(F.col("both") & one, F.concat(F.lit("only "), F.when(F.col("formulas_a") > 0, name_a).otherwise(name_b), F.lit(" found formulas"))),
    ))
    return pages.select("document_id", F.col("page").cast("long").alias("page"), "blocks_a", "blocks_b", "chars_a", "chars_b", F.array_join(reasons, "; ").alias("reasons"))


def sections(blocks: DataFrame, starts: Column, version: str) -> DataFrame:
    """Sections from one starting block to the next; blocks before the first start are dropped.

    Sections are numbered as they start, also those that turn out blank and are left out. blocks: document_id, pos,
    block_id, block_type, text.
    """
    w = Window.partitionBy("document_id").orderBy("pos")
    rows = blocks.withColumn("number", F.sum(F.when(starts, 1).otherwise(0)).over(w)).filter((F.col("number") > 0) & ~F.col("block_type").isin(V.NON_CONTENT))
    bs = F.array_sort(F.collect_list(F.struct("pos", "block_id", F.coalesce("text", F.lit("")).alias("text"))))
    made = rows.groupBy("document_id", "number").agg(bs.alias("bs"), F.bool_or(F.col("block_type") == "formula").alias("formula"))
    text = F.array_join(F.filter(F.transform("bs", lambda x: x["text"]), lambda t: t != ""), "\n\n")
    made = made.withColumn("text", text).filter(F.trim("text") != "")
    return made.select(
        F.concat_ws(":", "document_id", F.lit(version), F.col("number").cast("string")).alias("object_id"), F.get("bs", F.lit(0))["text"].alias("heading"), F.size("bs").cast("long").alias("n_blocks"),
        F.when(F.col("formula"), "equation").otherwise("text").alias("modality"), F.sha2("text", 256).alias("content_hash"),
    )
