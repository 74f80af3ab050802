"""Small inputs of kinds that the test tables lack: symbol-font texts, parser trees, formulas, and a rerank port."""

from __future__ import annotations

import json

import pandas as pd

#: The characters ()+= as a symbol font has them.
IN_FONT = "\uf028\uf029\uf02b\uf03d"
SYMBOLS = [(1, "a \uf02b b \uf03d c"), (2, "x \uf0b3 2, y \uf0b9 z \uf0b1 \uf061"), (3, "\uf0ff and \ue001 stay \uf0ff"), (4, "plain"), (5, ""), (6, None)]
#: Character references that the pages lack, named and numbered.
REFERENCES = "caf&eacute; &#8217;s &ndash; &#x3B1;&beta; &rarr; &hellip; &nosuch; & so on"
_NODE = {"type": "paragraph", "page number": 1, "bounding box": [72.0, 600.0, 540.0, 640.0]}
TREES = [
    ("t1", json.dumps({"number of pages": 2, "kids": [
        {**_NODE, "type": "heading", "id": 1, "content": "Motion"},
        {**_NODE, "id": 2, "content": "A body moves."},
        {**_NODE, "type": "list", "id": 3, "list items": [{**_NODE, "type": "list item", "id": 4, "content": "first"}, {**_NODE, "type": "list item", "id": 5, "content": "second"}]},
        {**_NODE, "type": "caption", "id": 6, "content": "Fig. 1", "linked content id": 7},
        {**_NODE, "type": "image", "id": 7, "source": "fig1.png"},
        {**_NODE, "type": "image", "id": 8, "source": "missing"},
        {"type": "table", "id": 9, "page number": 2, "bounding box": [50.0, 700.0, 500.0, 100.0], "rows": [
            {"type": "table row", "cells": [{"type": "table cell", "kids": [{**_NODE, "id": 10, "content": "a|b"}]}, {"type": "table cell", "kids": [{**_NODE, "id": 11, "content": "c"}]}]},
            {"type": "table row", "cells": [{"type": "table cell", "kids": [{**_NODE, "id": 12, "content": "d"}]}]}]},
    ]})),
    ("t2", json.dumps({"kids": [{"type": "marginalia", "page number": 3, "bounding box": [-20.0, -5.0, 900.0, 900.0], "content": "odd"}, {"type": "paragraph", "content": "no page"}, {"kids": [{**_NODE, "type": "footer", "content": "7"}]}]})),
    ("t3", json.dumps({"kids": []})),
    ("t4", None),
]
FORMULAS = [
    ("f1", "x = - b b 2 4 ac 2 a", r"x = \frac{-b \pm \sqrt{b^2 - 4ac}}{2a}"),
    ("f1", "x = - b b 2 4 ac 2 a", r"y = mx + c"),
    ("f1", "x = - b b 2 4 ac 2 a", r"a^2 + b^2 = c^2"),
    ("f2", "a + b = c", r"\begin{aligned} a + b &= c \\ a - b &= d \end{aligned}"),
    ("f2", "a + b = c", r"a - b = d"),
    ("f3", "F = m a", "a sentence without any of it"),
    ("f4", "x <= 2 y", r"x \leq 2y"),
    ("f4", "x <= 2 y", r"x \geq 2y"),
]


def shared_words(pdf: pd.DataFrame) -> pd.Series:
    """A rerank port for tests: the share of a question's words that a document has."""
    share = lambda q, d: len(set(q.lower().split()) & set((d or "").lower().split())) / max(1, len(set(q.lower().split())))
    return pd.Series([share(q, d) for q, d in zip(pdf["query"], pdf["document"], strict=True)], index=pdf.index, dtype="float64")
