"""Scalar behaviour, with outcomes worked out by hand."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from evidara.functions import columns as C
from evidara.operators import evaluate as E
from evidara.operators import formulas as M
from evidara.operators import parse as P


def value(spark, column, **cells):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in cells.items()) or "z int"
    row = tuple(v for _, v in cells.values()) or (1,)
    return spark.createDataFrame([row], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "text,want",
    [
        (None, True),
        ("", True),
        ("  ", False),
        ("a b c", False),
        ("x = 2 - 4 2 b b ac a + -", True),
        ("M + O 2 -> Mg O xx yy", False),
        ("b b 4 a c 2 a word =", True),
        ("b b 4 a c = 2 word word", False),
        ("a plain sentence of words", False),
        ("a b c d e f xrightarrow", True),
    ],
)
def test_unusable(spark, text, want):
    assert value(spark, C.unusable(F.col("t")), t=("string", text)) is want


def test_readable(spark):
    r = lambda t, x: value(spark, C.readable(F.col("t"), F.col("x")), t=("string", t), x=("string", x))
    assert r("fine text here now", "x^2") == "fine text here now"
    assert r("a b c d e f", "x^2") == "x^2" and r("a b c d e f", "") == "a b c d e f" and r(None, None) == ""


def test_tokens_and_query(spark):
    assert value(spark, C.tokens(F.col("t")), t=("string", "Ab-1 c2É d")) == ["ab", "1", "c2", "d"]
    q = lambda t: value(spark, C.scoped_query(F.col("t"), F.lit("10"), F.lit("science")), t=("string", t))
    assert q("What is it?") == "class 10 science, What is it?" and q("  ") == ""


def test_symbols_decoded(spark):
    raw = "x  2 "
    assert value(spark, C.decode_symbols(F.col("t")), t=("string", raw)) == "(x ≥ 2) "
    assert value(spark, C.undecoded(F.col("t")), t=("string", raw)) == [""]


def test_geometry(spark):
    box = lambda l, b, r, t, w=612.0, h=792.0: value(spark, C.region(*(F.lit(float(v)) for v in (l, b, r, t, w, h))))
    top = box(0, 692, 612, 792)
    assert (top["x"], top["y"], top["width"]) == (0, 0, 1) and math.isclose(top["height"], 100 / 792)
    assert box(100, 200, 50, 100) == box(50, 100, 100, 200)
    assert box(-50, -50, 9000, 9000) == box(0, 0, 612, 792)
    assert box(10, 10, 10, 10)["width"] == 1e-6 and box(1, 1, 2, 2, 0.0) is None
    edge = box(612, 0, 612, 792)
    assert edge["x"] + edge["width"] <= 1
    back = value(spark, C.points(C.region(*(F.lit(float(v)) for v in (50, 100, 300, 700, 612, 792))), F.lit(612.0), F.lit(792.0)))
    assert all(math.isclose(a, b) for a, b in zip(back, (50, 100, 300, 700)))


def test_cosine(spark):
    c = lambda a, b: value(spark, C.cosine(F.col("a"), F.col("b")), a=("array<float>", a), b=("array<float>", b))
    assert math.isclose(c([1.0, 1.0], [1.0, 0.0]), math.sqrt(0.5)) and c([0.0], [1.0]) == 0
    assert math.isclose(c([3.0, 4.0, 5.0], [3.0, 4.0]), 25 / (math.sqrt(50) * 5))


def test_hash_bucket(spark):
    want = int.from_bytes(hashlib.sha256(b"force").digest()[:4], "big") % 256
    assert value(spark, C.token_bucket(F.lit("force"))) == want


def test_formula_symbols(spark):
    assert value(spark, C.symbol_text(F.col("t")), t=("string", r"x \geq \frac{1}{2} \pm Y_2")) == "x>/12pmy2"
    s = lambda a, b: value(spark, C.multiset_similarity(F.col("a"), F.col("b")), a=("string", a), b=("string", b))
    assert s("a b", "a b c d e") == 1.0 and s("a a b", "a b") == pytest.approx(2 / 3) and s("", "a") == 0
    assert value(spark, C.formula_segments(F.col("t")), t=("string", r"\begin{aligned} a &= b \\ words only \\ a &= b \end{aligned}")) == [r"a = b \\ words only \\ a = b", "a = b"]


def test_best_match(spark):
    rows = [
        ("f1", "x = - b b 2 4 ac 2 a", r"x = \frac{-b \pm \sqrt{b^2 - 4ac}}{2a}"),
        ("f1", "x = - b b 2 4 ac 2 a", "y = mx + c"),
        ("f2", "a + b = c", r"\begin{aligned} a + b &= c \\ z - q &= w \end{aligned}"),
        ("f3", "p = q r", "just words"),
    ]
    df = spark.createDataFrame(rows, "block_id string, degraded string, candidate string")
    got = {r.block_id: r for r in M.best_match(df).collect()}
    assert set(got) == {"f1", "f2"} and got["f1"].latex.startswith("x = ") and got["f2"].latex == "a + b = c"
    assert got["f2"].confident and got["f2"].order == 1.0
    state = {r.block_id: r.state for r in M.attach(df.select("block_id").distinct(), M.best_match(df)).collect()}
    assert state["f2"] == "attached" and state["f3"] == "no candidate"


def test_clopper_pearson(spark):
    b = lambda s, n: value(spark, E.lower_bound(F.lit(s), F.lit(n)))
    assert b(0, 10) == 0 and b(3, 0) == 0 and b(8, 8) == pytest.approx(0.05 ** (1 / 8))
    for s, n in ((7, 10), (31, 40), (1, 50)):
        p = b(s, n)
        assert sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(s, n + 1)) == pytest.approx(0.05, abs=1e-6)


def test_html(spark):
    html = "<p>a &lt; b</p>\n<div>\n<p class='x'>two\nlines &amp; more</p></div><pre>no</pre>"
    assert value(spark, P.page_text(F.col("t")), t=("string", html)) == "a < b two lines & more no"
    assert value(spark, P.tag_bodies(F.col("t"), "p"), t=("string", html)) == ["a < b", "two\nlines & more"]


def test_page_text_ends_without_spaces_of_any_kind(spark):
    html = "&#5760;<p>&nbsp;&#8195;a&nbsp;b</p><b>&#8195;c &#8203;&#8239;&#8287;</b>"
    assert value(spark, P.page_text(F.col("t")), t=("string", html)) == "a\u00a0b \u2003c \u200b"
    assert value(spark, P.page_text(F.col("t")), t=("string", "<i>&#12288;</i>")) == ""


def test_table_markdown(spark):
    m = lambda rows: value(spark, P.markdown(F.col("t")), t=("array<array<string>>", rows))
    assert m([["a|b", "c"], ["d"]]) == "| a\\|b | c |\n|---|---|\n| d |  |" and m([]) == ""


def test_tree(spark):
    from evidara.plans.fixtures import TREES

    docs = spark.createDataFrame(TREES, "document_id string, json string")
    nodes = P.walk(docs)
    rows = {(r.document_id, r.order_index): r for r in P.tree_blocks(nodes).collect()}
    kinds = [rows[k].block_type for k in sorted(rows) if k[0] == "t1"]
    assert kinds == ["heading", "paragraph", "list", "list_item", "list_item", "caption", "image", "table", "paragraph", "paragraph", "paragraph"]
    table = next(r for r in rows.values() if r.block_type == "table")
    assert table.text == "| a\\|b | c |\n|---|---|\n| d |  |" and table.page == 2
    caption = next(r for r in rows.values() if r.block_type == "caption")
    assert caption.linked_id == "t1:7"
    assert [r.block_type for k, r in sorted(rows.items()) if k[0] == "t2"] == ["unknown", "page_footer"]
