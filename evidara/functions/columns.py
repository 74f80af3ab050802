"""Column functions: every one is a composition of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points of a symbol font in private use, and the glyphs they stand for.
SYMBOL_GLYPHS = {
    "\uf028": "(",
    "\uf029": ")",
    "\uf02b": "+",
    "\uf02d": "\u2212",
    "\uf03d": "=",
    "\uf061": "α",
    "\uf0b1": "±",
    "\uf0b3": "≥",
    "\uf0b9": "≠",
    "\uf0d0": "∠",
    "\uf0d7": "⋅",
}
#: Share of one-character tokens above which a text is unusable, with and without a balanced relation.
LOOSE_ALWAYS, LOOSE_WITHOUT_RELATION, LEAST_TOKENS = 0.85, 0.55, 4
RELATION = r"(?s)[A-Za-z0-9].*(?:[=<>≤≥→]|->|rightarrow).*[A-Za-z0-9]"


def collapse(text: Column) -> Column:
    """White space runs become one space, none at the ends, where no other space of Unicode stays either."""
    return F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"^\p{Zs}+|\p{Zs}+\z", "")


def tokens(text: Column) -> Column:
    """F8: runs of a-z and 0-9 of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def text_of(text: Column, latex: Column) -> Column:
    """the text, or the formula source if there is none, with white space collapsed."""
    return collapse(F.coalesce(F.when(text != "", text), latex, F.lit("")))


def scoped_query(query: Column, grade: Column, subject: Column) -> Column:
    """the question with its class and subject in front; a blank one stays empty."""
    return F.when(F.trim(query) == "", "").otherwise(F.concat(F.lit("class "), grade, F.lit(" "), subject, F.lit(", "), query))


def is_statement(text: Column, openers: list[str]) -> Column:
    """the text begins with one of the openers, whatever its case."""
    return F.lower(F.trim(text)).rlike("^(" + "|".join(openers) + ")")


def balanced_relation(text: Column) -> Column:
    """some relation sign has a letter or digit on both sides."""
    return F.replace(text, F.lit("xrightarrow"), F.lit("→")).rlike(RELATION)


def unusable(text: Column) -> Column:
    """nothing, or mostly loose single characters that no relation holds together."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    loose = F.size(F.filter(words, lambda w: F.length(w) == 1)) / F.size(words)
    return (
        F.when(text.isNull() | (text == ""), True)
        .when(F.size(words) < LEAST_TOKENS, False)
        .when(loose > LOOSE_ALWAYS, True)
        .otherwise((loose > LOOSE_WITHOUT_RELATION) & ~balanced_relation(text))
    )


def readable(text: Column, latex: Column) -> Column:
    """usable text, else the formula source, else whatever text there is."""
    return F.coalesce(F.when(~unusable(text), text), F.when(latex != "", latex), text, F.lit(""))


def decode_symbols(text: Column) -> Column:
    """F16: known private-use code points become their glyphs; others stay."""
    return F.translate(text, "".join(SYMBOL_GLYPHS), "".join(SYMBOL_GLYPHS.values()))


def undecoded(text: Column) -> Column:
    """the private-use characters of a text that no glyph is known for."""
    known = F.array(*(F.lit(c) for c in SYMBOL_GLYPHS))
    return F.array_sort(F.array_except(F.array_distinct(F.regexp_extract_all(text, F.lit("[\ue000-\uf8ff]"), F.lit(0))), known))


def region(left: Column, bottom: Column, right: Column, top: Column, width: Column, height: Column) -> Column:
    """page points, origin below, become shares of the page, origin above; null for a page without size."""
    clamp = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    x0, x1 = F.least(left, right) / width, F.greatest(left, right) / width
    y0, y1 = 1 - F.greatest(bottom, top) / height, 1 - F.least(bottom, top) / height
    w = F.greatest(clamp(x1) - clamp(x0), F.lit(1e-6))
    h = F.greatest(clamp(y1) - clamp(y0), F.lit(1e-6))
    made = F.struct(F.least(clamp(x0), 1 - w).alias("x"), F.least(clamp(y0), 1 - h).alias("y"), w.alias("width"), h.alias("height"))
    return F.when((width > 0) & (height > 0), made)


def points(box: Column, width: Column, height: Column) -> Column:
    """the inverse of ``region``."""
    left, top = box["x"] * width, (1 - box["y"]) * height
    return F.struct(left.alias("left"), (top - box["height"] * height).alias("bottom"), (left + box["width"] * width).alias("right"), top.alias("top"))


def cosine(a: Column, b: Column) -> Column:
    """cosine over the shorter length in double precision, 0 if a norm is 0."""
    n = F.least(F.size(a), F.size(b))
    return F.when((norm(a) == 0) | (norm(b) == 0), 0.0).otherwise(dot(F.slice(a, 1, n), F.slice(b, 1, n)) / (norm(a) * norm(b)))


def norm(a: Column) -> Column:
    """Euclidean length in double precision."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    """Sum of products; what one vector has beyond the other's end counts as nothing."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def token_bucket(token: Column, buckets: int = 256) -> Column:
    """bucket of a token by the first four bytes of its SHA-256."""
    return F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("long") % buckets


def parse_vector(value: Column) -> Column:
    """A vector from its text form."""
    return F.from_json(value, "array<double>")


def reference_suffix(ref: Column) -> Column:
    """a reference path as one word; nothing is unknown."""
    parts = F.filter(F.split(F.regexp_replace(F.coalesce(ref, F.lit("")), "^#", ""), "/"), lambda p: p != "")
    return F.when(F.size(parts) == 0, "unknown").otherwise(F.array_join(parts, "-"))


# What a reader sees for a command; applied in this order, each over the whole text.
FORMULA_WORDS = {
    "\\pm": " pm ",
    "\\mp": " pm ",
    "\\times": " * ",
    "\\cdot": " * ",
    "\\div": " / ",
    "\\geq": " > ",
    "\\leq": " < ",
    "\\neq": " = ",
    "\\sqrt": " sqrt ",
    "\\frac": " / ",
    "\\le": " < ",
    "\\ge": " > ",
}


def symbol_text(text: Column) -> Column:
    """M1: letters, digits and signs that a reader would take from a formula, in order and lower-cased."""
    for command, seen in FORMULA_WORDS.items():
        text = F.replace(text, F.lit(command), F.lit(seen))
    bare = F.regexp_replace(text, r"\\(?:begin|end)\{[a-z*]+\}|\\[a-zA-Z]+", " ")
    return F.lower(F.regexp_replace(bare, r"[^a-zA-Z0-9+\-=<>*/^]", ""))


def symbols(text: Column) -> Column:
    return F.filter(F.split(symbol_text(text), ""), lambda c: c != "")


def multiset_similarity(damaged: Column, candidate: Column) -> Column:
    """M2: share of the damaged text's symbols that the candidate has too, counted with multiplicity."""
    a, b = symbols(damaged), symbols(candidate)
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    common = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))
    return F.when(F.size(a) == 0, 0.0).otherwise(common / F.size(a))


def formula_segments(text: Column) -> Column:
    """M3: a candidate and its lines, without environments and alignment marks, in order, that hold a relation or operator."""
    noise = r"\\(?:begin|end)\{[a-z*]+\}|\s*&\s*"
    lines = F.concat(F.array(text), F.split(text, r"\\\\|\n"))
    return F.filter(F.array_distinct(F.transform(lines, lambda s: collapse(F.regexp_replace(s, noise, " ")))), lambda s: s.rlike(r"[=+\-<>/^]"))
