"""Small closed vocabularies of the data model, as fixed values."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Disclosure classes by rank, and the most that an assessment state may disclose.
DISCLOSURE = ["public", "hint_gated", "worked_step", "final_answer", "solution", "rubric", "protected_item"]
DISCLOSURE_RANK = {name: k for k, name in enumerate(DISCLOSURE)}
CEILING = {
    "learn": "worked_step",
    "guided_practice": "hint_gated",
    "homework": "hint_gated",
    "graded": "public",
    "post_submission": "solution",
    "revision": "worked_step",
}
# What evidence each teaching action asks for, in slot order.
ROLES = {
    "explain": ["definition", "explanation"],
    "explain_simpler": ["explanation", "example"],
    "prerequisite_repair": ["prerequisite", "explanation"],
    "misconception_correction": ["misconception", "correction", "counterexample"],
    "socratic_question": ["explanation"],
    "hint_1": ["hint"],
    "hint_2": ["hint"],
    "hint_3": ["hint"],
    "worked_example": ["worked_example"],
    "practice_item": ["practice_item"],
    "answer_feedback": ["explanation"],
    "revision": ["definition", "example"],
    "enrichment": ["example"],
    "escalation": ["explanation"],
}
GRADED_BANNED = ["rubric", "worked_example"]
TEACHING_TYPES = ["definition", "concept"]
FORMULA_LIKE = ["formula", "code"]
NON_CONTENT = ["page_header", "page_footer"]


def lookup(values: dict, key: Column) -> Column:
    """values[key] as a column, null where the key is unknown."""
    pick = lambda v: F.array(*(F.lit(x) for x in v)) if isinstance(v, list) else F.lit(v)
    return F.create_map(*chain.from_iterable((F.lit(k), pick(v)) for k, v in values.items()))[key]


def rank(disclosure: Column) -> Column:
    return lookup(DISCLOSURE_RANK, disclosure)
