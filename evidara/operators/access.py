"""Who may see what, and the rules that records must obey (SURVEY 2.2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import vocabulary as V


def licensed(objects: DataFrame, sources: DataFrame, licence: list[str]) -> DataFrame:
    """quarantined objects of quarantined sources that an evaluation licence names."""
    named = sources.filter(F.col("source_id").isin(licence) & (F.col("approval_state") == "quarantined")).select("source_id")
    return objects.filter(F.col("approval_state") == "quarantined").join(named, "source_id", "left_semi").select("object_id", "source_id")


def servable(objects: DataFrame, sources: DataFrame, licence: list[str]) -> DataFrame:
    """Objects that no plan is needed to rule out: approved with their source or licensed, and not retired."""
    s = sources.select("source_id", F.col("approval_state").alias("source_state"))
    both = (F.col("approval_state") == "approved") & (F.col("source_state") == "approved")
    held = (F.col("approval_state") == "quarantined") & (F.col("source_state") == "quarantined") & F.col("source_id").isin(licence)
    return objects.join(s, "source_id").filter((both | held) & ~F.col("retired"))


#: What a plan must share with an object, and what else either has that decides.
CURRICULUM = ["grade", "subject", "board", "version"]
OF_OBJECT, OF_PLAN = ["tenant_scope", "disclosure_rank"], ["tenant", "ceiling_rank"]


def scoped(objects: DataFrame, sources: DataFrame, licence: list[str]) -> DataFrame:
    """object_id of the servable objects with all that decides which plans may rank them."""
    return servable(objects, sources, licence).select("object_id", *CURRICULUM, "tenant_scope", V.rank(F.col("disclosure")).alias("disclosure_rank"))


def may() -> Column:
    """The rest of F1 for rows that CURRICULUM joined."""
    return (F.col("tenant_scope").isNull() | (F.col("tenant_scope") == F.col("tenant"))) & (F.col("disclosure_rank") <= F.col("ceiling_rank"))


def authorised(plans: DataFrame, objects: DataFrame, sources: DataFrame, licence: list[str]) -> DataFrame:
    """plan_id, object_id of all that a plan may rank; an equi-join on the curriculum, the rest as its condition."""
    p = plans.select("plan_id", *CURRICULUM, *OF_PLAN)
    return scoped(objects, sources, licence).join(p, CURRICULUM).filter(may()).select("plan_id", "object_id")


def authorised_pairs(pairs: DataFrame, plans: DataFrame, objects: DataFrame) -> DataFrame:
    """F1 for given pairs (plan_id, object_id); objects: ``scoped``."""
    met = pairs.select("plan_id", "object_id").distinct().join(objects, "object_id")
    return met.join(plans.select("plan_id", *CURRICULUM, *OF_PLAN), ["plan_id", *CURRICULUM]).filter(may()).select("plan_id", "object_id")


def authorised_windows(allowed: DataFrame, windows: DataFrame) -> DataFrame:
    """windows inherit the right of their object."""
    return windows.select("representation_id", "object_id").join(allowed, "object_id").select("plan_id", "representation_id", "object_id")


def unapproved_sources(sources: DataFrame) -> DataFrame:
    """sources that serving refuses unless all of them are licensed."""
    return sources.filter(F.col("approval_state") != "approved").select("source_id", "approval_state")


def serving_licence(sources: DataFrame, pilot: bool) -> list[str]:
    """the sources that serving is lent: none, where all are approved; else all that are not, if this is a pilot, or a refusal.

    A source is lent, not approved: its objects are served only while both are quarantined. The list is as long as the registry
    has unapproved sources, a few thousand at most.
    """
    held = [r["source_id"] for r in unapproved_sources(sources).orderBy("source_id").select("source_id").collect()]
    if held and not pilot:
        raise PermissionError(f"{len(held)} sources are not approved, {held[0]} among them")
    return held


def violations(rows: DataFrame, entity: str, key: str, rules: dict[str, Column]) -> DataFrame:
    """entity, id, rule for every rule, given as the predicate of a violation, that a row breaks."""
    broken = F.array_compact(F.array(*(F.when(p, F.lit(name)) for name, p in rules.items())))
    return rows.select(F.lit(entity).alias("entity"), F.col(key).cast("string").alias("id"), F.explode(broken).alias("rule"))


def source_rules() -> dict[str, Column]:
    """V1, V14."""
    approved = F.col("approval_state") == "approved"
    return {"approved_without_rights_or_scan": approved & ~(F.col("has_rights") & F.col("scanned")), "checksum_format": ~F.col("checksum").rlike("^[0-9a-f]{64}$")}


def block_rules() -> dict[str, Column]:
    """V2, and of V5 what page and order must obey."""
    nothing = (F.coalesce(F.col("text"), F.lit("")) == "") & (F.coalesce(F.col("latex"), F.lit("")) == "")
    return {"block_without_content": nothing, "page_below_one": F.col("page") < 1, "negative_order": F.col("pos") < 0}


def region_rules() -> dict[str, Column]:
    """The rest of V5, for blocks with a region (x, y, width, height) and a confidence, which alone may be null."""
    inside = lambda x: F.coalesce(F.col(x).between(0, 1), F.lit(False))
    return {
        "origin_outside_page": ~(inside("x") & inside("y")),
        "size_outside_page": ~(inside("width") & inside("height")) | (F.col("width") == 0) | (F.col("height") == 0),
        "confidence_outside_bounds": ~F.col("confidence").between(0, 1),
    }


def fallback_rules() -> dict[str, Column]:
    """V8, for plans with on_exhausted and max_corrective_retrievals."""
    return {
        "fallback_not_terminal": ~F.coalesce(F.lower("on_exhausted").isin("clarify", "abstain", "escalate"), F.lit(False)),
        "corrective_retrievals_outside_bounds": ~F.coalesce(F.col("max_corrective_retrievals").between(0, 1), F.lit(False)),
    }


#: The gates of a verification result.
GATES = ("evidence_sufficient", "citations_resolve", "claims_supported", "math_proof_ok", "child_safe", "accessible", "no_answer_leakage", "policy_compliant")


def verification_rules() -> dict[str, Column]:
    """No pass with a failing gate."""
    all_passed = F.lit(True)
    for g in GATES:
        all_passed = all_passed & F.coalesce(F.col(g), F.lit(False))
    return {"pass_with_failing_gate": (F.col("action_taken") == "pass") & ~all_passed}


def repeated_cases(cases: DataFrame) -> DataFrame:
    """Case ids that stand in a gold set more than once."""
    return violations(cases.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")), "case", "case_id", {"repeated_case_id": F.col("n") > 1})


def licence_rules() -> dict[str, Column]:
    """V15, for licences with source_ids, reason and granted_by."""
    blank = lambda x: F.coalesce(F.col(x).rlike(r"^\s*$"), F.lit(True))
    return {"licence_without_source": F.coalesce(F.size("source_ids") < 1, F.lit(True)), "licence_without_reason_or_grantor": blank("reason") | blank("granted_by")}


def gate_config_rules() -> dict[str, Column]:
    """V16, for gate configurations; high_confidence may be null, which is no ceiling."""
    return {"corroboration_below_one": F.col("min_corroboration") < 1, "depth_below_one": F.col("depth") < 1, "ceiling_not_above_floor": F.col("high_confidence") <= F.col("threshold")}


def object_rules() -> dict[str, Column]:
    """V3."""
    return {"solution_made_public": F.col("object_type").isin("solution", "rubric", "answer") & (F.col("disclosure") == "public")}


def window_rules() -> dict[str, Column]:
    """V4."""
    return {"blank_search_text": F.trim("search_text") == "", "vector_without_model": F.col("vector").isNull() != F.col("model").isNull()}


def plan_rules() -> dict[str, Column]:
    """V6, V7, V9: ceilings, slot bounds, and what a graded or misconception plan must not lack or hold."""
    s = F.col("slots")
    return {
        "ceiling_above_assessment_state": F.col("asked_rank") > F.col("ceiling_rank"),
        "slot_min_above_max": F.exists(s, lambda x: x["min_items"] > x["max_items"]),
        "required_slot_without_minimum": F.exists(s, lambda x: x["required"] & (x["min_items"] < 1)),
        "graded_plan_with_banned_role": (F.col("assessment_state") == "graded") & F.exists(s, lambda x: x["role"].isin(V.GRADED_BANNED)),
        "misconception_without_hypothesis": (F.col("teaching_action") == "misconception_correction") & F.col("hypothesis").isNull(),
    }


def pack_rules() -> dict[str, Column]:
    """The rest of V10, for packs with status, items and whether the gate let them pass."""
    enough = F.col("status") == "sufficient"
    return {"sufficient_without_evidence": enough & (F.col("items") < 1), "sufficient_against_the_gate": enough & ~F.col("answerable")}


def rights_problems(sources: DataFrame, today: str) -> DataFrame:
    """What keeps a source from registration, as a list in this order; sources without problems do not appear."""
    checks = [
        (F.col("declared_checksum") != F.col("checksum"), "checksum differs"),
        (~F.col("scanned"), "not scanned"),
        (~F.col("permits_storage"), "storage not permitted"),
        (~F.col("permits_display"), "display not permitted"),
        (~F.col("permits_processing"), "processing not permitted"),
        (F.col("term_expires") < F.to_date(F.lit(today)), "term expired"),
    ]
    found = F.array_compact(F.array(*(F.when(p, F.lit(m)) for p, m in checks)))
    return sources.select("source_id", F.array_join(found, "; ").alias("problems")).filter("problems <> ''")


def dangling(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Citations of objects that are not in the pack."""
    return citations.join(evidence.select("plan_id", "object_id"), ["plan_id", "object_id"], "left_anti")
