"""Retrieval, gate, packs and scores on small corpora, and the queries' oracles on the smallest tables."""

import html
import math
import pathlib
import random
import re
import shutil
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from evidara.operators import access as A
from evidara.operators import decide as D
from evidara.operators import evaluate as E
from evidara.operators import parse as P
from evidara.operators import retrieve as R
from evidara.operators import store as S
from evidara.sources import vocabulary as V
from evidara.sources.stage import cut
from evidara.sources.testdata import containing

DATA = "/root/testdata/sf0.001"
ITEM = "plan_id string, object_id string, representation_id string, score double, rank long"


def test_hybrid(spark):
    mk = lambda rows: spark.createDataFrame(rows, ITEM)
    lexical = mk([("p", "a", "a1", 0.31, 1), ("p", "b", "b1", 0.22, 2), ("q", "b", "b1", 0.5, 1), ("q", "a", "a1", 0.4, 2), ("r", "d", "d1", 0.44, 1)])
    dense = mk([("p", "a", "a1", 0.82, 1), ("p", "c", "c1", 0.61, 2), ("q", "c", "c1", 0.9, 1), ("q", "b", "b1", 0.8, 2)])
    all_ = dense.select("plan_id", "representation_id", "object_id", "score")
    got = {(r.plan_id, r.rank): r for r in R.hybrid_topk(lexical, dense, all_).collect()}
    assert (got["p", 1].object_id, got["p", 1].score) == ("a", 0.82)
    order = [got["q", k].object_id for k in (1, 2, 3)]
    assert order.index("b") < order.index("c") and got["r", 1].score == 0.44


@pytest.mark.parametrize("score,shared,ceiling,kind,answer", [(0.3, 3, 0.8, "example", False), (0.6, 2, 0.8, "example", True), (0.6, 1, 0.8, "example", False), (0.6, 1, 0.8, "definition", True), (0.95, 0, 0.8, "example", True), (0.8, 0, 0.8, "example", True), (0.5, 2, 0.8, "example", True), (0.99, 0, float("inf"), "example", False), (None, 0, 0.8, "example", False)])
def test_gate(spark, score, shared, ceiling, kind, answer):
    mine = [("p", f"o{k}", f"w{k}", score - k / 1000, k + 1) for k in range(3)] if score is not None else []
    theirs = [("p", f"o{k}" if k < shared else f"z{k}", f"w{k}" if k < shared else f"z{k}", 0.9 - k / 10, k + 1) for k in range(3)]
    windows = spark.createDataFrame([(f"{a}{k}", [f"{a}{k}:b"]) for a in "wz" for k in range(3)], "representation_id string, block_ids array<string>")
    objects = spark.createDataFrame([(f"o{k}", kind) for k in range(3)], "object_id string, object_type string")
    plans = spark.createDataFrame([("p",)], "plan_id string")
    got = D.gate(plans, spark.createDataFrame(mine, ITEM), spark.createDataFrame(theirs, ITEM), windows, objects, 0.5, ceiling).first()
    assert got.answerable is answer and (got.reasons == "") is answer


def test_window_budget(spark):
    rows = [("p", "o", f"w{k}", s) for k, s in enumerate([0.9, 0.89, 0.88, 0.879, 0.95])] + [("p", "x", "x1", 0.5), ("p", "x", "x2", 0.3)]
    got = R.window_budget(spark.createDataFrame(rows, "plan_id string, object_id string, representation_id string, score double"))
    assert {r.representation_id for r in got.collect()} == {"w4", "x1"}


def test_bm25_saturates_and_needs_a_query(spark):
    windows = spark.createDataFrame([("w1", "o1", "gas " + "x " * 7), ("w8", "o8", "gas " * 8), ("n", "on", "y " * 8)], "representation_id string, object_id string, search_text string")
    plans = spark.createDataFrame([("p", "gas"), ("blank", "")], "plan_id string, scoped string")
    allowed = plans.select("plan_id").crossJoin(windows.select("representation_id", "object_id"))
    got = {(r.plan_id, r.representation_id): r.score for r in R.bm25_scores(plans, windows, allowed).collect()}
    assert set(got) == {("p", "w1"), ("p", "w8")} and got["p", "w1"] < got["p", "w8"] < 4 * got["p", "w1"]


def small(spark):
    """Six topics, each with a right passage, one of a lower class, and a solution; a foreign tenant's and a quarantined one."""
    rng = random.Random(3)
    objects, cases = [], []
    for t in range(6):
        words = [f"topic{t}w{k}" for k in range(8)]
        body = lambda: " ".join(rng.sample(words, 6))
        objects += [(f"right{t}", "s1", "explanation", "public", "10", None, "approved", body()), (f"low{t}", "s2", "explanation", "public", "7", None, "approved", body()), (f"key{t}", "s1", "solution", "solution", "10", None, "approved", body())]
        cases.append((f"c{t}", " ".join(words), True))
    objects += [("foreign", "s1", "explanation", "public", "10", "other", "approved", "topic0w1 topic1w1"), ("held", "s3", "explanation", "public", "10", None, "quarantined", "topic0w1")]
    cases += [(f"u{t}", f"nothing{t} like this", False) for t in range(3)]
    o = spark.createDataFrame([(*x, False, "pilot", "v", "h") for x in objects], "object_id string, source_id string, object_type string, disclosure string, grade string, tenant_scope string, approval_state string, text string, retired boolean, board string, version string, heading_path string").withColumn("subject", F.lit("science"))
    s = spark.createDataFrame([("s1", "approved"), ("s2", "approved"), ("s3", "quarantined")], "source_id string, approval_state string")
    p = spark.createDataFrame(cases, "case_id string, query string, answerable boolean").select(F.concat(F.lit("plan-"), "case_id").alias("plan_id"), "case_id", "query", "answerable", F.lit("10").alias("grade"), F.lit("science").alias("subject"), F.lit("pilot").alias("board"), F.lit("v").alias("version"), F.lit("me").alias("tenant"), F.lit(V.DISCLOSURE_RANK["worked_step"]).alias("ceiling_rank"))
    return o, s, p


def seen_windows(spark):
    o, s, p = small(spark)
    p = p.withColumn("scoped", F.concat(F.lit("class 10 science, "), "query"))
    w = o.select(F.explode(F.array(F.lit("1"), F.lit("2"))).alias("n"), "*").select(F.concat_ws(":", "object_id", "n").alias("representation_id"), "object_id", F.when(F.col("n") == "1", F.col("text")).otherwise(F.concat("text", F.lit(" Topic0w1, science; nothing else"))).alias("search_text"))
    return p, w, A.scoped(o, s, ["s3"]), A.authorised_windows(A.authorised(p, o, s, ["s3"]), w)


@pytest.mark.parametrize("few", [0, R.FEW])
def test_windows_meet_only_queries_that_may_see_them(spark, monkeypatch, few):
    monkeypatch.setattr(R, "FEW", few)
    p, w, objects, allowed = seen_windows(spark)
    q = R.bm25_terms(p, w)
    rows = lambda df: sorted((r.plan_id, r.representation_id, r.object_id, r.score) for r in df.collect())
    hits = R.matched(p, q, w, objects)
    assert hits.join(allowed, ["plan_id", "representation_id"], "left_anti").count() == 0 < hits.count()
    assert rows(R.bm25_of(hits)) == rows(R.bm25_scores(p, w, allowed))
    got = R.keyword_of(R.matched(p, R.keyword_terms(p, w), w, objects))
    want = R.keyword_scores(p, w, "representation_id", F.col("search_text"), allowed.select("plan_id", "representation_id"))
    assert [(a, b, d) for a, b, _, d in rows(got)] == sorted((r.plan_id, r.representation_id, r.score) for r in want.collect())


def test_scores_are_ranked_where_they_are_made(spark):
    """What plans may see, plans times their share of the corpus, is never dealt out: texts go to their objects, and k rows of a plan to it."""
    p, w, objects, _ = seen_windows(spark)
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    [spark.conf.set(k, v) for k, v in zip(was, ("false", "-1"), strict=True)]
    try:
        path = "/tmp/" + uuid.uuid4().hex
        for name, df in (("w", w), ("o", objects), ("q", R.bm25_terms(p, w)), ("p", p)):
            df.write.parquet(f"{path}/{name}")
        w, objects, q, p = (spark.read.parquet(f"{path}/{name}") for name in "woqp")
        v = w.select("representation_id", "object_id", F.array(F.lit(1.0)).alias("vector"))
        o = small(spark)[0]
        for kind in ("wrong_grade", "answer_only", "cross_tenant"):
            plan = R.broken_topk(p, o, kind)._jdf.queryExecution().executedPlan().toString()
            assert not re.search(r"Join \[plan_id#\d+, object_id", plan) and len(re.findall(r"Exchange hashpartitioning\(plan_id#\d+, object_id", plan)) <= 1, plan
        for scores in (R.bm25_of(R.matched(p, q, w, objects)), R.dense_matched(p, p.select("plan_id", F.array(F.lit(1.0)).alias("query_vector")), v, objects)):
            plan = R.object_topk(scores)._jdf.queryExecution().executedPlan().toString()
            dealt = [re.sub(r"#\d+", "", x) for x in re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", plan)]
            assert [x for x in dealt if x.startswith("plan_id") and "object_id" not in x] and not [x for x in dealt if "plan_id" in x and ("object_id" in x or "representation_id" in x)], plan
    finally:
        [spark.conf.set(k, v) for k, v in was.items()]
        shutil.rmtree(path, ignore_errors=True)


def test_skipped_windows_are_counted_for_all_objects_alike(spark):
    p, w, objects, allowed = seen_windows(spark)
    v = w.select("representation_id", "object_id", F.when(F.col("representation_id").endswith("1"), F.array(F.lit(1.0))).alias("vector"))
    want = allowed.join(v.select("representation_id", "vector"), "representation_id").groupBy("plan_id").agg(F.count_if(F.col("vector").isNull()).alias("skipped"), F.count(F.lit(1)).alias("windows"))
    assert {tuple(r) for r in R.skipped(p, v, objects).collect()} == {tuple(r) for r in want.collect()} != set()
    q = p.select("plan_id", F.array(F.lit(0.5)).alias("query_vector"))
    assert {tuple(r) for r in R.dense_matched(p, q, v, objects).collect()} == {tuple(r) for r in R.dense_scores(q, v, allowed).collect()} != set()


def test_the_report_of_all_retrievers_is_planned_one_by_one(spark):
    from evidara.plans import queries as Q

    plan = Q.queries()["broken_detection"](spark, DATA)._jdf.queryExecution().analyzed().toString()
    assert plan.count("\n") < 100 and "documents" not in plan


def test_broken_retrievers_are_caught(spark):
    o, s, p = small(spark)
    allowed = A.authorised(p, o, s, []).cache()
    lent = A.licensed(o, s, [])
    assert {r.object_id for r in allowed.collect()} == {f"right{t}" for t in range(6)}
    total = lambda items: sum(sum(r[1:]) for r in E.violations(items, p, o, s, allowed, lent).collect())
    good = R.top(R.keyword_scores(p, o, "object_id", F.col("text"), allowed), ["plan_id"], 5, *R.by_score("object_id"))
    best = {r.plan_id: r.object_id for r in good.filter("rank = 1").collect()}
    assert all(best[f"plan-c{t}"] == f"right{t}" for t in range(6)) and total(good) == 0
    assert total(R.random_topk(allowed, "s", 5)) == 0
    for kind in ("wrong_grade", "answer_only", "cross_tenant"):
        assert total(R.broken_topk(p, o, kind, 5)) > 0


def test_licence_opens_only_quarantine(spark):
    o, s, p = small(spark)
    assert {r.object_id for r in A.licensed(o, s, ["s3", "s1"]).collect()} == {"held"}
    assert "held" in {r.object_id for r in A.authorised(p, o, s, ["s3"]).collect()}


def test_calibration(spark):
    rows = spark.createDataFrame([(True, x / 10) for x in (9, 8, 7, 6, 5, 9, 9, 9, 9, 4)] + [(False, 0.3), (False, 0.45)], "answerable boolean, top_score double")
    mid = E.calibrate(rows).first()
    assert (mid.threshold, mid.margin) == (0.425, -0.05) and mid.false_abstain_rate == 0.1 and mid.refused_rate == 0.5
    assert E.calibrate(rows, 0.19).first().threshold == 0.5 and E.calibrate(rows, 0.0).first().threshold == 0.4


def test_distinctive_failures(spark):
    rows = spark.createDataFrame([("grade=10", "pack"), ("grade×subject=10×a", "pack"), ("grade×subject=7×b", "candidates")], "slice string, failure string")
    assert {r.slice for r in E.distinctive_failures(rows).collect()} == {"grade=10", "grade×subject=7×b"}


def test_slots_and_status(spark):
    plans = D.query_plans(spark.createDataFrame([("a", "misconception_correction", "learn"), ("b", "worked_example", "graded"), ("c", "hint_1", "homework")], "case_id string, teaching_action string, assessment_state string"))
    got = {r.case_id: r for r in plans.collect()}
    assert [x.role for x in got["a"].slots] == ["misconception", "correction", "counterexample"] and got["a"].hypothesis == "a-misconception"
    assert [x.role for x in got["b"].slots] == ["explanation"] and got["b"].ceiling == "public"
    packed = spark.createDataFrame([("plan-a", "o1", 1), ("plan-a", "o2", 2), ("plan-c", "o3", 1), ("plan-c", "o4", 2)], "plan_id string, object_id string, rank long")
    decisions = spark.createDataFrame([("plan-a", True, ""), ("plan-b", False, "below floor"), ("plan-c", True, "")], "plan_id string, answerable boolean, reasons string")
    filled = D.slot_fill(packed, plans)
    assert {(r.plan_id, r.rank): r.slot_id for r in filled.collect()}["plan-c", 2] == "c-s0"
    status = D.pack_status(plans, decisions, packed, D.unfilled(plans, decisions, filled))
    assert {r.plan_id: r.status for r in status.collect()} == {"plan-a": "insufficient", "plan-b": "abstain", "plan-c": "sufficient"}


def test_upsert_takes_only_listed_columns(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "k int, state string, text string")
    new = spark.createDataFrame([(2, "c", "new"), (3, "d", "y")], "k int, state string, text string")
    once = S.upsert(old, new, ["k"], ["state"])
    want = [(1, "a", "x"), (2, "c", None), (3, "d", "y")]
    assert sorted(map(tuple, once.collect())) == want and sorted(map(tuple, S.upsert(once, new, ["k"], ["state"]).collect())) == want


def test_save_swaps_and_scans_fail_fast(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    S.save(spark.range(3), path)
    S.save(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and [p.name for p in pathlib.Path(tmp_path).iterdir()] == ["t"]
    (tmp_path / "ok.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{"a": \n')
    assert S.scan_json(spark, str(tmp_path / "ok.jsonl"), "a int").count() == 2
    with pytest.raises(Exception):
        S.scan_json(spark, str(tmp_path / "bad.jsonl"), "a int").collect()
    (tmp_path / "g.json").write_text('{"_note": "x",\n "cases": [{"id": "c"}]}')
    assert S.scan_json_document(spark, str(tmp_path / "g.json"), "_note string, cases array<struct<id:string>>").columns == ["cases"]
    S.write_csv(spark.createDataFrame([("a", 'say "hi",\nthere')], "k string, v string"), str(tmp_path / "csv"))
    back = spark.read.option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv"), header=True).first()
    assert back.v == 'say "hi",\nthere'


def test_drift_is_null_safe(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "k int, v string")
    b = spark.createDataFrame([(1, None), (2, "z"), (4, "y")], "k int, v string")
    assert {(r.k, r.what) for r in S.drift(a, b, "k", ["v"]).collect()} == {(2, "changed"), (3, "gone"), (4, "new")}


def test_serving_stream_answers_an_interaction_once(spark, tmp_path):
    from evidara.streaming.serve import serve

    rows = [("i1", "q", "2026-01-01 00:00:00"), ("i1", "q", "2026-01-01 00:01:00"), ("i2", "q", "2026-01-01 00:02:00")]
    spark.createDataFrame(rows, "interaction_id string, query string, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("interaction_id string, query string, at timestamp").parquet(str(tmp_path / "in"))
    seen = []
    q = serve(stream, lambda df: df.select("interaction_id"), lambda df, epoch: seen.extend(r[0] for r in df.collect()), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert sorted(seen) == ["i1", "i2"]


def test_requests_are_checked(spark):
    from evidara.streaming.serve import checked

    rows = spark.createDataFrame([("a", "q", "t1"), ("b", "q", "none"), ("c", "", "t1"), ("d", "x" * 2001, "t1"), ("e", None, "t1")], "interaction_id string, query string, token string")
    assert [r.http for r in checked(rows, {"t1": "me"}).orderBy("interaction_id").collect()] == [200, 401, 422, 422, 422]


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        df[c] = df[c].map(lambda v: "NULL" if v is None or v is pd.NA or v != v else repr(float(v)) if isinstance(v, float) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def test_queries_match_their_oracles(spark):
    duckdb = pytest.importorskip("duckdb")
    from evidara.plans import oracles, queries

    con = duckdb.connect()
    for f in pathlib.Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    q, o = queries.queries(), oracles.oracle_sql()
    assert set(o) <= set(q)
    for name in sorted(o):
        got, want = normal(q[name](spark, DATA).toPandas()), normal(con.sql(o[name]).df())
        pd.testing.assert_frame_equal(got, want, obj=name)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 40 and set(entry.oracle_sql()) <= set(entry.queries())


def test_rules_of_regions_fallbacks_verifications_cases_licences_and_gates(spark):
    def broken(rows, schema, rules):
        df = spark.createDataFrame(rows, schema)
        return sorted((r.id, r.rule) for r in A.violations(df, "e", "id", rules).collect())

    regions = [("ok", 0.0, 1.0, 1.0, 0.1, None), ("x", -0.1, 0.5, 0.5, 0.5, 1.0), ("w", 0.5, 0.5, 0.0, 0.5, 0.0), ("h", 0.5, 0.5, 0.5, 1.1, 0.5), ("c", 0.5, 0.5, 0.5, 0.5, 1.5), ("n", 0.5, float("nan"), 0.5, 0.5, 0.5), ("u", None, 0.5, 0.5, 0.5, 0.5)]
    assert broken(regions, "id string, x double, y double, width double, height double, confidence double", A.region_rules()) == [("c", "confidence_outside_bounds"), ("h", "size_outside_page"), ("n", "origin_outside_page"), ("u", "origin_outside_page"), ("w", "size_outside_page"), ("x", "origin_outside_page")]
    fallbacks = [("a", "ABSTAIN", 1), ("b", "SUFFICIENT", 0), ("c", "CLARIFY", 2), ("d", "INSUFFICIENT", 1), ("e", "ESCALATE", 0)]
    assert broken(fallbacks, "id string, on_exhausted string, max_corrective_retrievals int", A.fallback_rules()) == [("b", "fallback_not_terminal"), ("c", "corrective_retrievals_outside_bounds"), ("d", "fallback_not_terminal")]
    results = [("all", "pass", *[True] * 8), *((f"g{k}", "pass", *(j != k for j in range(8))) for k in range(8)), ("held", "abstain", *[False] * 8)]
    schema = "id string, action_taken string, " + ", ".join(f"{g} boolean" for g in A.GATES)
    assert broken(results, schema, A.verification_rules()) == [(f"g{k}", "pass_with_failing_gate") for k in range(8)]
    cases = spark.createDataFrame([("a",), ("b",), ("a",), ("a",)], "case_id string")
    assert [tuple(r) for r in A.repeated_cases(cases).collect()] == [("case", "a", "repeated_case_id")]
    licences = [("ok", ["s"], "why", "who"), ("none", [], "why", "who"), ("blank", ["s"], " \t", "who"), ("null", ["s"], "why", None)]
    assert broken(licences, "id string, source_ids array<string>, reason string, granted_by string", A.licence_rules()) == [("blank", "licence_without_reason_or_grantor"), ("none", "licence_without_source"), ("null", "licence_without_reason_or_grantor")]
    gates = [("ok", 1, 1, 0.5, 0.8), ("open", 1, 1, 0.5, None), ("m", 0, 1, 0.5, 0.8), ("d", 1, 0, 0.5, 0.8), ("eq", 1, 1, 0.5, 0.5)]
    assert broken(gates, "id string, min_corroboration int, depth int, threshold double, high_confidence double", A.gate_config_rules()) == [("d", "depth_below_one"), ("eq", "ceiling_not_above_floor"), ("m", "corroboration_below_one")]


def test_character_references(spark):
    text = "caf&eacute; &#8217; &ndash; &#x3b1; &amp;amp; &nosuch; &copy2 & &#0; &lt"
    rows = spark.createDataFrame([(text,), ("none",), (None,)], "x string")
    assert [r[0] for r in rows.select(P.unescape(F.col("x"))).collect()] == [html.unescape(text), "none", None]
    page = '<math display="block">a&lt;b</math> <math>c</math><math class="x" display="block" id="1">\n&eacute;</math>'
    got = spark.createDataFrame([(page,)], "x string").select(P.tag_bodies(F.col("x"), "math").alias("all"), P.tag_bodies(F.col("x"), "math", 'display="block"').alias("block")).first()
    assert got["all"] == ["a<b", "c", "\né"] and got["block"] == ["a<b", "\né"]


def test_deep_and_wide_trees(spark):
    tree = {"type": "paragraph", "content": "end"}
    for k in range(900):
        tree = {"type": "list", "content": f"c{k}" if k < 2 else None, "kids": [tree]}
    deep = P.typed_nodes(tree)
    assert len(deep) == 901 and deep[0][1] == "c1 c0 end"
    wide = P.typed_nodes({"kids": [{"type": "a", "content": str(k)} for k in range(50_000)]})
    assert [t for _, t in wide[:3]] == ["0", "1", "2"] and len(wide) == 50_000
    for _ in range(20_000):
        tree = {"kids": [tree]}
    assert len(P.typed_nodes(tree)) == 901


def test_gate_and_serving_refuse_bad_configurations(spark):
    none = spark.createDataFrame([], "plan_id string")
    for floor, ceiling, depth, least in ((0.5, 0.5, 3, 2), (0.6, 0.5, 3, 2), (0.1, 0.5, 0, 2), (0.1, 0.5, 3, 0)):
        with pytest.raises(ValueError):
            D.gate(none, none, none, none, none, floor, ceiling, depth, least)
    sources = spark.createDataFrame([("s1", "approved"), ("s2", "quarantined")], "source_id string, approval_state string")
    with pytest.raises(PermissionError):
        A.serving_licence(sources, False)
    assert A.serving_licence(sources, True) == ["s2"] and A.serving_licence(sources.limit(1).filter("source_id = 's1'"), False) == []


def test_gaps_and_plans_without_slots(spark):
    slot = "slots array<struct<slot_id:string,role:string,required:boolean,min_items:int,max_items:int>>"
    plans = spark.createDataFrame([("p", [("a", "explanation", True, 1, 2), ("b", "example", True, 1, 2), ("c", "hint", False, 0, 1)]), ("q", [])], f"plan_id string, {slot}")
    packed = spark.createDataFrame([("p", 1, "o1", "w1"), ("q", 1, "o2", "gone")], "plan_id string, rank int, object_id string, representation_id string")
    filled = D.slot_fill(packed, plans)
    assert sorted((r.plan_id, r.slot_id) for r in filled.collect() if r.slot_id) == [("p", "a")]
    answered = spark.createDataFrame([("p", True), ("q", True)], "plan_id string, answerable boolean")
    got = D.gaps(plans, answered, packed, filled, spark.createDataFrame([("w1",)], "representation_id string"))
    assert sorted(map(tuple, got.collect())) == [("p", "no evidence for example"), ("q", "not in the corpus: o2")]


def test_containing(spark):
    texts = ["one two three four five six seven eight", "xone two three four five sixx", "one\ttwo three four five six", "two", "", None, "a b a b a b a", "three four"]
    items = ["one two three four five six", "ne two three four five six seve", "two", "b a b", "a b a b a b a", "three four", " two ", "nowhere to be found"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = containing(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, query string"))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == sorted((d, i) for d, t in enumerate(texts) for i, q in enumerate(items) if t and q in t)


def test_lower_bound_of_many_trials(spark):
    rows = [(40, 60), (0, 5), (5, 5), (1, 2000), (1500, 2000), (1999, 2000), (3, 9)]
    got = spark.createDataFrame(rows, "s int, n int").select("s", "n", E.lower_bound(F.col("s"), F.col("n")).alias("b")).collect()
    for r in got:
        if 0 < r.s < r.n:
            log = lambda k: math.lgamma(r.n + 1) - math.lgamma(k + 1) - math.lgamma(r.n - k + 1) + k * math.log(r.b) + (r.n - k) * math.log(1 - r.b)
            assert math.isclose(sum(math.exp(log(k)) for k in range(r.s, r.n + 1)), 0.05, rel_tol=1e-6)
        else:
            assert math.isclose(r.b, 0 if r.s == 0 else 0.05 ** (1 / r.n))


def test_values_with_the_sign_between_axes(spark):
    axes = {a: "x" for a in E.AXES} | {"grade": "7×8", "answerable": True}
    rows = spark.createDataFrame([(*axes.values(), False, False, False, 0) for _ in range(3)], ", ".join(f"{a} {'boolean' if a == 'answerable' else 'string'}" for a in axes) + ", hit_candidates boolean, hit_pack boolean, abstained boolean, violations long")
    failing = E.failing_slices(E.slice_scores(rows).filter("slice in ('grade×modality=7×8×x', 'grade=7×8')"), 1)
    assert [r["slice"] for r in E.distinctive_failures(failing).collect()] == ["grade=7×8"]


def test_artefacts_become_one_corpus(spark):
    mk = lambda rows, cols: spark.createDataFrame(rows, cols)
    s, o, b = "source_id string, approval_state string", "object_id string, text string", "block_id string, text string"
    one = {"sources": mk([("s1", "approved")], s), "objects": mk([("o1", "old"), ("o2", "x")], o), "blocks": mk([("b1", None)], b)}
    two = {"sources": mk([("s2", "quarantined")], s), "objects": mk([("o1", "new")], o), "blocks": mk([], b)}
    with pytest.raises(PermissionError, match="s2: quarantined"):
        S.load_corpus([one, two])
    with pytest.raises(PermissionError, match="s1: not named"):
        S.load_corpus([one, two], ["s2"])
    got = S.load_corpus([one, two], ["s1", "s2"])
    assert sorted(map(tuple, got["objects"].collect())) == [("o1", "new"), ("o2", "x")] and got["blocks"].collect() == [("b1", None)]
    assert S.load_corpus([one])["sources"].count() == 1


def test_vectors_regions_and_caches(spark):
    windows = spark.createDataFrame([("w1", "a"), ("w2", "a"), ("w3", "b")], "representation_id string, search_text string")
    made = spark.createDataFrame([("a", [1.0], "m")], "t string, vector array<double>, model string").withColumn("text_hash", F.sha2("t", 256))
    assert sorted((r.representation_id, r.vector) for r in S.attach_vectors(windows, made).collect()) == [("w1", [1.0]), ("w2", [1.0]), ("w3", None)]
    flat = spark.createDataFrame([("b", 3, 0.1, 0.2, 0.3, 0.4)], "block_id string, page int, x double, y double, width double, height double")
    assert S.nested_region(flat).select("block_id", "region.*").collect() == flat.collect()
    texts = spark.createDataFrame([("a",), ("b",)], "text string")
    cache = texts.filter("text = 'a'").select(S.cache_key("m", "document", F.col("text")).alias("cache_key"), F.array(F.lit(1.0)).alias("vector"))
    with pytest.raises(LookupError):
        S.cached_vectors(texts, cache, "m", "document")
    assert {r.text: r.vector for r in S.cached_vectors(texts, cache, "m", "document", read_only=False).collect()} == {"a": [1.0], "b": None}


def test_a_sheet_has_one_reviewer(spark):
    rows = [("one", "c1", " ann ", "agree", None), ("one", "c9", "ann", "agree", ""), ("one", "c2", "", "Disagree", " "), ("one", None, "ann", "agree", ""), ("one", "c1", "ann", "", ""), ("two", "c1", "ann", "agree", ""), ("two", "c2", "bob", "disagree", ""), ("none", "c1", None, "agree", "")]
    marked = spark.createDataFrame(rows, "sheet string, case_id string, reviewer string, verdict string, note string")
    got = S.sheet_problems(marked, spark.createDataFrame([("c1",), ("c2",)], "case_id string"))
    assert {tuple(r) for r in got.collect()} == {("one", "c9", "unknown case"), ("one", "c2", "disagreement without a note"), ("two", None, "not exactly one reviewer"), ("none", None, "not exactly one reviewer")}


def test_failing_gates_are_named(spark):
    report = spark.createDataFrame([(0.9, 0.94), (1.0, None), (1.0, 0.95)], "resolution double, completeness double")
    assert sorted(r.gate for r in E.failing_gates(report).collect()) == ["completeness", "resolution"]


def test_requests_and_settings(spark):
    from evidara.streaming import serve

    rows = [("a", "q", "t", None, "x"), ("b", "", "t", None, "x"), ("c", "q" * 2001, "t", None, "x"), ("d", "q", "no", None, "x"), ("e", "q", "t", "other", "x"), ("f", "q", "t", None, "y" * 129), ("g", None, "t", None, None)]
    got = serve.checked(spark.createDataFrame(rows, "interaction_id string, query string, token string, tenant string, learner_id string"), {"t": "mine"})
    assert {r.interaction_id: (r.http, r.tenant) for r in got.collect()} == {"a": (200, "mine"), "b": (422, "mine"), "c": (422, "mine"), "d": (401, None), "e": (422, "mine"), "f": (422, "mine"), "g": (422, "mine")}
    told = {"floor": "0.3", "ceiling": "0.6", "manifest": "m", "tokens": "t:mine, u:yours,"}
    assert serve.configuration(told) == {"floor": 0.3, "ceiling": 0.6, "manifest": "m", "tokens": {"t": "mine", "u": "yours"}, "pilot": False}
    assert serve.configuration(told | {"lend": serve.LEND})["pilot"] and not serve.configuration(told | {"lend": "yes"})["pilot"]
    for bad in ({"floor": " "}, {"manifest": ""}, {"tokens": ", ,"}, {"tokens": "t"}, {"tokens": ":x"}, {"ceiling": "high"}):
        with pytest.raises(ValueError):
            serve.configuration(told | bad)


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_terms_are_weighed_without_joining_statistics(spark):
    p, w, _, _ = seen_windows(spark)
    for q in (R.bm25_terms(p, w), R.keyword_terms(p, w)):
        plan = planned(q)
        assert "NestedLoop" not in plan and len(re.findall(r"Exchange ", plan)) <= 3, plan
    assert R.facts(w.limit(0)).mean is None and R.bm25_terms(p.limit(0), w.limit(0)).count() == 0
    no_id = p.limit(1).withColumn("plan_id", F.lit(None).cast("string"))
    assert R.bm25_terms(no_id, w).count() == 0


@pytest.mark.parametrize("name, table", [("hybrid_rrf_topk", "embeddings"), ("evidence_pack", "documents"), ("pack_spans", "documents"), ("citation_gates", "documents"), ("violations", "documents")])
def test_shared_steps_are_written_before_the_plans_that_join_them(spark, name, table):
    """The driver's memory is filled by plans with many exchanges at once; what such a plan joins is read from steps that hold only what it needs."""
    from evidara.plans import queries as Q

    c = Q.bench(spark, DATA)
    df = c.violations(c.bm25_items) if name == "violations" else Q.Q[name](c)
    assert f"{table}.parquet" not in planned(df), planned(df)
    plan = c.bm25._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation ", plan)) == 4, plan  # windows, what may be seen, and the written terms to choose words and to score


def test_packs_meet_only_the_blocks_they_cite_and_the_gate_only_what_was_returned(spark, monkeypatch):
    from evidara.plans import queries as Q

    c = Q.Bench(spark, DATA)
    ids = {x for r in c.packs.select("block_ids").collect() for x in r.block_ids}
    assert {r.block_id for r in c.cited.collect()} == ids != set() and len(ids) < c.blocks.count()
    given = []
    gate = D.gate
    monkeypatch.setattr(D, "gate", lambda *a, **k: given.append(a) or gate(*a, **k))
    del c.__dict__["decisions"]
    assert c.decisions.count() == c.plans.count()
    shown = {r.representation_id for items in given[0][1:3] for r in items.collect()}
    assert {r.representation_id for r in given[0][3].collect()} == shown and "documents.parquet" not in planned(given[0][4])


@pytest.mark.parametrize("few", [0, R.FEW])
def test_dense_scores_gather_no_objects_in_the_driver(spark, monkeypatch, few):
    """What plans may see grows with the corpus while its files stay small, so Spark would take it for a small table and broadcast it."""
    p, w, objects, allowed = seen_windows(spark)
    objects = cut(objects)
    monkeypatch.setattr(R, "FEW", few)
    v = w.select("representation_id", "object_id", F.array(F.length("search_text").cast("float"), F.lit(7.0).cast("float")).alias("vector"))
    q = p.select("plan_id", F.array(F.lit(1.0), F.length("query").cast("double")).alias("query_vector"))
    got = R.dense_matched(p, q, v, objects)
    plan = planned(got)
    assert len(re.findall("BroadcastExchange", plan)) == (few > 0), plan
    rows = lambda df: sorted((r.plan_id, r.representation_id, r.object_id, r.score) for r in df.collect())
    assert rows(got) == rows(R.dense_scores(q, v, allowed)) != []


def test_cuts_return_what_the_driver_has_freed(spark):
    """Blocks of memory that are free, but not at the end of the C library's heap, stay with the driver until it is asked for them."""
    java, pid = spark.sparkContext._jvm.java.lang, spark.sparkContext._jvm.java.lang.ProcessHandle.current().pid()
    held = lambda: int(re.search(r"Anonymous:\s+(\d+)", pathlib.Path(f"/proc/{pid}/smaps_rollup").read_text())[1]) / 1024
    rows = spark.range(3)
    cut(rows)
    field = java.Class.forName("sun.misc.Unsafe").getDeclaredField("theUnsafe")
    field.setAccessible(True)
    memory = field.get(None)
    blocks = [memory.allocateMemory(100_000) for _ in range(4000)]
    for x in blocks:
        memory.setMemory(x, 100_000, 1)
    for x in blocks[:-1]:
        memory.freeMemory(x)
    before = held()
    assert cut(rows).count() == 3
    after = held()
    memory.freeMemory(blocks[-1])
    assert after < before - 200, (before, after)
