"""The operators bound to the test tables, one query per key. Lists are shown as text, joined by a bar."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import access as A
from ..operators import decide as D
from ..operators import evaluate as E
from ..operators import formulas as M
from ..operators import parse as P
from ..operators import retrieve as R
from ..operators import store as S
from ..operators import windows as W
from ..sources import testdata as T
from ..sources import vocabulary as V
from ..sources.stage import cut
from . import fixtures as X

FLOOR, CEILING, TODAY = 0.05, 0.3, "2026-09-01"


class Bench(T.Corpus):
    """The corpus with what several queries share."""

    @cached_property
    def allowed(self) -> DataFrame:
        return cut(A.authorised(self.plans, self.objects, self.sources, T.LICENSED))

    @cached_property
    def allowed_windows(self) -> DataFrame:
        return cut(A.authorised_windows(self.allowed, self.windows))

    @cached_property
    def scoped(self) -> DataFrame:
        return cut(A.scoped(self.objects, self.sources, T.LICENSED))

    @cached_property
    def frequencies(self) -> DataFrame:
        return cut(R.frequencies(self.windows))

    @cached_property
    def facts(self) -> Row:
        return R.facts(self.windows)

    @cached_property
    def bm25_terms(self) -> DataFrame:
        return cut(R.bm25_terms(self.plans, self.windows, self.frequencies, self.facts))

    @cached_property
    def bm25(self) -> DataFrame:
        """All scores, which no query but their own writes out."""
        return R.bm25_of(R.matched(self.plans, self.bm25_terms, self.windows, self.scoped))

    @cached_property
    def bm25_items(self) -> DataFrame:
        return cut(R.object_topk(self.bm25))

    @cached_property
    def keyword_terms(self) -> DataFrame:
        return cut(R.keyword_terms(self.plans, self.windows, self.frequencies, self.facts))

    @cached_property
    def keyword_items(self) -> DataFrame:
        return cut(R.object_topk(R.keyword_of(R.matched(self.plans, self.keyword_terms, self.windows, self.scoped))))

    @cached_property
    def dense(self) -> DataFrame:
        """All scores, which no query but their own writes out."""
        return R.dense_matched(self.plans, self.plan_vectors, self.vectors, self.scoped)

    @cached_property
    def dense_items(self) -> DataFrame:
        return cut(R.dense_topk(self.dense))

    @cached_property
    def query_plans(self) -> DataFrame:
        return D.query_plans(self.cases)

    @cached_property
    def decisions(self) -> DataFrame:
        shown = cut(self.bm25_items.select("object_id", "representation_id").unionByName(self.keyword_items.select("object_id", "representation_id")).distinct())
        blocks = cut(self.windows.select("representation_id", "block_ids").join(shown, "representation_id", "left_semi"))
        kinds = cut(self.objects.select("object_id", "object_type").join(shown, "object_id", "left_semi"))
        return cut(D.gate(self.plans, self.bm25_items, self.keyword_items, blocks, kinds, FLOOR, CEILING))

    @cached_property
    def packed(self) -> DataFrame:
        return cut(D.admitted(self.bm25_items, self.decisions))

    @cached_property
    def siblings(self) -> DataFrame:
        of = cut(self.packed.select("plan_id", "object_id").join(self.windows.select("object_id", "representation_id"), "object_id"))
        words = cut(R.counted(self.windows, of))
        seen = words.join(self.keyword_terms, ["plan_id", "term"]).select("plan_id", "representation_id")
        other = cut(seen.unionByName(self.keyword_items.select("plan_id", "representation_id")).distinct())
        scores = cut(R.bm25_of(words.join(self.bm25_terms, ["plan_id", "term"])))
        return cut(D.siblings(self.packed, scores, other, FLOOR))

    @cached_property
    def packs(self) -> DataFrame:
        return cut(D.pack_blocks(self.packed, self.siblings, self.windows))

    @cached_property
    def cited(self) -> DataFrame:
        """The blocks that packs cite, so that all others are met once."""
        ids = cut(self.packs.select(F.explode("block_ids").alias("block_id")).distinct())
        return cut(self.blocks.select("block_id", "page", "text", "latex").join(R.few(ids), "block_id", "left_semi"))

    @cached_property
    def filled(self) -> DataFrame:
        return cut(D.slot_fill(self.packed, self.query_plans))

    @cached_property
    def statuses(self) -> DataFrame:
        return cut(D.pack_status(self.query_plans, self.decisions, self.packed, D.unfilled(self.query_plans, self.decisions, self.filled)))

    @cached_property
    def spans(self) -> DataFrame:
        return cut(D.pack_spans(self.packs, self.cited))

    @cached_property
    def licensed(self) -> DataFrame:
        return A.licensed(self.objects, self.sources, T.LICENSED)

    def violations(self, items: DataFrame) -> DataFrame:
        # Of the objects only those that were returned; these and what is allowed are planned apart.
        ids = R.few(cut(items.select("object_id").distinct()))
        own = cut(self.objects.drop("text", "content_hash", "heading_path").join(ids, "object_id", "left_semi"))
        allowed = cut(A.authorised_pairs(items, self.plans, self.scoped))
        return E.violations(items, self.plans, own, self.sources, allowed, cut(A.licensed(own, self.sources, T.LICENSED)))

    def results(self, items: DataFrame) -> DataFrame:
        if "representation_id" not in items.columns:  # retrievers of objects cite the object's first window
            first = self.windows.filter("number = 1").select("object_id", "representation_id")
            items = items.join(first, "object_id", "left")
        return E.case_results(self.cases, items, self.windows, self.gold, cut(self.violations(items)), FLOOR)

    @cached_property
    def bm25_results(self) -> DataFrame:
        return cut(self.results(self.bm25_items))

    @cached_property
    def slices(self) -> DataFrame:
        return cut(E.slice_scores(self.bm25_results))

    @cached_property
    def citations(self) -> DataFrame:
        return E.citation_cases(self.cases, self.statuses, self.packs, cut(E.spans_resolve(self.packs, self.spans, self.cited)), self.gold)

    def layout(self) -> tuple[DataFrame, DataFrame]:
        """Two readings of every document: the blocks, and what a poorer parser would have made of them."""
        b = self.blocks.select(F.col("object_id").alias("document_id"), "page", "block_type", F.coalesce(F.when(F.col("text") != "", F.col("text")), "latex").alias("text"), "pos")
        drop = (F.col("page") % 3 == 0) & (F.col("pos") % 2 == 0) | (F.col("page") % 5 == 0)
        poor = b.filter(~drop).withColumn("block_type", F.when(F.col("page") % 2 == 0, F.lit("paragraph")).otherwise(F.col("block_type")))
        return b, poor

    def reviews(self) -> DataFrame:
        """Two reviewers' verdicts on documents, from their labels."""
        n = self.table("labels")
        verdict = lambda good: F.when(good, "agree").otherwise("disagree")
        one = n.select(F.col("doc_id").alias("case_id"), F.lit("r1").alias("reviewer"), verdict(F.col("quality") == 1).alias("verdict"), F.when(F.col("doc_id") % 2 == 0, "seen").alias("note"))
        two = n.select(F.col("doc_id").alias("case_id"), F.lit("r2").alias("reviewer"), F.when(F.col("doc_id") % 7 == 0, "unsure").otherwise(verdict(F.col("toxic") == 0)).alias("verdict"), F.lit("why").alias("note"))
        return one.unionByName(two)


Query = Callable[[Bench], DataFrame]
Q: dict[str, Query] = {}


def query(f: Query) -> Query:
    Q[f.__name__] = f
    return f


def bar(c: str | Column) -> Column:
    return F.array_join(c, "|")


def long(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


# Sources and scalars


@query
def scan_blocks(c):
    return c.blocks.groupBy("block_type").agg(F.count(F.lit(1)).alias("n"), F.sum(long("n_chars")).alias("chars"), F.max("page").alias("last_page"))


@query
def source_registry(c):
    return c.sources.join(c.objects.groupBy("source_id").agg(F.count(F.lit(1)).alias("objects")), "source_id", "left").select("source_id", "approval_state", "edition", "checksum", F.coalesce("objects", F.lit(0)).alias("objects"))


@query
def source_approval_check(c):
    declared = F.when(F.col("n") % 4 == 1, "other").otherwise(F.col("checksum"))
    return c.sources.select("source_id", F.coalesce(S.approval_problem(F.col("approval_state"), F.col("has_rights"), declared, F.col("checksum"), F.col("scanned")), F.lit("")).alias("problem"))


@query
def gold_cases(c):
    return c.cases.select("case_id", "query", *E.AXES, "holdout")


@query
def object_blocks_agg(c):
    links = c.blocks.select("object_id", "block_id", F.col("pos").alias("position"))
    return S.ordered_ids(links, "object_id").select("object_id", bar("block_ids").alias("blocks"))


@query
def upsert_merge(c):
    new = c.objects.filter(F.col("doc_id") % 3 == 0).select(F.when(F.col("doc_id") % 2 == 0, F.concat("object_id", F.lit("-new"))).otherwise(F.col("object_id")).alias("object_id"), F.lit("retired").alias("approval_state"), F.lit("changed").alias("heading_path"))
    return S.upsert(c.objects.select("object_id", "approval_state", "heading_path"), new, ["object_id"], ["approval_state"])


@query
def upsert_sources(c):
    n, cols = F.col("n"), ["source_id", "approval_state", "has_rights", "scanned", "edition"]
    new = c.sources.filter(n % 3 == 0).select(F.when(n % 2 == 0, F.concat("source_id", F.lit("-new"))).otherwise(F.col("source_id")).alias("source_id"), F.lit("retired").alias("approval_state"), F.lit(False).alias("has_rights"), F.lit(True).alias("scanned"), F.lit("new").alias("edition"))
    return S.upsert(c.sources.select(*cols), new, ["source_id"], S.UPDATED["sources"])


@query
def corpus_union(c):
    first, second = c.objects.filter(F.col("doc_id") % 3 != 2), c.objects.filter(F.col("doc_id") % 2 == 0).withColumn("heading_path", F.lit("second"))
    cols = ["object_id", "approval_state", "heading_path"]
    return S.union_last([first.select(*cols), second.select(*cols)], "object_id")


@query
def licence_coverage(c):
    found = [S.licence_problems(c.sources, licence).withColumn("licence", F.lit(name)) for name, licence in (("none", None), ("given", T.LICENSED))]
    return found[0].unionByName(found[1])


@query
def attached_vectors(c):
    w = c.windows.filter("number = 1").join(c.vectors.select("representation_id", "vector"), "representation_id").filter("vector IS NOT NULL")
    made = w.groupBy(F.sha2("search_text", 256).alias("text_hash")).agg(F.max_by("vector", "representation_id").alias("vector")).withColumn("model", F.lit("m1"))
    got = S.attach_vectors(c.windows.select("representation_id", "search_text"), made)
    return got.select("representation_id", F.coalesce("model", F.lit("")).alias("model"), F.round(F.element_at("vector", 1).cast("double"), 6).alias("first"))


@query
def block_regions(c):
    p = F.col("pos") % 8
    flat = c.blocks.select("block_id", "page", F.lit(0.125).alias("x"), (p / 8).alias("y"), F.lit(0.75).alias("width"), F.lit(0.125).alias("height"))
    return S.nested_region(flat).select("block_id", long("region.page").alias("page"), F.col("region.y").alias("y"), (F.col("region.y") + F.col("region.height")).alias("bottom"))


@query
def vector_parse(c):
    v = c.table("embeddings").select("vec_id", F.to_json("embedding").alias("raw"))
    return v.select("vec_id", C.parse_vector(F.col("raw")).alias("v")).select("vec_id", long(F.size("v")).alias("width"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query
def embedding_cache_misses(c):
    cache = c.windows.filter(F.col("number") == 1).select(S.cache_key("m1", "document", F.col("search_text")).alias("cache_key"))
    return S.cache_misses(c.windows.select(F.col("search_text").alias("text")), cache, "m1", "document")


@query
def rerank_cache_keys(c):
    docs = c.keyword_items.join(c.windows.select("representation_id", "content_hash"), "representation_id").groupBy("plan_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content_hash"))), lambda x: x["content_hash"]).alias("docs"))
    return docs.join(c.plans.select("plan_id", "scoped"), "plan_id").select("plan_id", S.rerank_key("m2", F.col("scoped"), F.col("docs")).alias("cache_key"))


@query
def html_page_text(c):
    return _marked(c).select("page_id", P.page_text(F.col("html")).alias("text"))


@query
def html_tag_extract(c):
    return _marked(c).select("page_id", bar(P.tag_bodies(F.col("html"), "p")).alias("p"), bar(P.tag_bodies(F.col("html"), "b")).alias("b"))


def _marked(c) -> DataFrame:
    """Every page, with character references at its end that pages do not have."""
    more = F.concat(F.lit(f'<p>{X.REFERENCES}</p><b class="x">'), F.col("page_id").cast("string"), F.lit("&ndash;&#"), (F.col("page_id") % 9000 + 200).cast("string"), F.lit(";</b>"))
    return c.table("pages").select("page_id", F.concat("html", more).alias("html"))


@query
def review_sheet(c):
    critical = c.cases.filter(F.col("holdout") | ~F.col("answerable"))
    cited = c.gold.select("case_id", "block_id").distinct().join(c.blocks.select("block_id", "pos", "page", C.text_of(F.col("text"), F.col("latex")).alias("line")), "block_id")
    lines = F.array_sort(F.collect_list(F.struct("block_id", "line", "page")))
    got = cited.groupBy("case_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n\n").alias("cited"), F.array_join(F.transform(F.array_sort(F.collect_set("page")), lambda p: p.cast("string")), ",").alias("pages"))
    return critical.join(got, "case_id", "left").select("case_id", "query", F.coalesce("cited", F.lit("")).alias("cited"), F.coalesce("pages", F.lit("")).alias("pages"))


@query
def adjudication(c):
    return S.adjudication(c.reviews(), c.table("documents").filter(F.col("doc_id") % 11 != 0).select(F.col("doc_id").alias("case_id")))


@query
def review_import(c):
    r = c.reviews()
    return r.groupBy("reviewer", "verdict").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("verdict") == "disagree") & F.col("note").isNull()).alias("without_note"))


@query
def sheet_import(c):
    d = F.col("case_id")
    rows = c.reviews().withColumn("sheet", F.concat_ws("-", "reviewer", (d % 5).cast("string")))
    name = F.when((F.col("sheet") == "r1-3") & (d % 2 == 1), "r9").when(F.col("sheet") != "r2-4", F.col("reviewer"))
    rows = rows.select("sheet", d.cast("string").alias("case_id"), name.alias("reviewer"), "verdict", "note")
    known = c.table("documents").filter(F.col("doc_id") % 11 != 0).select(F.col("doc_id").alias("case_id"))
    return S.sheet_problems(rows, known).withColumn("case_id", F.coalesce("case_id", F.lit("")))


@query
def chapter_text(c):
    own = W.searchable(c.blocks)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "body"))), lambda x: x["body"]), "\n")
    return own.groupBy("object_id").agg(text.alias("t")).select("object_id", long(F.length("t")).alias("chars"), F.sha2("t", 256).alias("digest"))


@query
def tokenize(c):
    t = F.col("t")
    return c.table("documents").select("doc_id", C.tokens(F.coalesce("text", F.lit(""))).alias("t")).select("doc_id", long(F.size(t)).alias("n"), long(F.size(F.array_distinct(t))).alias("distinct_n"), F.sha2(F.array_join(t, " "), 256).alias("digest"))


@query
def scoped_query(c):
    return c.plans.select("plan_id", "scoped")


@query
def statement_blocks(c):
    return W.searchable(c.blocks).filter(C.is_statement(F.col("body"), T.OPENERS)).select("block_id", "block_type")


@query
def unusable_text(c):
    # Every line as it is, and spelt out, which leaves loose characters.
    b = c.blocks.filter("text <> ''").select("block_id", "text", F.array_join(F.split("text", ""), " ").alias("spelt"))
    return b.select("block_id", C.unusable(F.col("text")).alias("plain"), C.unusable(F.col("spelt")).alias("spelt"), C.unusable(F.concat("spelt", F.lit(" = 4"))).alias("related"))


@query
def readable_text(c):
    return c.blocks.select("block_id", F.sha2(C.readable(F.col("text"), F.col("latex")), 256).alias("digest"))


@query
def unusable_formulas(c):
    return c.blocks.filter(F.col("block_type") == "formula").filter(C.unusable(F.col("text"))).select("block_id")


@query
def symbol_decode(c):
    return c.spark.createDataFrame(X.SYMBOLS, "id int, raw string").select("id", C.decode_symbols(F.col("raw")).alias("decoded"), bar(C.undecoded(F.col("raw"))).alias("unknown"))


@query
def decode_stats(c):
    # Plus signs and brackets of the texts put back into the symbol font, then decoded.
    raw = F.translate("text", "()+=", X.IN_FONT)
    b = c.blocks.select("source_id", raw.alias("raw"), "text")
    done = C.decode_symbols(F.col("raw"))
    return b.groupBy("source_id").agg(F.count_if(done != F.col("raw")).alias("touched"), F.count_if(C.unusable(F.col("raw")) & ~C.unusable(done)).alias("rescued"), F.count_if(done == F.col("text")).alias("same"))


@query
def geometry_region(c):
    box = C.region(*(F.col(x) for x in ("l", "b", "r", "t", "w", "h")))
    return _boxes(c).select("id", box.alias("g")).select("id", *(F.round(F.col(f"g.{x}"), 6).alias(x) for x in ("x", "y", "width", "height")))


@query
def geometry_roundtrip(c):
    rows = _boxes(c).withColumn("g", C.region(*(F.col(x) for x in ("l", "b", "r", "t", "w", "h")))).withColumn("p", C.points(F.col("g"), F.col("w"), F.col("h")))
    return rows.select("id", *(F.round(F.col(f"p.{x}"), 4).alias(x) for x in ("left", "bottom", "right", "top")))


def _boxes(c) -> DataFrame:
    """A box for each part, from its numbers; some inverted, outside, or on a page without size."""
    k = F.col("p_partkey")
    n = lambda m, lo: (k * m % 700 - lo).cast("double")
    return c.table("part").select(k.alias("id"), n(7, 20).alias("l"), n(11, 10).alias("b"), n(13, 0).alias("r"), n(17, 30).alias("t"), F.when(k % 50 == 0, 0.0).otherwise(612.0).alias("w"), F.lit(792.0).alias("h"))


@query
def cosine_topk(c):
    v = c.table("embeddings")
    q = v.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    met = v.join(q, F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", F.round(C.cosine(F.col("q"), F.col("embedding")), 6).alias("score"))
    return R.top(met, ["query_id"], 5, F.desc("score"), F.asc("vec_id"))


@query
def hash_embedding(c):
    t = c.plans.select("plan_id", F.explode(F.filter(F.split(F.lower("scoped"), r"\s+"), lambda w: w != "")).alias("word"))
    n = t.groupBy("plan_id", C.token_bucket(F.col("word")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    norm = n.groupBy("plan_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return n.join(norm, "plan_id").select("plan_id", "bucket", F.round(F.col("n") / F.col("norm"), 6).alias("value"))


# Access and contracts


@query
def authorised_objects(c):
    return c.allowed


@query
def authorised_objects_sql(c):
    ranks = ", ".join(f"'{k}', {v}" for k, v in V.DISCLOSURE_RANK.items())
    named = ", ".join(f"'{s}'" for s in T.LICENSED)
    text = f"""
        SELECT p.plan_id, o.object_id
        FROM {{plans}} p
        JOIN {{objects}} o ON o.grade = p.grade AND o.subject = p.subject AND o.board = p.board AND o.version = p.version
        JOIN {{sources}} s ON s.source_id = o.source_id
        WHERE NOT o.retired AND (o.tenant_scope IS NULL OR o.tenant_scope = p.tenant)
          AND map({ranks})[o.disclosure] <= p.ceiling_rank
          AND ((o.approval_state = 'approved' AND s.approval_state = 'approved')
               OR (o.approval_state = 'quarantined' AND s.approval_state = 'quarantined' AND o.source_id IN ({named})))"""
    return c.spark.sql(text, plans=c.plans, objects=c.objects, sources=c.sources)


@query
def licensed_objects(c):
    return c.licensed


@query
def authorised_windows(c):
    return c.allowed_windows


@query
def unapproved_sources(c):
    return A.unapproved_sources(c.sources)


@query
def contract_violations(c):
    w = c.windows.join(c.vectors.select("representation_id", "vector"), "representation_id").withColumn("model", F.when(F.col("number") == 1, "m1"))
    b = c.blocks.withColumn("text", F.when(F.col("pos") % 10 == 9, "").otherwise(F.col("text")))
    o = c.objects.withColumn("disclosure", F.when((F.col("object_type") == "solution") & (F.col("doc_id") % 5 == 1), "public").otherwise(F.col("disclosure")))
    out = A.violations(c.sources, "source", "source_id", A.source_rules()).unionByName(A.violations(b, "block", "block_id", A.block_rules()))
    out = out.unionByName(A.violations(o, "object", "object_id", A.object_rules())).unionByName(A.violations(w, "window", "representation_id", A.window_rules()))
    k, d, n = F.col("p_partkey"), F.col("doc_id"), F.col("n")
    regions = c.table("part").select(k.alias("id"), ((k % 13 - 1) / 11).alias("x"), ((k % 17 - 1) / 15).alias("y"), (k % 7 / 6).alias("width"), (k % 11 / 9).alias("height"), F.when(k % 4 != 0, k % 19 / 17).alias("confidence"))
    gates = (F.when(d % (23 + i) != 3, d % (19 + i) != 5).alias(g) for i, g in enumerate(A.GATES))
    checks = c.table("labels").select(d.alias("id"), F.when(F.col("quality") == 1, "pass").otherwise("revise").alias("action_taken"), *gates)
    lent = c.sources.select(F.col("source_id").alias("id"), F.when(n % 5 == 2, F.expr("cast(array() as array<string>)")).otherwise(F.array("source_id")).alias("source_ids"), F.when(n % 4 == 3, "  ").otherwise("pilot").alias("reason"), F.when(n % 7 != 5, "owner").alias("granted_by"))
    k = F.col("n_nationkey")
    configs = c.table("nation").select(k.alias("id"), (k % 4).alias("min_corroboration"), (k % 3).alias("depth"), F.lit(0.5).alias("threshold"), F.when(k % 5 != 0, k % 6 / 5).alias("high_confidence"))
    for rows, entity, rules in ((regions, "region", A.region_rules()), (checks, "verification", A.verification_rules()), (lent, "licence", A.licence_rules()), (configs, "gate", A.gate_config_rules())):
        out = out.unionByName(A.violations(rows, entity, "id", rules))
    return out


@query
def plan_violations(c):
    p = c.query_plans.join(c.cases.select("case_id", "item_id"), "case_id")
    k = F.col("item_id")
    bad = F.transform("slots", lambda s: s.withField("min_items", F.when(k % 5 == 2, 3).when(k % 7 == 3, 0).otherwise(s["min_items"])).withField("role", F.when(k % 6 == 3, "rubric").otherwise(s["role"])))
    rows = p.withColumn("slots", bad).withColumn("asked_rank", F.col("ceiling_rank") + F.when(k % 4 == 1, 1).otherwise(0)).withColumn("hypothesis", F.when(k % 2 == 0, F.col("hypothesis")))
    rows = rows.withColumn("on_exhausted", T.pick(["clarify", "ABSTAIN", "escalate", "retry"], k)).withColumn("max_corrective_retrievals", k % 4 - 1)
    claimed = F.when(F.substring("plan_id", 7, 20).cast("long") % 5 == 1, "sufficient").otherwise(F.col("status"))
    packs = c.statuses.join(c.decisions.select("plan_id", "answerable"), "plan_id").withColumn("status", claimed)
    return A.violations(rows, "plan", "plan_id", A.plan_rules() | A.fallback_rules()).unionByName(A.violations(packs, "pack", "plan_id", A.pack_rules()))


@query
def dangling_citations(c):
    return A.dangling(c.bm25_items.select("plan_id", "object_id"), c.packed.select("plan_id", "object_id"))


@query
def gold_violations(c):
    n = c.gold.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    rows = c.cases.join(n, "case_id", "left").withColumn("claimed", F.when(F.col("item_id") % 9 == 4, ~F.col("answerable")).otherwise(F.col("answerable")))
    return A.violations(rows, "case", "case_id", {"answerable_unlike_gold": F.col("claimed") != (F.coalesce("n", F.lit(0)) > 0)}).unionByName(A.repeated_cases(c.cases))


@query
def rights_problems(c):
    n = F.col("n")
    s = c.sources.select("source_id", "checksum", "scanned", F.when(n % 4 == 1, "other").otherwise(F.col("checksum")).alias("declared_checksum"), (n % 3 != 0).alias("permits_storage"), (n % 8 != 5).alias("permits_display"), (n % 9 != 2).alias("permits_processing"), F.date_add(F.to_date(F.lit(TODAY)), (n - 10).cast("int")).alias("term_expires"))
    return A.rights_problems(s, TODAY)


@query
def correction_status(c):
    b = c.blocks.filter("block_type = 'paragraph'")
    now = F.when(F.col("pos") % 5 == 1, F.col("text")).when(F.col("pos") % 5 == 2, "").otherwise(F.concat("text", F.lit(" corrected")))
    was = F.when(F.col("pos") % 5 == 3, "something else").otherwise(F.concat(F.lit("  "), "text"))
    return S.correction_status(b.select("block_id", was.alias("was"), now.alias("now")), c.blocks)


@query
def formula_review_status(c):
    r = c.blocks.select("block_id", F.when(F.col("pos") % 3 == 0, F.col("latex")).otherwise(F.lit("x = 1")).alias("latex"), F.lit("r1").alias("reader"), F.when(F.col("pos") % 4 == 1, "r1").otherwise("r2").alias("checker"))
    return S.formula_status(r, c.blocks)


# Parsing and windows


@query
def json_walk(c):
    docs = c.spark.createDataFrame(X.TREES, "document_id string, json string")
    return P.walk(docs).select("document_id", "position", "type", F.coalesce("text", F.lit("")).alias("text"))


@query
def parse_tree_blocks(c):
    docs = c.spark.createDataFrame(X.TREES, "document_id string, json string")
    b = P.tree_blocks(P.walk(docs))
    return b.select("document_id", "order_index", "block_type", "raw_label", "page", *(F.round(F.col(f"region.{x}"), 6).alias(x) for x in ("x", "y", "width", "height")), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("linked_id", F.lit("")).alias("linked_id"))


@query
def table_markdown(c):
    # The lines of every document as rows of a table, cut into cells at commas.
    rows = F.transform(F.split("text", "\n"), lambda line: F.split(line, ", "))
    return c.table("documents").filter("text is not null").select("doc_id", P.markdown(rows).alias("m")).select("doc_id", long(F.length("m")).alias("chars"), F.sha2("m", 256).alias("digest"))


@query
def grid_markdown(c):
    cells = c.table("lineitem").select((F.col("l_orderkey") % 997).cast("string").alias("document_id"), (F.col("l_linenumber") - 1).alias("row"), (F.col("l_suppkey") % 5).cast("int").alias("col"), F.col("l_returnflag").alias("text"), F.lit(6).alias("n_rows"), F.lit(4).alias("n_cols"), F.concat_ws("-", F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.lpad(F.col("l_linenumber").cast("string"), 3, "0"), F.lpad(F.col("l_partkey").cast("string"), 12, "0"), F.lpad(F.col("l_suppkey").cast("string"), 12, "0")).alias("seq"))
    return P.grid_markdown(cells)


@query
def parse_layout_blocks(c):
    items = c.blocks.select(F.col("object_id").alias("document_id"), F.concat(F.lit("#/texts/"), "pos").alias("ref"), "page", (F.col("pos") % 3 * 10.0).alias("l"), (F.col("pos") * 7 % 5 * 100.0).alias("t"), "text")
    return P.layout_blocks(items).select("document_id", "order_index", "block_id", "page")


@query
def empty_pages(c):
    b, poor = c.layout()
    return P.empty_pages(b.groupBy("document_id").agg(F.max("page").alias("pages")), poor)


@query
def parse_diff(c):
    return P.diff(*c.layout(), "one", "two")


@query
def compose_sections(c):
    b = c.blocks.select(F.col("object_id").alias("document_id"), "pos", "block_id", "block_type", "text")
    return P.sections(b, (F.col("block_type") == "table") & (F.col("text") != ""), "s1")


@query
def block_groups(c):
    return W.block_groups(c.blocks).select("object_id", "block_id", "place", "grp")


@query
def greedy_windows(c):
    return W.greedy_windows(W.block_groups(c.blocks)).select("object_id", "block_id", "number")


@query
def window_modality(c):
    return c.windows.select("representation_id", "modality")


@query
def window_representations(c):
    return c.windows.select("representation_id", bar("block_ids").alias("blocks"), F.coalesce("context_id", F.lit("")).alias("context_id"), "content_hash")


# Retrieval


@query
def idf_table(c):
    t = c.windows.select("representation_id", F.explode(F.array_distinct(C.tokens(F.col("search_text")))).alias("term"))
    return R.idf(t, "representation_id").select("term", "df", F.round("idf", 6).alias("idf"))


@query
def keyword_topk(c):
    got = R.keyword_scores(c.plans, c.objects, "object_id", F.concat_ws(" ", "heading_path", "text"), c.allowed)
    return R.top(got, ["plan_id"], R.K, *R.by_score("object_id"))


@query
def window_keyword_topk(c):
    return c.keyword_items.select("plan_id", "rank", "object_id", "representation_id", "score")


@query
def bm25_stats(c):
    return R.bm25_stats(c.windows, c.frequencies).select("term", "df", F.round("w", 6).alias("w"))


@query
def bm25_window_scores(c):
    return c.bm25


@query
def bm25_topk(c):
    return c.bm25_items.select("plan_id", "rank", "object_id", "representation_id", "score")


@query
def dense_window_scores(c):
    return c.dense


@query
def window_budget(c):
    return R.window_budget(c.dense)


@query
def dense_topk(c):
    return c.dense_items


@query
def dense_skipped(c):
    return R.skipped(c.plans, c.vectors, c.scoped)


@query
def hybrid_rrf_topk(c):
    shown = cut(c.bm25_items.select("plan_id", "representation_id", "object_id").unionByName(c.dense_items.select("plan_id", "representation_id", "object_id")).distinct())
    return R.hybrid_topk(c.bm25_items, c.dense_items, cut(R.dense_scores(c.plan_vectors, c.vectors, shown)))


@query
def identity_rerank(c):
    return R.identity_rerank(c.bm25_items.select("plan_id", "object_id", "rank")).select("plan_id", "rank", "object_id", "score")


@query
def rerank_topk(c):
    return R.rerank(c.bm25_items, c.plans, c.windows, X.shared_words)


@query
def random_topk(c):
    return R.random_topk(c.allowed, "seed-1")


@query
def wrong_grade_topk(c):
    return R.broken_topk(c.plans, c.objects, "wrong_grade")


@query
def answer_only_topk(c):
    return R.broken_topk(c.plans, c.objects, "answer_only")


@query
def cross_tenant_topk(c):
    return R.broken_topk(c.plans, c.objects, "cross_tenant")


# Decision and packs


@query
def query_plans(c):
    s = lambda f: F.array_join(F.transform("slots", f), "|")
    return c.query_plans.select("plan_id", "ceiling", long("ceiling_rank").alias("ceiling_rank"), s(lambda x: x["slot_id"]).alias("slots"), s(lambda x: x["role"]).alias("roles"), F.coalesce("hypothesis", F.lit("")).alias("hypothesis"))


@query
def top_objects(c):
    return D.top_objects(c.dense_items).select("plan_id", "object_rank", "object_id", "representation_id", "score")


@query
def sufficiency_gate(c):
    return c.decisions


@query
def sibling_windows(c):
    return c.siblings


@query
def pack_blocks(c):
    return c.packs.select("plan_id", "rank", "object_id", bar("block_ids").alias("blocks"))


@query
def slot_fill(c):
    return c.filled


@query
def evidence_pack(c):
    text = cut(D.pack_texts(c.packs, c.cited))
    own = cut(c.objects.select("object_id", "source_id", "heading_path").join(R.few(c.packs.select("object_id").distinct()), "object_id", "left_semi"))
    rows = c.packs.join(c.filled, ["plan_id", "rank", "object_id"]).join(c.spans, ["plan_id", "rank", "object_id"]).join(text, ["plan_id", "rank", "object_id"], "left")
    rows = rows.join(own, "object_id")
    packs = c.statuses.select("plan_id", "status").join(rows, "plan_id", "left")
    return packs.select("plan_id", "status", "rank", "object_id", "slot_id", "role", "source_id", "heading_path", "page", bar("block_ids").alias("blocks"), "score", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_digest"))


@query
def pack_status(c):
    return c.statuses


@query
def pack_spans(c):
    return c.spans


@query
def candidate_trace(c):
    return D.candidate_trace(c.bm25_items, c.decisions).select("plan_id", "object_id", "rank", "score", "admitted", F.coalesce("rejection_reason", F.lit("")).alias("rejection_reason"))


@query
def corpus_checksum(c):
    return D.corpus_checksum(c.sources, c.objects, c.windows)


@query
def release_manifest(c):
    shown = A.servable(c.objects, c.sources, T.LICENSED)
    return shown.groupBy("source_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("object_id")), "|"), 256).alias("objects_digest"), F.count(F.lit(1)).alias("objects"))


@query
def lineage_failures(c):
    ids = c.bm25_items.filter("rank <= 5")
    objects = c.objects.filter(F.col("doc_id") % 19 != 3)
    return D.lineage_failures(ids, c.objects.filter(F.col("doc_id") % 7 != 2).select("object_id"), c.sources.filter(F.col("n") % 6 != 1).select("source_id"), objects)


@query
def serve_evidence(c):
    from ..streaming.serve import answer

    requests = c.plans.select(F.col("plan_id").alias("interaction_id"), "query", "grade", "subject", F.lit("t1").alias("token"))
    return answer(c, requests, {"t1": T.TENANT}, pilot=True)


# Evaluation


@query
def case_results(c):
    return c.bm25_results.drop(*E.AXES[:-1], "holdout")


@query
def invariant_violations(c):
    return c.violations(cut(R.broken_topk(c.plans, c.objects, "cross_tenant")))


@query
def score_report(c):
    return E.score_report(c.bm25_results)


@query
def slice_scores(c):
    return c.slices.drop("axes")


@query
def failing_slices(c):
    return E.failing_slices(c.slices).drop("axes")


@query
def distinctive_failures(c):
    return E.distinctive_failures(E.failing_slices(c.slices, 3))


@query
def broken_detection(c):
    runs = {"bm25": c.bm25_items, "random": cut(R.random_topk(c.allowed, "seed-1"))}
    runs |= {kind: cut(R.broken_topk(c.plans, c.objects, kind)) for kind in ("wrong_grade", "answer_only", "cross_tenant")}
    out = None
    for name, items in runs.items():
        # One at a time: the plan of all five together is what fills the driver.
        one = cut(E.score_report(cut(c.results(items)))).select(F.lit(name).alias("retriever"), "recall_pack", "violations")
        out = one if out is None else out.unionByName(one)
    return E.worse(out, "bm25")


@query
def calibrate_midpoint(c):
    return E.calibrate(c.bm25_results.filter("not holdout"))


@query
def calibrate_budget(c):
    return E.calibrate(c.bm25_results.filter("not holdout"), 0.1)


@query
def spans_resolve(c):
    return E.spans_resolve(c.packs, c.spans, c.cited)


@query
def citation_cases(c):
    return c.citations


@query
def citation_report(c):
    return E.citation_report(c.citations)


@query
def citation_gates(c):
    return E.failing_gates(E.citation_report(c.citations))


@query
def clopper_pearson(c):
    n = c.table("orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "P").alias("s"), F.count(F.lit(1)).alias("all"))
    rows = n.select("o_orderpriority", F.col("s").alias("successes"), F.col("all").alias("trials"))
    return rows.select("o_orderpriority", "successes", "trials", F.round(E.lower_bound(F.col("successes"), F.col("trials")), 6).alias("bound"))


@query
def holdout_report(c):
    rows = c.cases.select(F.concat(F.lit("plan-"), "case_id").alias("plan_id"), "holdout", "answerable").join(c.decisions.select("plan_id", F.col("answerable").alias("answered")), "plan_id")
    return E.holdout_report(rows)


@query
def unadjudicated_cases(c):
    return c.cases.filter((F.col("holdout") | ~F.col("answerable")) & (F.col("n_adjudicators") < 2)).select("case_id")


@query
def broken_gold(c):
    g = c.gold.select("case_id", F.when(F.substring("case_id", 2, 9).cast("int") % 3 == 0, F.concat("block_id", F.lit("x"))).otherwise(F.col("block_id")).alias("block_id"))
    return S.broken_gold(g, c.blocks)


@query
def orphan_gold(c):
    cited = c.windows.filter("number > 1").select(F.explode("block_ids").alias("block_id")).distinct()
    return S.orphan_gold(c.gold.select("case_id", "block_id"), c.blocks, cited)


@query
def formula_triage(c):
    f = c.blocks.filter("block_type = 'formula'").select("block_id", (F.coalesce("latex", F.lit("")) != "").alias("attached"), (~C.unusable(F.col("text"))).alias("readable"))
    return S.triage(f)


@query
def roundtrip_drift(c):
    after = c.blocks.filter(F.col("pos") % 13 != 5).select(F.when(F.col("pos") % 17 == 3, F.concat("block_id", F.lit("n"))).otherwise(F.col("block_id")).alias("block_id"), F.when(F.col("pos") % 4 == 1, F.upper("text")).otherwise(F.col("text")).alias("text"), "latex")
    return S.drift(c.blocks.select("block_id", "text", "latex"), after, "block_id", ["text", "latex"])


@query
def screen_summary(c):
    docs = c.table("documents").select(F.col("doc_id").alias("case_id"))
    return S.screen_summary(docs, c.table("labels").select(F.col("doc_id").alias("case_id"), F.when(F.col("quality") == 1, "agree").otherwise("disagree").alias("verdict")))


@query
def paraphrase_registers(c):
    t = c.table("conversations").filter("role = 'user'")
    first = t.groupBy("conv_id").agg(F.min_by("turn", "turn").alias("parent"))
    rows = t.join(first, "conv_id").filter(F.col("turn") > F.col("parent"))
    register = F.when(F.length("text") < 60, "short").when(F.col("text").contains("?"), "question").otherwise("long")
    return rows.groupBy(register.alias("register")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("conv_id").alias("parents"))


@query
def learning_evidence(c):
    e = c.table("events")
    return e.dropDuplicates(["event_id"]).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.get_json_object("props", "$.k").cast("long")).alias("most_hints"), F.round(F.sum("value"), 4).alias("value"))


# Formulas


@query
def symbol_multiset(c):
    rows = c.spark.createDataFrame(X.FORMULAS, "block_id string, degraded string, candidate string")
    return rows.select("block_id", "candidate", F.explode(C.symbols(F.col("candidate"))).alias("symbol")).groupBy("block_id", "candidate", "symbol").agg(F.count(F.lit(1)).alias("n"))


@query
def multiset_similarity(c):
    b = c.blocks.filter("block_type = 'formula'").select("object_id", "block_id", F.coalesce(F.when(F.col("text") != "", F.col("text")), "latex").alias("t"))
    h = c.objects.select("object_id", "heading_path")
    return b.join(h, "object_id").select("block_id", F.round(C.multiset_similarity(F.col("t"), F.col("heading_path")), 6).alias("similarity"))


@query
def order_similarity(c):
    return M.order_similarity(c.spark.createDataFrame(X.FORMULAS, "block_id string, degraded string, candidate string"))


@query
def best_match(c):
    return M.best_match(c.spark.createDataFrame(X.FORMULAS, "block_id string, degraded string, candidate string"))


@query
def attach_latex(c):
    rows = c.spark.createDataFrame(X.FORMULAS, "block_id string, degraded string, candidate string")
    return M.attach(rows.select("block_id").distinct(), M.best_match(rows))


@query
def near_page_candidates(c):
    b = c.blocks.withColumn("t", F.coalesce(F.when(F.col("text") != "", F.col("text")), "latex"))
    f = b.filter("block_type = 'formula'").select(F.col("object_id").alias("document_id"), "block_id", "page", F.col("t").alias("degraded"))
    return M.near_page_candidates(f, b.filter("block_type = 'table'").select(F.col("object_id").alias("document_id"), "page", F.col("t").alias("candidate")))


_benches: dict[tuple[str, str], Bench] = {}


def bench(spark: SparkSession, sf_dir: str) -> Bench:
    """The corpus of a directory, shared by the queries of a session; what they share is written once to the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _benches:
        _benches.clear()
        _benches[key] = Bench(spark, sf_dir)
    return _benches[key]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(bench(spark, sf_dir))) for name, f in Q.items()}
