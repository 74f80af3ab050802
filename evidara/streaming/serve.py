"""Answering requests: as one batch, or as a stream of micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import access as A
from ..operators import decide as D
from ..operators import retrieve as R
from ..sources import testdata as T
from ..sources import vocabulary as V
from ..sources.stage import cut

LONGEST_QUERY, LONGEST_LEARNER = 2000, 128
#: Fixed: what a request may say. The tenant is not among it.
FIELDS = (
    "interaction_id", "at", "token", "query", "grade", "subject", "curriculum_version", "board", "concept_ids", "teaching_action",
    "assessment_state", "learner_state", "language", "modality", "learner_id",
)
#: Fixed: the whole phrase that lends unapproved sources to a pilot.
LEND = "yes-i-accept-unapproved-content"


def configuration(settings: dict[str, str]) -> dict:
    """What serving starts with: floor, ceiling, manifest, tokens (token: tenant) and whether it is a pilot.

    Nothing that decides an answer has a default: a missing floor, ceiling, manifest or token is an error.
    """
    told = {k: v.strip() for k, v in settings.items()}
    missing = [k for k in ("floor", "ceiling", "manifest", "tokens") if not told.get(k, "").strip(",")]
    if missing:
        raise ValueError(f"serving needs {', '.join(missing)}")
    tokens = {}
    for pair in filter(None, (p.strip() for p in told["tokens"].split(","))):
        token, _, tenant = pair.partition(":")
        if not (token and tenant):
            raise ValueError("tokens are token:tenant pairs between commas")
        tokens[token] = tenant
    if not tokens:
        raise ValueError("serving needs tokens")
    return {"floor": float(told["floor"]), "ceiling": float(told["ceiling"]), "manifest": told["manifest"], "tokens": tokens, "pilot": settings.get("lend") == LEND}


def checked(requests: DataFrame, tokens: dict[str, str]) -> DataFrame:
    """Requests with their tenant, which the token alone decides, and the status that bars them, if any.

    A request with a value in a field that is not of FIELDS, a tenant among them, is refused; such columns go.
    """
    tenant = V.lookup(tokens, F.col("token"))
    size = lambda c: F.length(F.coalesce(c, F.lit("")))
    bad = (size("query") < 1) | (size("query") > LONGEST_QUERY)
    if "learner_id" in requests.columns:
        bad = bad | (size("learner_id") > LONGEST_LEARNER)
    extra = [c for c in requests.columns if c not in FIELDS]
    for c in extra:
        bad = bad | F.col(c).isNotNull()
    status = F.when(tenant.isNull(), 401).when(bad, 422).otherwise(200)
    return requests.withColumns({"_tenant": tenant, "http": status}).drop(*extra).withColumnRenamed("_tenant", "tenant")


def answer(corpus, requests: DataFrame, tokens: dict[str, str], floor: float = 0.35, ceiling: float = 0.6, pilot: bool = False) -> DataFrame:
    """interaction_id, http, status, items of each request; a refusal is an answer with status abstain.

    F6: nothing is served from a corpus with an unapproved source, unless this is a pilot, which lends them.
    """
    licence = A.serving_licence(corpus.sources, pilot)
    rows = checked(requests, tokens)
    state = "learn"
    plans = rows.filter("http = 200").select(
        F.col("interaction_id").alias("plan_id"), "query", C.scoped_query(F.col("query"), F.col("grade"), F.col("subject")).alias("scoped"), "grade", "subject", "tenant",
        F.lit("pilot").alias("board"), F.lit(T.VERSION).alias("version"), F.lit(V.DISCLOSURE_RANK[V.CEILING[state]]).alias("ceiling_rank"),
    )
    objects, df = A.scoped(corpus.objects, corpus.sources, licence), corpus.frequencies
    items = cut(R.object_topk(R.bm25_of(R.matched(plans, cut(R.bm25_terms(plans, corpus.windows, df, corpus.facts)), corpus.windows, objects))))
    other = cut(R.object_topk(R.keyword_of(R.matched(plans, cut(R.keyword_terms(plans, corpus.windows, df, corpus.facts)), corpus.windows, objects))))
    decisions = D.gate(plans, items, other, corpus.windows, corpus.objects, floor, ceiling)
    packed = D.admitted(items, decisions).groupBy("plan_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "representation_id"))), lambda x: x["representation_id"]), "|").alias("items"))
    out = rows.join(decisions.withColumnRenamed("plan_id", "interaction_id"), "interaction_id", "left").join(packed.withColumnRenamed("plan_id", "interaction_id"), "interaction_id", "left")
    status = F.when(F.col("http") != 200, "rejected").when(F.col("answerable"), "answered").otherwise("abstain")
    return out.select("interaction_id", F.col("http").cast("long").alias("http"), status.alias("status"), F.coalesce("items", F.lit("")).alias("items"))


def serve(requests: DataFrame, handle: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, watermark: str = "10 minutes"):
    """Start a stream that answers each interaction once: requests (interaction_id, at, ...) that come again within the
    watermark are dropped, each micro-batch is answered as a batch, and ``sink(answers, epoch)`` may be repeated for an epoch."""
    once = requests.withWatermark("at", watermark).dropDuplicatesWithinWatermark(["interaction_id"])
    return once.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, epoch: sink(handle(df.drop("at")), epoch)).start()
