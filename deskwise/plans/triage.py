"""End-to-end triage: classify, retrieve, decide, respond."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskwise import session
from deskwise.config import TriageConfig
from deskwise.functions import text as tx
from deskwise.functions.columns import compute_once
from deskwise.operators import decisions, retrieval
from deskwise.session import broadcast_if_small, materialize

CASE_FIELDS = ("customer", "response", "intent", "intent_confidence", "similarity", "score", "intent_match")


def split_valid(messages: DataFrame, message: str = "customer_message") -> tuple[DataFrame, DataFrame]:
    """(messages with text after cleaning, null or blank ones): bad input never stops the flow."""
    flagged = flag_blank(messages, message)
    return flagged.where(~F.col("blank")).drop("blank"), flagged.where("blank").drop("blank")


def flag_blank(messages: DataFrame, message: str = "customer_message") -> DataFrame:
    """Adds ``blank``: nothing is left of the message after cleaning."""
    return compute_once(messages, {"blank": tx.clean_text(message, "runtime") == ""})


def retrieve_cases(
    queries: DataFrame,
    history: DataFrame | None,
    cfg: TriageConfig,
    exclude_self: bool = False,
    carry: tuple[str, ...] = (),
    stored: bool = False,
    **options,
) -> DataFrame:
    """Re-ranked cases in long form.

    ``stored`` writes them to the shared folder, for callers that use them more than once: a few
    narrow rows per query against searching the whole history again.
    ``queries``: query_id, embedding, predicted_intent; ``history``: history_id, embedding, intent.
    """
    found = retrieval.semantic_candidates(
        queries, history, cfg.semantic_candidates, ("intent", *carry), exclude_self, **options
    )
    cases = retrieval.rerank(found, queries, cfg.top_k, cfg.semantic_weight, cfg.intent_weight)
    return materialize(cases, "cases") if stored else cases


def triage(
    queries: DataFrame, cases: DataFrame, cfg: TriageConfig, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Decision, reason and response per query.

    ``queries``: query_id, customer_message, predicted_intent, confidence. A query without any
    case has similarity 0 and is escalated by the similarity rule.
    """
    if cfg.profile == "runtime":
        queries = queries.withColumn("__text", tx.clean_text("customer_message", "runtime"))
    else:
        queries = queries.withColumn("__text", tx.strip("customer_message"))
    best = retrieval.best_similarity(cases, cfg.profile)
    # A narrow row per query, stored before it is asked for its size: sent while it can be, so that the texts stay where they are.
    best = broadcast_if_small(materialize(best, "best"), session.NARROW)
    df = queries.join(best, "query_id", "left").fillna(0.0, ["best_similarity"])
    df = decisions.decide(df, cfg, message="__text")
    df = decisions.respond(df, cfg.profile)
    if cfg.profile == "runtime":
        df = df.withColumns({c: F.round(c, 4) for c in ("confidence", "best_similarity")})
    return df.select(
        "query_id", "customer_message", *keep, "predicted_intent", "confidence", "decision",
        "escalation_reason", "best_similarity", "generated_response",
    )


def triage_wide(triaged: DataFrame, cases: DataFrame, history: DataFrame, cfg: TriageConfig) -> DataFrame:
    """Triage rows with ``retrieved_{rank}_*`` columns; texts are fetched for the winners only."""
    texts = history.select(
        "history_id", F.col("customer_message").alias("customer"), F.col("agent_response").alias("response")
    )
    fields = [f for f in CASE_FIELDS if f in (*texts.columns, *cases.columns)]
    if cfg.profile == "runtime":
        fields = [f for f in fields if f not in ("intent_confidence", "intent_match")]
        cases = cases.withColumns({c: F.round(c, 4) for c in ("similarity", "score")})
    wide = retrieval.wide_cases(
        retrieval.gather_cases(cases, texts, ["customer", "response"]), fields, cfg.top_k
    )
    return triaged.join(wide, "query_id", "left")


def run_summary(triaged: DataFrame) -> DataFrame:
    """Totals, automatic and escalated counts, mean best similarity; one row."""
    return triaged.agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.count_if(F.col("decision") == decisions.AUTO).alias("n_auto"),
        F.count_if(F.col("decision") == decisions.ESCALATE).alias("n_escalated"),
        F.countDistinct("predicted_intent").alias("n_intents"),
        F.avg("best_similarity").alias("mean_best_similarity"),
    )
