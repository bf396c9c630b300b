"""Escalation rules and response templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deskwise.config import TriageConfig
from deskwise.functions import lexicon as lx
from deskwise.functions.columns import compute_once
from deskwise.functions.text import contains_any, strip

ESCALATE, AUTO = "ESCALATE", "AUTO_HANDLE"


def rules(
    cfg: TriageConfig, intent: str, confidence: str, similarity: str, message: str
) -> list[tuple[str, Column, Column]]:
    """(rule, condition, reason text) in order of precedence."""
    texts = lx.REASONS[cfg.profile]

    def reason(rule: str, value: str | None = None) -> Column:
        if value and "%" in texts[rule]:
            return F.format_string(texts[rule], F.col(value))
        return F.lit(texts[rule])

    return [
        ("confidence", F.col(confidence) < cfg.min_confidence, reason("confidence", confidence)),
        ("similarity", F.col(similarity) < cfg.min_similarity, reason("similarity", similarity)),
        ("security", contains_any(message, cfg.security_terms), reason("security")),
        ("human", contains_any(message, cfg.human_terms), reason("human")),
        ("complaint", F.col(intent) == cfg.complaint_intent, reason("complaint")),
        ("excluded", F.col(intent) == cfg.excluded_intent, reason("excluded")),
    ]


def decide(
    df: DataFrame,
    cfg: TriageConfig,
    intent: str = "predicted_intent",
    confidence: str = "confidence",
    similarity: str = "best_similarity",
    message: str = "customer_message",
) -> DataFrame:
    """Adds ``decision`` and ``escalation_reason``.

    Runtime lists every reason that applies, batch names the first one only.
    """
    checks = rules(cfg, intent, confidence, similarity, message)
    if cfg.profile == "batch":
        reason = F.coalesce(*[F.when(cond, text) for _, cond, text in checks])
    else:
        joined = F.concat_ws("; ", *[F.when(cond, text) for _, cond, text in checks])
        reason = F.nullif(joined, F.lit(""))
    calm = F.lit(lx.REASONS[cfg.profile]["none"])
    return (
        compute_once(df, {"__reason": reason})
        .withColumn("decision", F.when(F.col("__reason").isNull(), AUTO).otherwise(ESCALATE))
        .withColumn("escalation_reason", F.coalesce("__reason", calm))
        .drop("__reason")
    )


def templates(spark: SparkSession, profile: str) -> DataFrame:
    """Answer texts by intent: a dimension of at most one row per intent."""
    return spark.createDataFrame(list(lx.TEMPLATES[profile].items()), "t_intent string, template string")


def with_template(df: DataFrame, profile: str, intent: str = "predicted_intent") -> DataFrame:
    """Adds ``template``; unknown intents get the profile's fallback text."""
    dim = F.broadcast(templates(df.sparkSession, profile))
    joined = df.join(dim, F.col(intent) == F.col("t_intent"), "left").drop("t_intent")
    return joined.withColumn("template", F.coalesce("template", F.lit(lx.FALLBACK[profile])))


def respond(df: DataFrame, profile: str, intent: str = "predicted_intent") -> DataFrame:
    """Adds ``generated_response``: the template, or the hand-over text when escalated."""
    answer = F.when(F.col("decision") == AUTO, F.col("template")).otherwise(
        F.lit(lx.HANDOVER[profile])
    )
    return with_template(df, profile, intent).withColumn("generated_response", answer).drop("template")


def normalise_decision(c: Column | str) -> Column:
    return F.upper(strip(c))
