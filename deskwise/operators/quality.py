"""Automated screening of generated responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deskwise.functions import lexicon as lx
from deskwise.functions.columns import compute_once
from deskwise.functions.text import contains_any, contains_any_in, strip


def is_present(c: Column | str, n: int = 20) -> Column:
    return F.length(strip(c)) >= n


def is_actionable(c: Column | str, terms=lx.ACTION_TERMS) -> Column:
    return contains_any(c, terms)


def is_safe(c: Column | str, terms=lx.SENSITIVE_TERMS) -> Column:
    return ~contains_any(c, terms)


def keywords(spark: SparkSession, table: dict[str, tuple[str, ...]] = lx.INTENT_KEYWORDS) -> DataFrame:
    rows = [(intent, list(words)) for intent, words in table.items()]
    return spark.createDataFrame(rows, "k_intent string, keywords array<string>")


def band(score: Column | str) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s == 4, "GOOD").when(s >= 2, "PARTIAL").otherwise("POOR")


def screen(
    df: DataFrame,
    response: str = "generated_response",
    intent: str = "predicted_intent",
    keyword_table: dict[str, tuple[str, ...]] = lx.INTENT_KEYWORDS,
    action_terms=lx.ACTION_TERMS,
    sensitive_terms=lx.SENSITIVE_TERMS,
) -> DataFrame:
    """Adds the four flags, ``quality_score`` (0-4) and ``quality``.

    Relevance is judged against ``intent`` (by default the predicted one); an intent without
    keywords is always relevant. The keyword table has one row per intent and is broadcast.
    """
    text = F.coalesce(F.col(response), F.lit(""))
    dim = F.broadcast(keywords(df.sparkSession, keyword_table))
    joined = df.join(dim, F.lower(F.coalesce(F.col(intent), F.lit(""))) == F.col("k_intent"), "left")
    flags = compute_once(
        joined,
        {
            "response_present": is_present(text),
            "actionable": is_actionable(text, action_terms),
            "safe": is_safe(text, sensitive_terms),
            "intent_relevant": F.coalesce(contains_any_in(text, "keywords"), F.lit(True)),
        },
    ).drop("k_intent", "keywords")
    names = ("response_present", "actionable", "safe", "intent_relevant")
    total = sum((F.col(n).cast("int") for n in names[1:]), F.col(names[0]).cast("int"))
    return flags.withColumn("quality_score", total).withColumn("quality", band("quality_score"))


def summary(screened: DataFrame) -> DataFrame:
    """metric / value rows, percentages at two decimals; one aggregation pass."""
    flags = {
        "Response Present %": F.col("response_present"),
        "Actionable %": F.col("actionable"),
        "Safe %": F.col("safe"),
        "Intent Relevant %": F.col("intent_relevant"),
        "GOOD %": F.col("quality") == "GOOD",
        "PARTIAL %": F.col("quality") == "PARTIAL",
        "POOR %": F.col("quality") == "POOR",
    }
    one = screened.agg(
        F.count(F.lit(1)).cast("double").alias("Total Responses"),
        *[F.round(F.avg(c.cast("double")) * 100, 2).alias(k) for k, c in flags.items()],
    )
    return one.unpivot([], one.columns, "metric", "value")


def poor_examples(screened: DataFrame, order: str, n: int = 10) -> DataFrame:
    return screened.where(F.col("quality") == "POOR").orderBy(order).limit(n)
