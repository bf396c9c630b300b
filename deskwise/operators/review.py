"""Human review: sheets, score intake and averages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskwise.operators.curation import blank_columns
from deskwise.operators.joins import lookup_join
from deskwise.operators.ranking import uniform_sample

SCORES = ("human_relevance", "human_actionability", "human_safety", "human_grounding", "human_overall")
NOTES = "human_notes"


def review_sheet(df: DataFrame, *ids: str, n: int = 50, seed: int = 42) -> DataFrame:
    """``n`` responses (or all, if fewer) with empty score and note columns."""
    picked = uniform_sample(df, n, seed, *ids)
    kept = picked.select(*ids, "customer_message", "predicted_intent", "generated_response")
    return blank_columns(kept, [*SCORES, NOTES])


def check_scores(df: DataFrame, scores=SCORES) -> DataFrame:
    """Scores become integers; ``valid`` is true when every one is a whole number from 1 to 5."""
    numbers = {s: F.col(s).try_cast("double") for s in scores}
    good = F.lit(True)
    for n in numbers.values():
        good = good & F.coalesce(n.isin(1.0, 2.0, 3.0, 4.0, 5.0), F.lit(False))
    flagged = df.withColumn("valid", good)
    return flagged.withColumns({s: F.col(s).try_cast("double").try_cast("int") for s in scores})


def upsert(current: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Rows of ``updates`` replace those of ``current`` with the same key."""
    keys = updates.select(F.col(key).alias("__updated")).where("__updated IS NOT NULL").distinct()
    return lookup_join(current, key, keys, "__updated", "left_anti").unionByName(updates)


def review_summary(df: DataFrame, scores=SCORES, overall: str = "human_overall", good: int = 4) -> DataFrame:
    """Mean of every score, and count and share of rows rated at least ``good`` overall."""
    hit = F.col(overall) >= good
    return df.agg(
        F.count(F.lit(1)).alias("n_reviewed"),
        *[F.avg(s).alias(f"avg_{s}") for s in scores],
        F.count_if(hit).alias("n_good"),
        (F.avg(hit.cast("double")) * 100).alias("good_pct"),
    )
