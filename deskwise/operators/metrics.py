"""Frequencies, classification metrics, score statistics and retrieval metrics.

Classification metrics all start from :func:`pair_counts`, a table of at most k*k rows that is
combined map-side, so the data is read once whatever the number of metrics.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskwise.functions.text import strip


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def ratio(a: Column, b: Column) -> Column:
    """Division where x/0 is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def frequency(df: DataFrame, column: str, by: str = "count") -> DataFrame:
    """Value counts without nulls, by descending count or by key."""
    counts = (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("count"))
    )
    order = [F.desc("count"), F.asc(column)] if by == "count" else [F.asc(column)]
    return counts.orderBy(*order)


def distinct_count(df: DataFrame, column: str) -> DataFrame:
    """Exact number of distinct non-null values."""
    return df.agg(F.countDistinct(column).alias("n_distinct"))


def conditional_counts(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count_if(c).alias(k) for k, c in flags.items()]
    )


def percent_true(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    return df.agg(*[(F.avg(c.cast("double")) * 100).alias(k) for k, c in flags.items()])


def reason_mix(df: DataFrame, column: str, separator: str = "; ") -> DataFrame:
    reasons = df.select(F.explode(F.split(column, separator)).alias("reason"))
    return frequency(reasons, "reason")


def with_correct(df: DataFrame, truth: str, predicted: str, name: str = "correct") -> DataFrame:
    """Equality of the stripped values, null taken as empty; without a predicted column: false."""
    if predicted not in df.columns:
        return df.withColumn(name, F.lit(False))
    a, b = (strip(F.coalesce(F.col(c), F.lit(""))) for c in (truth, predicted))
    return df.withColumn(name, a == b)


# --- classification ------------------------------------------------------------------------


def pair_counts(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(
        F.coalesce(F.col(truth), F.lit("")).alias("actual"),
        F.coalesce(F.col(predicted), F.lit("")).alias("predicted"),
    ).agg(F.count(F.lit(1)).alias("n"))


def label_domain(pairs: DataFrame) -> DataFrame:
    """Sorted labels that occur as truth or as prediction."""
    both = pairs.select(F.explode(F.array("actual", "predicted")).alias("label"))
    return both.distinct().orderBy("label")


def confusion_pairs(pairs: DataFrame) -> DataFrame:
    wrong = pairs.where(F.col("actual") != F.col("predicted"))
    return wrong.withColumnRenamed("n", "count").orderBy(F.desc("count"), "actual", "predicted")


def confusion_matrix(pairs: DataFrame, labels: Sequence[str]) -> DataFrame:
    """One row per label of the domain (also never-true ones), one column per listed label."""
    cells = pairs.groupBy("actual").pivot("predicted", list(labels)).agg(F.sum("n"))
    rows = label_domain(pairs).withColumnRenamed("label", "actual")
    return rows.join(cells, "actual", "left").fillna(0)


def label_metrics(pairs: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per label of truth or prediction."""
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(F.lit(0))
    sides = F.array(
        F.struct(F.col("actual").alias("label"), F.col("n").alias("s"),
                 F.lit(0).cast("bigint").alias("p"), hit.cast("bigint").alias("tp")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("s"),
                 F.col("n").alias("p"), F.lit(0).cast("bigint").alias("tp")),
    )
    totals = (
        pairs.select(F.explode(sides).alias("x"))
        .groupBy("x.label")
        .agg(F.sum("x.s").alias("support"), F.sum("x.p").alias("n_predicted"), F.sum("x.tp").alias("tp"))
    )
    return totals.select(
        "label",
        ratio(F.col("tp"), F.col("n_predicted")).alias("precision"),
        ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("n_predicted") + F.col("support")).alias("f1"),
        "support",
        "tp",
    )


def accuracy(pairs: DataFrame) -> DataFrame:
    hits = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(F.lit(0)))
    return pairs.agg(F.sum("n").alias("n_rows"), ratio(hits, F.sum("n")).alias("accuracy"))


def _averages(labels: DataFrame, weighted: bool) -> list[Column]:
    if not weighted:
        return [F.avg(m).alias(m) for m in ("precision", "recall", "f1")]
    return [
        ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m)
        for m in ("precision", "recall", "f1")
    ]


def macro_weighted(pairs: DataFrame) -> DataFrame:
    labels = label_metrics(pairs)
    return union_all(
        [
            labels.agg(F.lit(name).alias("average"), *_averages(labels, weighted))
            for name, weighted in (("macro", False), ("weighted", True))
        ]
    )


def class_report(pairs: DataFrame) -> DataFrame:
    """Per-label rows followed by ``accuracy``, ``macro avg`` and ``weighted avg``."""
    labels = label_metrics(pairs)
    per_label = labels.select("label", "precision", "recall", "f1", "support")
    share = ratio(F.sum("tp"), F.sum("support"))
    total = F.sum("support").alias("support")
    overall = labels.agg(
        F.lit("accuracy").alias("label"), share.alias("precision"), share.alias("recall"),
        share.alias("f1"), total,
    )
    macro = labels.agg(F.lit("macro avg").alias("label"), *_averages(labels, False), total)
    weighted = labels.agg(F.lit("weighted avg").alias("label"), *_averages(labels, True), total)
    return union_all([per_label, overall, macro, weighted])


def binary_prf(pairs: DataFrame, positive: str) -> DataFrame:
    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))

    truth, guess = F.col("actual") == positive, F.col("predicted") == positive
    counts = pairs.agg(
        total(truth & guess).alias("tp"), total(~truth & guess).alias("fp"),
        total(truth & ~guess).alias("fn"), total(~truth & ~guess).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        "tp", "fp", "fn", "tn",
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def majority_baseline(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """Accuracy on ``test`` of always answering the commonest ``train`` label (ties: lowest)."""
    counts = train.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    common = counts.agg(F.min(F.struct(-F.col("n"), F.col(label).alias("label")))["label"].alias("m"))
    votes = test.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    pairs = votes.select(
        F.coalesce(F.col(label), F.lit("")).alias("actual"), common.scalar().alias("predicted"), "n"
    )
    hits = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(F.lit(0)))
    return pairs.agg(
        F.min("predicted").alias("majority_label"),
        F.sum("n").alias("n_rows"),
        ratio(hits, F.sum("n")).alias("accuracy"),
    )


def method_lift(results: DataFrame, best: str) -> DataFrame:
    """Percentage points by which method ``best`` beats each row (method, accuracy)."""
    top = results.where(F.col("method") == best).agg(F.max("accuracy"))
    lift = (top.scalar() - F.col("accuracy")) * 100
    return results.withColumn("lift_pp", lift)


# --- score statistics ----------------------------------------------------------------------


def describe_scores(
    df: DataFrame, group: str, score: str, decimals: int = 6, probs: Sequence[float] = (0.25, 0.5, 0.75)
) -> DataFrame:
    """count, mean, std (n-1), min, exact interpolated quartiles and max per group.

    Scores are rounded, so that a group has at most ``2 * 10**decimals + 1`` distinct values in
    [-1, 1]. Equal values are counted map-side and quartiles are read off the cumulative counts:
    no group is gathered, whatever its number of rows, unlike the built-in exact percentile.
    """
    rounded = df.where(F.col(score).isNotNull()).select(group, F.round(score, decimals).alias("v"))
    values = rounded.groupBy(group, "v").agg(F.count(F.lit(1)).alias("c"))
    running = Window.partitionBy(group).orderBy("v")
    spread = values.withColumn("upto", F.sum("c").over(running)).withColumn(
        "n", F.sum("c").over(Window.partitionBy(group))
    )

    def at(index: Column) -> Column:
        return F.max(F.when((F.col("upto") > index) & (F.col("upto") - F.col("c") <= index), F.col("v")))

    aggs = []
    for i, p in enumerate(probs):
        place = (F.col("n") - 1) * F.lit(p)
        aggs += [at(F.floor(place)).alias(f"lo{i}"), at(F.ceil(place)).alias(f"hi{i}")]
    mean = F.sum(F.col("v") * F.col("c")) / F.sum("c")
    rows = spread.groupBy(group).agg(
        F.sum("c").alias("n"), mean.alias("mean"),
        F.min("v").alias("min"), F.max("v").alias("max"), *aggs,
    )
    # Second moment around the mean, so that close scores do not cancel.
    spread2 = values.join(rows.select(group, "mean"), group).groupBy(group).agg(
        F.sum(F.col("c") * F.pow(F.col("v") - F.col("mean"), 2)).alias("ss")
    )
    out = rows.join(spread2, group)

    def quantile(i: int, p: float) -> Column:
        place = (F.col("n") - 1) * F.lit(p)
        part = place - F.floor(place)
        return F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * part

    std = F.when(F.col("n") > 1, F.sqrt(F.col("ss") / (F.col("n") - 1)))
    return out.select(
        group, F.col("n").alias("count"), "mean", std.alias("std"), "min",
        *[quantile(i, p).alias(f"p{round(p * 100)}") for i, p in enumerate(probs)], "max",
    )


# --- retrieval evaluation ------------------------------------------------------------------
# Input is the long form: one row per (query, rank) with the truth and the retrieved intent.


def wide_to_long(wide: DataFrame, ids: Sequence[str], fields: Sequence[str], k: int = 5) -> DataFrame:
    """Unpivot ``retrieved_{rank}_{field}`` columns; ranks that are not there are skipped."""
    ranks = [r for r in range(1, k + 1) if f"retrieved_{r}_{fields[0]}" in wide.columns]
    if not ranks:
        raise ValueError("no retrieved_<rank> columns found")
    entries = [
        F.struct(F.lit(r).alias("rank"), *[F.col(f"retrieved_{r}_{f}").alias(f) for f in fields])
        for r in ranks
    ]
    return wide.select(*ids, F.explode(F.array(*entries)).alias("e")).select(*ids, "e.*")


def available_ranks(wide: DataFrame, field: str = "intent", k: int = 5) -> list[int]:
    return [r for r in range(1, k + 1) if f"retrieved_{r}_{field}" in wide.columns]


def rank_consistency(cases: DataFrame, match: str = "match") -> DataFrame:
    return (
        cases.groupBy("rank")
        .agg(F.count(F.lit(1)).alias("n_queries"), F.avg(F.col(match).cast("double")).alias("consistency"))
        .orderBy("rank")
    )


def first_match(cases: DataFrame, query: str = "query_id", match: str = "match") -> DataFrame:
    """Lowest matching rank per query, null where none matches."""
    return cases.groupBy(query).agg(
        F.min(F.when(F.col(match), F.col("rank"))).alias("first_matching_rank")
    )


def hit_rates(firsts: DataFrame, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    rank = F.col("first_matching_rank")
    return firsts.agg(
        F.count(F.lit(1)).alias("n_queries"),
        *[F.avg(F.coalesce(rank <= k, F.lit(False)).cast("double")).alias(f"top{k}") for k in ks],
    )


def intent_table(cases: DataFrame, intent: str, ranks: Sequence[int] = (1, 2, 3, 4, 5)) -> DataFrame:
    """Support and per-rank consistency for every true intent, most frequent first."""
    match = F.col("match").cast("double")
    return (
        cases.groupBy(intent)
        .agg(
            F.count_if(F.col("rank") == ranks[0]).alias("support"),
            *[
                F.avg(F.when(F.col("rank") == r, match)).alias(f"top_{r}_intent_consistency")
                for r in ranks
            ],
        )
        .orderBy(F.desc("support"), F.asc(intent))
    )


def retrieval_examples(cases: DataFrame, matching: bool, n: int, order: str = "query_id") -> DataFrame:
    """First ``n`` queries whose best case does (not) match."""
    top = cases.where((F.col("rank") == 1) & (F.col("match") == F.lit(matching)))
    return top.orderBy(order).limit(n)
