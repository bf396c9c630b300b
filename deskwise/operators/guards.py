"""Leakage guards: keep evaluation examples out of training and history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from deskwise.functions import text as tx
from deskwise.functions.columns import compute_once
from deskwise.operators.joins import lookup_join
from deskwise.session import materialize


def _keys(golden: DataFrame, key: Column) -> DataFrame:
    return golden.select(key.alias("__key")).where("__key IS NOT NULL").distinct()


def _text_keys(golden: DataFrame, message: str) -> DataFrame:
    return _keys(golden, tx.digest(tx.strip(message)))


def exclude_ids(df: DataFrame, golden: DataFrame, key: str, golden_key: str | None = None) -> DataFrame:
    """Drop rows whose id is in ``golden``; rows without an id stay."""
    return lookup_join(df, key, _keys(golden, F.col(golden_key or key)), "__key", "left_anti")


def _by_message(df: DataFrame, golden: DataFrame, message: str, golden_message: str | None, how: str):
    digested = compute_once(df, {"__digest": tx.digest(tx.strip(message))})
    keys = _text_keys(golden, golden_message or message)
    return lookup_join(digested, "__digest", keys, "__key", how).drop("__digest")


def exclude_messages(
    df: DataFrame, golden: DataFrame, message: str, golden_message: str | None = None
) -> DataFrame:
    """Drop rows whose stripped text equals a golden text; texts are compared by digest."""
    return _by_message(df, golden, message, golden_message, "left_anti")


def golden_matches(
    df: DataFrame, golden: DataFrame, message: str, golden_message: str | None = None
) -> DataFrame:
    """The rows :func:`exclude_messages` removes."""
    return _by_message(df, golden, message, golden_message, "left_semi")


def removed_counts(
    df: DataFrame, golden: DataFrame, key: str, message: str
) -> DataFrame:
    """How many rows each guard removes, and how many rows pass both; one row.

    Rows are reduced to id and digest, and both flags are counted in a single pass.
    """
    rows = compute_once(df.select(key, message), {"__digest": tx.digest(tx.strip(message))}).drop(message)
    flagged = lookup_join(rows, key, _keys(golden, F.col(key)), "__key", "left")
    flagged = flagged.withColumnRenamed("__key", "__id_hit")
    flagged = lookup_join(flagged, "__digest", _text_keys(golden, message), "__key", "left")
    by_id, by_text = F.col("__id_hit").isNotNull(), F.col("__key").isNotNull()
    return flagged.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(by_id).alias("removed_by_id"),
        F.count_if(by_text).alias("removed_by_message"),
        F.count_if(~by_id & ~by_text).alias("n_kept"),
    )


def write_guarded(df: DataFrame, golden: DataFrame, key: str, message: str, path: str) -> dict[str, int]:
    """Write the rows that pass both guards and return the counts of :func:`removed_counts`, taken by the writing job itself.

    One pass: rows are flagged, observed as they flow by, and only then filtered.
    """
    seen = Observation("guards")
    flagged = compute_once(df, {"__digest": tx.digest(tx.strip(message))})
    flagged = lookup_join(flagged, key, _keys(golden, F.col(key)), "__key", "left").withColumnRenamed("__key", "__id_hit")
    flagged = lookup_join(flagged, "__digest", _text_keys(golden, message), "__key", "left")
    by_id, by_text = F.col("__id_hit").isNotNull(), F.col("__key").isNotNull()
    counts = [F.count_if(by_id).alias("removed_by_id"), F.count_if(by_text).alias("removed_by_message")]
    observed = flagged.observe(seen, F.count(F.lit(1)).alias("n_rows"), *counts, F.count_if(~by_id & ~by_text).alias("n_kept"))
    observed.where(~by_id & ~by_text).select(*df.columns).write.parquet(path)
    return dict(seen.get)


def join_truth(
    results: DataFrame, truth: DataFrame, key: str, columns: list[str]
) -> DataFrame:
    """Attach truth columns by a key; the truth side is reduced to one row per key first.

    Joining both sides on a repeated message text would multiply the copies. The one-row-per-key
    truth keeps the result as long as ``results``, however often one text repeats.
    """
    one = truth.groupBy(F.col(key).alias("__key")).agg(F.min(F.struct(*columns)).alias("__t"))
    return lookup_join(results, key, one.select("__key", "__t.*"), "__key", "inner").drop("__key")


PIECE = 1024  # rows of one side that meet rows of the other in a task


def join_truth_all(
    results: DataFrame, truth: DataFrame, key: str, left: Sequence[str], right: Sequence[str], piece: int = PIECE
) -> DataFrame:
    """Every result row with every truth row of the same text: ``left`` columns, then ``right`` columns.

    A text that is repeated on both sides gives left times right rows. Both counts are taken first, and the text is cut
    into pieces of at most ``piece`` rows a side: each result piece meets each truth piece in a task of its own, so
    no task makes more than ``piece * piece`` rows of a text. Texts move as digests; a null text meets nothing.
    """
    rows = compute_once(results.select(key, *left), {"__k": tx.digest(key)}).select("__k", *left).where("__k IS NOT NULL")
    facts = compute_once(truth.select(key, *right), {"__k": tx.digest(key)}).select("__k", *right).where("__k IS NOT NULL")
    sizes = [df.groupBy("__k").agg(F.ceil(F.count(F.lit(1)) / piece).cast("int").alias(n)) for df, n in ((rows, "__l"), (facts, "__r"))]
    sizes = materialize(sizes[0].join(sizes[1], "__k"), "fan-out")  # texts of one side only leave here
    cuts = sizes.withColumnRenamed("__k", "__key")

    def dealt(df: DataFrame, own: str, other: str, number: str, opposite: str) -> DataFrame:
        deal = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col(own)).cast("int")
        joined = lookup_join(df, "__k", cuts, "__key", "inner").drop("__key").withColumn(number, deal)
        return joined.withColumn(opposite, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("__l", "__r")

    # The deal is stored, so that a repeated task finds every row where it was.
    a = materialize(dealt(rows, "__l", "__r", "__i", "__j"), "fan-out-left")
    b = materialize(dealt(facts, "__r", "__l", "__j", "__i"), "fan-out-right")
    return a.alias("a").join(b.alias("b"), ["__k", "__i", "__j"]).select(*[F.col(f"a.{c}") for c in left], *[F.col(f"b.{c}") for c in right])


def truth_conflicts(truth: DataFrame, key: str, columns: Sequence[str], ids: str) -> DataFrame:
    """Texts with more than one truth row: first id, number of rows, number of different truths, and whether they differ.

    Rows are counted by digest and truth before they meet, so a text of many rows sends one row per different truth.
    """
    each = compute_once(truth.select(key, *columns, ids), {"__k": tx.digest(key)}).drop(key).where("__k IS NOT NULL")
    values = each.groupBy("__k", *columns).agg(F.count(F.lit(1)).alias("n"), F.min(ids).alias("first"))
    per_text = values.groupBy("__k").agg(F.min("first").alias("first_id"), F.sum("n").alias("n_truth"), F.count(F.lit(1)).alias("n_values"))
    found = per_text.where("n_truth > 1").drop("__k")
    return found.withColumn("conflict", F.col("n_values") > 1)


def text_fan_out(results: DataFrame, truth: DataFrame, message: str) -> DataFrame:
    """Size of the text join without building it: per-text counts of both sides, multiplied."""
    left = results.groupBy(tx.digest(message).alias("k")).agg(F.count(F.lit(1)).alias("n_left"))
    right = truth.groupBy(tx.digest(message).alias("k")).agg(F.count(F.lit(1)).alias("n_right"))
    return left.join(right, "k").agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.coalesce(F.sum("n_left"), F.lit(0)).alias("n_matched"),
        F.coalesce(F.sum(F.col("n_left") * F.col("n_right")), F.lit(0)).alias("n_joined"),
    )
