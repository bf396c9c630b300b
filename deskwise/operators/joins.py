"""Joining a table to a lookup with one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskwise.session import small_table

ROWS_PER_TASK = 1_000_000  # rows of one key that one task joins
SALTS = 1024  # tasks for rows without a key, and for every key where hot keys are too many to list


def lookup_join(df: DataFrame, column: str, lookup: DataFrame, key: str, how: str, counts: DataFrame | None = None, max_rows: int | None = None) -> DataFrame:
    """Join ``df`` to ``lookup`` (distinct ``key``) without ever gathering the rows of a hot key.

    Up to a checked size the lookup is broadcast and ``df`` stays where it is. A larger one is shuffled: the
    rows of each key are counted, those of a hot key are dealt to as many tasks as its count asks for, and only
    the hot keys' lookup rows are repeated. The deal depends on the row and its partition, so that rows
    equal in every column are spread too and a repeated task deals them alike. ``counts`` (key, number of rows) saves
    the counting where the caller has done it, ``max_rows`` stands for the usual limit of rows that are broadcast.
    The rows of a stream can't be counted beforehand, so only its rows without a key are dealt; join its batches
    (``foreachBatch``) where a key may be hot.
    """
    small = small_table(lookup, max_rows)
    if small is not None:
        return df.join(small, F.col(column) == F.col(key), how)
    if df.isStreaming:
        spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(SALTS)).cast("int")
        dealt = df.withColumn("__salt", F.when(F.col(column).isNull(), spread).otherwise(0))
        on = (F.col(column) == F.col(key)) & (F.col("__salt") == F.col("__copy"))
        return dealt.join(lookup.withColumn("__copy", F.lit(0)), on, how).drop("__salt", "__copy")
    if counts is None:
        counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)))
    counts = counts.toDF("__hot", "__n")
    hot = counts.where(F.col("__n") > ROWS_PER_TASK).select(
        "__hot", F.ceil(F.col("__n") / ROWS_PER_TASK).cast("int").alias("__salts")
    )
    hot = small_table(hot)
    if hot is None:
        dealt, copies = df.withColumn("__salts", F.lit(SALTS)), lookup.withColumn("__salts", F.lit(SALTS))
    else:
        dealt = df.join(hot, F.col(column) == F.col("__hot"), "left").drop("__hot")
        copies = lookup.join(hot, F.col(key) == F.col("__hot"), "left").drop("__hot")
    salts = F.when(F.col(column).isNull(), SALTS).otherwise(F.coalesce("__salts", F.lit(1)))
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]) + F.spark_partition_id(), salts)
    dealt = dealt.withColumn("__salt", salt.cast("int")).drop("__salts")
    numbers = F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1)
    copies = copies.withColumn("__copy", F.explode(numbers)).drop("__salts")
    on = (F.col(column) == F.col(key)) & (F.col("__salt") == F.col("__copy"))
    return dealt.join(copies, on, how).drop("__salt", "__copy")
