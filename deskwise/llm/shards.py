"""Sharding: rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskwise.llm.blocks import text_or_empty
from deskwise.session import materialize


def rendezvous(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard with the best weighted draw for a key.

    Every shard draws a number from (0, 1) by hashing itself with the key; ``-ln(draw) / weight`` is
    smallest for shard s with probability weight(s) / sum of weights. A shard's draws do not depend on the
    other shards, so a new shard only takes rows and a removed one only gives them away. Equal keys,
    nulls among them, always share a shard. A weight must be above zero.
    """
    draws = [
        F.struct(
            (-F.log((F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11) + 0.5) / float(1 << 53)) / float(weight)).alias("cost"),
            F.lit(int(shard)).alias("shard"),
        )
        for shard, weight in weights.items()
    ]
    return F.array_min(F.array(*draws))["shard"]


def assign_shards(df: DataFrame, key: str, weights: Mapping[int, float], into: str = "shard") -> DataFrame:
    """``df`` with the shard of every row; a column already called ``into`` is replaced."""
    return df.withColumn(into, rendezvous(F.col(key), weights))


def shard_rows(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    weights: Mapping[int, float] | None = None,
    grown: Mapping[int, float] | None = None,
    buckets: int = 256,
) -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, law, shard, slot, grown_shard.

    Slots count from 0 within each shard without gaps. No shard is sorted by one task: rows are numbered within
    ``shards * buckets`` small groups, and each group starts after the rows of the groups before it
    (a table of that fixed size, hence broadcast). Equal rows are counted before the shuffle and written
    out again at the end, so any number of them costs one row until then; they get neighbouring slots.

    A null text has size 1 and the crc32 of nothing (0); a null id is a key like any other. An empty
    table gives no rows; other columns of ``docs`` are ignored.
    """
    weights = weights or {s: 1.0 for s in range(16)}
    grown = grown or {**weights, max(weights) + 1: 1.0}
    text = text_or_empty(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    groups = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    groups = groups.withColumns(
        {
            "shard": rendezvous(F.col("doc_id"), weights),
            "grown_shard": rendezvous(F.col("doc_id"), grown),
            "bucket": F.pmod(F.xxhash64("doc_id", "size", "text_crc32", F.lit(7)), F.lit(buckets)).cast("int"),
        }
    )
    groups = materialize(groups, "shard-groups")
    sizes = groups.groupBy("shard", "bucket").agg(F.sum("copies").alias("rows"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    inside = (
        Window.partitionBy("shard", "bucket")
        .orderBy("doc_id", "text_crc32", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = groups.withColumn("ahead", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    placed = placed.join(F.broadcast(starts), ["shard", "bucket"]).withColumn("first", F.col("start") + F.col("ahead"))
    step = 1 << 16  # copies are written out in pieces, so that no array grows with their number
    pieces = placed.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(step).cast("long"))))
    copies = pieces.withColumn("copy", F.explode(F.sequence("piece", F.least(F.col("piece") + (step - 1), F.col("copies") - 1))))
    return copies.select(
        "doc_id", "size", "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("first") + F.col("copy")).alias("slot"),
        "grown_shard",
    )
