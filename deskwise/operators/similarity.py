"""Exact set-similarity join of texts, and near-identical cases of a history.

Two sets of shingles with a Jaccard similarity of ``percent`` or more share a shingle among the first few of
each, whatever order the shingles are in, as long as it is one order for all sets (prefix filter). Ordered from
rare to common, the first few are mostly in no other set, so few pairs ever meet. Lengths and the places
at which two sets meet bound the overlap that is still possible; pairs that pass are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskwise.functions import text as tx
from deskwise.functions.columns import compute_once, let
from deskwise.operators.groups import components
from deskwise.operators.joins import lookup_join
from deskwise.session import materialize

BUCKETS = 1 << 20  # counters that tell rare shingles from common ones; they shape the order, never the result
ROWS_PER_TASK = 4096  # sets behind one shingle, or pairs of one set, that a task takes


def shingles(text: Column | str, size: int = 5) -> Column:
    """Distinct 64-bit hashes of the word shingles of a text; fewer words make one shingle, none an empty set."""

    def of(words: Column) -> Column:
        n = F.size(words)
        starts = F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1)))
        return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(
            F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, size))))
        )

    return let(tx.tokens(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), of)


def shingle_counts(sets: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often the shingles of each of ``buckets`` hash buckets occur: as many numbers, whatever the input."""
    rows = sets.select(F.explode("shingles").alias("t")).groupBy(F.pmod("t", F.lit(buckets)).cast("int").alias("bucket"))
    found = rows.agg(F.count(F.lit(1)).alias("n")).toArrow()
    counts = np.zeros(buckets, np.int64)
    counts[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return counts


def prefix_length(size, percent: int):
    """Shingles of a set of which one must be shared: ``size - ceil(percent * size / 100) + 1``."""
    return size - (percent * size + 99) // 100 + 1


def prefixes(sets: DataFrame, percent: int, counts: np.ndarray) -> DataFrame:
    """(node, size, t, at): the rarest shingles of every set (node, shingles), with their places in its order.

    Sets are ordered where they lie; only the prefixes leave the task.
    """
    shipped = sets.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, 256) for k in range(0, whole.num_rows, 256)):
                column = batch.column("shingles")
                sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                flat = column.flatten().to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                order = np.lexsort((flat, shipped.value[flat % len(shipped.value)], owner))
                place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                keep = place < prefix_length(sizes, percent)[owner]
                owner = owner[keep]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").take(pa.array(owner)), pa.array(sizes[owner]), pa.array(flat[order][keep]), pa.array(place[keep])],
                    ["node", "size", "t", "at"],
                )

    kind = sets.schema["node"].dataType.simpleString()
    return sets.select("node", "shingles").mapInArrow(run, f"node {kind}, size bigint, t bigint, at bigint")


def candidate_pairs(heads: DataFrame, percent: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(a, b), a < b: sets that share a shingle of their prefixes and whose lengths and places allow the similarity.

    A shingle of many prefixes is cut: its sets are dealt to as many tasks as their number asks for, and each task
    meets all of them on the other side. Only counts of shared shingles are looked up.
    """
    counted = heads.groupBy("t").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counted = counted.select(F.col("t").alias("__t"), F.ceil(F.col("n") / rows_per_task).cast("int").alias("cuts"))
    shared = materialize(lookup_join(heads, "t", counted, "__t", "inner").drop("__t"), "shared-heads")
    a = shared.withColumn("cut", F.pmod(F.xxhash64("node"), "cuts").cast("int")).alias("a")
    b = shared.withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).alias("b")
    small, large = F.least("a.size", "b.size"), F.greatest("a.size", "b.size")
    left = F.least(F.col("a.size") - F.col("a.at"), F.col("b.size") - F.col("b.at"))  # this shingle and those behind it
    on = (F.col("a.t") == F.col("b.t")) & (F.col("a.cut") == F.col("b.cut")) & (F.col("a.node") < F.col("b.node"))
    on = on & (100 * small >= percent * large) & ((100 + percent) * left >= percent * (small + large))
    return a.join(b, on).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()


def similar_pairs(candidates: DataFrame, sets: DataFrame, percent: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(a, b, n_shared) of the candidates whose full sets are similar enough; a set of many pairs is dealt to many tasks."""
    counts = candidates.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / rows_per_task).cast("int").alias("cuts"))
    counts = materialize(counts.select(F.col("a").alias("__a"), "cuts"), "pair-counts")
    dealt = lookup_join(candidates, "a", counts, "__a", "inner").withColumn("cut", F.pmod(F.xxhash64("b"), "cuts").cast("int"))
    copies = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut")
    left = sets.join(counts, F.col("node") == F.col("__a")).select(F.col("node").alias("a"), F.col("shingles").alias("sa"), copies)
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = dealt.select("a", "b", "cut").join(right, "b").join(left, ["a", "cut"])
    rows = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("n_shared"), (F.size("sa") + F.size("sb")).alias("n"))
    return rows.where(100 * F.col("n_shared") >= percent * (F.col("n") - F.col("n_shared"))).select("a", "b", "n_shared")


@dataclass(frozen=True)
class SimilarSets:
    """Result of :func:`similarity_join`, as stored tables.

    ``rows``: key, node (null without words), n_shingles; ``nodes``: node, copies; ``candidates``: a, b; ``links``: a, b, n_shared.
    """

    rows: DataFrame
    nodes: DataFrame
    candidates: DataFrame
    links: DataFrame


def similarity_join(df: DataFrame, key: str, text: str, percent: int = 80, size: int = 5, rows_per_task: int = ROWS_PER_TASK) -> SimilarSets:
    """All pairs of distinct shingle sets whose Jaccard similarity is at least ``percent`` in a hundred; exact.

    Rows of equal sets are one node, so copies meet nobody twice. Texts without words are in no node.
    """
    sets = compute_once(df.select(F.col(key).alias("key"), F.col(text).alias("text")), {"shingles": F.array_sort(shingles("text", size))})
    mark = F.struct(F.xxhash64(F.lit(1), "shingles").alias("h1"), F.xxhash64(F.lit(2), "shingles").alias("h2"))
    rows = materialize(sets.select("key", "shingles", F.size("shingles").alias("n_shingles"), mark.alias("mark")), "shingle-rows")
    worded = rows.where("n_shingles > 0")
    nodes = worded.groupBy("mark").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("copies"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    named = nodes.select(F.col("mark").alias("__mark"), "node", "first")
    marked = lookup_join(rows.withColumn("mark", F.when(F.col("n_shingles") > 0, F.col("mark"))), "mark", named, "__mark", "left")
    marked = materialize(marked.select("key", "node", "n_shingles", F.when(F.col("key").eqNullSafe(F.col("first")), F.col("shingles")).alias("shingles")), "marked")
    full = materialize(marked.where("shingles IS NOT NULL AND node IS NOT NULL").select("node", "shingles").dropDuplicates(["node"]), "sets")
    heads = prefixes(full, percent, shingle_counts(full))
    candidates = materialize(candidate_pairs(heads, percent, rows_per_task), "candidates")
    links = materialize(similar_pairs(candidates, full, percent, rows_per_task), "similar")
    return SimilarSets(marked.drop("shingles"), nodes.select("node", "copies"), candidates, links)


def near_identical(df: DataFrame, key: str, text: str, percent: int = 80, size: int = 5, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """One row per row of ``df``: key, n_shingles, n_similar (other rows linked to it), group_id (smallest key reachable).

    ``key`` names a row. Copies are counted, never written out as pairs. A row without words links with nothing.
    """
    found = similarity_join(df, key, text, percent, size, rows_per_task)
    ends = found.links.select("a", "b").unionByName(found.links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    copies = found.nodes.select(F.col("node").alias("__b"), "copies")
    linked = lookup_join(ends, "b", copies, "__b", "inner").groupBy("a").agg(F.sum("copies").alias("n"))
    roots = components(found.links)
    nodes = found.nodes.join(linked.withColumnRenamed("a", "node"), "node", "left").join(roots, "node", "left")
    nodes = nodes.select("node", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_similar"), F.coalesce("root", "node").alias("root"))
    nodes = materialize(nodes.select(F.col("node").alias("__node"), "n_similar", "root"), "node-groups")
    rows = materialize(lookup_join(found.rows, "node", nodes, "__node", "left").drop("__node"), "group-rows")
    first = rows.where("root IS NOT NULL").groupBy(F.col("root").alias("__root")).agg(F.min("key").alias("group_id"))
    rows = lookup_join(rows, "root", first, "__root", "left")
    return rows.select(
        F.col("key").alias(key), F.col("n_shingles").cast("bigint").alias("n_shingles"),
        F.coalesce("n_similar", F.lit(0)).cast("bigint").alias("n_similar"), F.coalesce("group_id", "key").alias("group_id"),
    )


def drop_near_identical(df: DataFrame, key: str, text: str, percent: int = 80, size: int = 5) -> DataFrame:
    """``df`` without the rows that are near-identical to one of a smaller key: one row of every group stays."""
    groups = near_identical(df, key, text, percent, size)
    lost = groups.where(F.col("group_id") != F.col(key)).select(F.col(key).alias("__lost"))
    return lookup_join(df, key, lost, "__lost", "left_anti")
