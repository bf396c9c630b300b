"""Deterministic sampling, splits, shuffles and bounded reads."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskwise.functions.columns import col
from deskwise.session import broadcast_if_small, materialize


def sample_key(seed: int, *ids: Column | str) -> Column:
    """Uniform, repeatable sort key: md5 of seed and id, the same on every engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(i).cast("string") for i in ids]))


def _buckets(keyed: DataFrame, by: list[str]) -> DataFrame:
    """Rows per (group, bucket) with the rows before it in the group and the group's size.

    At most ``16**digits`` rows per group, so the windows over them are bounded.
    """
    counts = keyed.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__n"))
    # The constant makes the overall ranking an explicit, bounded single group of bucket counts.
    counts = counts.withColumn("__all", F.lit(0))
    within = Window.partitionBy("__all", *by)
    running = within.orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = counts.withColumn("__off", F.sum("__n").over(running) - F.col("__n"))
    return offsets.withColumn("__size", F.sum("__n").over(within)).drop("__all")


def _keyed(df: DataFrame, key: Column, digits: int) -> DataFrame:
    return df.withColumn("__key", key).withColumn("__b", F.substring("__key", 1, digits))


def _join_on(left: DataFrame, right: DataFrame, columns: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet, keeping the left key columns."""
    renamed = right.withColumnsRenamed({c: f"__r_{c}" for c in columns})
    on = [left[c].eqNullSafe(renamed[f"__r_{c}"]) for c in columns]
    return left.join(renamed, on, how).drop(*[f"__r_{c}" for c in columns])


def hash_rank(
    df: DataFrame, key: Column, groups: Sequence[str] = (), name: str = "rank", digits: int = 3
) -> DataFrame:
    """1-based rank by a hex hash key, overall or per group, without a one-task sort.

    The first ``digits`` hex characters cut every group into ``16**digits`` even buckets. Bucket
    counts are summed into offsets, rows are only sorted inside their bucket: rank = offset +
    position. A group with a third of the rows is therefore sorted by thousands of tasks.
    Use 4 digits beyond some 10**11 rows per group.
    """
    by = list(groups)
    keyed = _keyed(df, key, digits)
    offsets = broadcast_if_small(_buckets(keyed, by).select(*by, "__b", "__off"))
    joined = _join_on(keyed, offsets, [*by, "__b"])
    local = F.row_number().over(Window.partitionBy(*by, "__b").orderBy("__key"))
    return joined.withColumn(name, F.col("__off") + local).drop("__key", "__b", "__off")


def shuffled(df: DataFrame, seed: int, *ids: str, name: str = "shuffle_pos") -> DataFrame:
    return hash_rank(df, sample_key(seed, *ids), name=name)


def _cut_keys(
    df: DataFrame, groups: list[str], key: Column, want: Column, ids: Sequence[str], digits: int
) -> DataFrame:
    """The hash key of the ``want``-th row (a function of ``__size``) of every group.

    Works on (group, key) alone: bucket counts show which bucket the cut falls into, and only the
    rows of that bucket are sorted. Groups whose cut is 0 are missing from the result.
    """
    keyed = _keyed(df.select(*dict.fromkeys([*groups, *ids])), key, digits).select(*groups, "__b", "__key")
    border = _buckets(keyed, groups).where(
        (F.col("__off") < want) & (F.col("__off") + F.col("__n") >= want)
    ).select(*groups, "__b", (want - F.col("__off")).alias("__need"))
    local = F.row_number().over(Window.partitionBy(*groups, "__b").orderBy("__key"))
    return (
        _join_on(keyed, broadcast_if_small(border), [*groups, "__b"])
        .withColumn("__rn", local)
        .where(F.col("__rn") == F.col("__need"))
        .select(*groups, F.col("__key").alias("__cut"))
    )


def stratified_sample(
    df: DataFrame, strata: Sequence[str], n: int, seed: int, *ids: str, digits: int = 3
) -> DataFrame:
    """Exactly ``min(n, size)`` rows of every stratum, found and filtered without moving rows."""
    key, groups = sample_key(seed, *ids), list(strata)
    cuts = _cut_keys(df, groups, key, F.least(F.lit(n), F.col("__size")), ids, digits)
    picked = _join_on(df, broadcast_if_small(cuts), groups)
    return picked.where(key <= F.col("__cut")).drop("__cut")


def uniform_sample(df: DataFrame, n: int, seed: int, *ids: str) -> DataFrame:
    """``n`` rows, or all if there are fewer.

    The cut-off is found on the key alone, so that only some ``n`` whole rows are sorted.
    """
    key = sample_key(seed, *ids)
    number = F.conv(F.substring(key, 1, 15), 16, 10).cast("bigint")
    cut = cutoff(df.select(number.alias("__pos")), "__pos", n)
    near = df if cut is None else df.where(number <= cut)
    return near.orderBy(key).limit(n)


def stratified_split(
    df: DataFrame,
    label: str,
    test_share: float,
    seed: int,
    *ids: str,
    name: str = "split",
    digits: int = 3,
) -> DataFrame:
    """Tag every row ``test`` or ``train``; each class gives ``round(share * size)`` test rows.

    Rows are not ranked and not shuffled: every row is compared with the cut key of its class.
    """
    key = sample_key(seed, *ids)
    want = F.round(F.lit(test_share) * F.col("__size"))
    cuts = _cut_keys(df, [label], key, want, ids, digits)
    tagged = _join_on(df, broadcast_if_small(cuts), [label], "left")
    tag = F.when(key <= F.col("__cut"), "test").otherwise("train")
    return tagged.withColumn(name, tag).drop("__cut")


def largest_remainders(sizes: DataFrame, label: str, share: float) -> DataFrame:
    """(label, __want) from (label, __size): the rounded share of all rows, dealt to the classes by largest remainder.

    Whole quotas first; what is left goes to the largest remainders, ties to the first label. All in integers.
    The windows go over one row per class.
    """
    every = Window.partitionBy(F.lit(0))
    rows = sizes.withColumn("__all", F.sum("__size").over(every))
    rows = rows.withColumn("__total", F.round(F.lit(share) * F.col("__all")).cast("bigint"))
    rows = rows.withColumn("__base", F.expr("(__total * __size) div __all")).withColumn("__rest", F.expr("(__total * __size) % __all"))
    left = F.col("__total") - F.sum("__base").over(every)
    place = F.row_number().over(every.orderBy(F.desc("__rest"), F.asc_nulls_last(label)))
    return rows.select(label, (F.col("__base") + (place <= left).cast("int")).alias("__want"))


def split_exact_total(
    df: DataFrame, label: str, test_share: float, seed: int, *ids: str, name: str = "split", digits: int = 3
) -> DataFrame:
    """Tag every row ``test`` or ``train`` so that exactly ``round(share * rows)`` are test rows, shared out to the classes.

    As :func:`stratified_split`, rows are compared with their class's cut key where they lie. Ids are unique.
    """
    key = sample_key(seed, *ids)
    keyed = _keyed(df.select(*dict.fromkeys([label, *ids])), key, digits).select(label, "__b", "__key")
    buckets = materialize(_buckets(keyed, [label]), "split-buckets")
    want = largest_remainders(buckets.select(label, "__size").distinct(), label, test_share)
    border = _join_on(buckets, want, [label]).where("__off < __want AND __off + __n >= __want")
    border = border.select(label, "__b", (F.col("__want") - F.col("__off")).alias("__need"))
    local = F.row_number().over(Window.partitionBy(label, "__b").orderBy("__key"))
    near = _join_on(keyed, broadcast_if_small(border), [label, "__b"]).withColumn("__rn", local)
    cuts = near.where(F.col("__rn") == F.col("__need")).select(label, F.col("__key").alias("__cut"))
    tagged = _join_on(df, broadcast_if_small(cuts), [label], "left")
    return tagged.withColumn(name, F.when(key <= F.col("__cut"), "test").otherwise("train")).drop("__cut")


PARTS = 4096  # equal parts of the range of positions, counted per round of a search
FEW = 10_000  # positions one task may sort


def cutoff(df: DataFrame, pos: str, n: int):
    """The ``n``-th lowest value of the unique integer ``pos``; None if there are at most n rows.

    ``orderBy(pos).limit(n)`` alone moves up to ``n`` rows per partition into one task. Here the range of
    positions is cut into equal parts, their rows are counted inside the map tasks, and the search goes on in
    the part that holds the ``n``-th, until few are left. It reads ``pos`` alone.
    """
    at = df.select(F.col(pos).cast("bigint").alias("p")).where("p IS NOT NULL")
    left, low, high = at.agg(F.count("p"), F.min("p"), F.max("p")).first()
    if left <= n:
        return None
    if n <= 0:
        return low - 1
    while left > FEW and low < high:
        width = (high - low) // PARTS + 1
        near = at.where(F.col("p").between(low, high))
        counted = near.groupBy(F.expr(f"(p - {low}L) div {width}L").alias("part")).count().collect()
        for part, rows in sorted(counted):
            left = rows
            if n <= rows:
                break
            n -= rows
        low, high = low + part * width, min(high, low + (part + 1) * width - 1)
    near = at.where(F.col("p").between(low, high))
    return near.orderBy("p").limit(min(n, FEW)).agg(F.max("p")).first()[0]


def first_n(df: DataFrame, pos: str, n: int) -> DataFrame:
    """The ``n`` rows with the lowest ``pos``, as a filter that leaves the rows where they lie."""
    cut = cutoff(df, pos, n)
    return df if cut is None else df.where(F.col(pos) <= cut)


def first_n_kept(
    df: DataFrame, pos: str, n: int, keep: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """``first_n(keep(df))`` without running ``keep`` over the whole table.

    ``keep`` (row filters, cleaning, anti-joins) sees the first ``2n`` rows, then the following ones up to four
    times as many, until ``n`` rows are left or the table is used up. Finding those rows reads ``pos`` alone,
    and every row goes through ``keep`` once: what is left of a stretch is stored.
    """
    m, last, stretches = 2 * n, None, []
    while True:
        cut = cutoff(df.select(pos), pos, m)
        fresh = df if last is None else df.where(F.col(pos) > last)
        stretches.append(materialize(keep(fresh if cut is None else fresh.where(F.col(pos) <= cut)), "first-rows"))
        kept = reduce(DataFrame.unionByName, stretches)
        if cut is None or kept.count() >= n:
            return first_n(kept, pos, n)
        m, last = 4 * m, cut
