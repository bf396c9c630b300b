"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE = "[\\x20\\x09-\\x0D]"


def text_or_empty(col: str | Column) -> Column:
    """The text, null as the empty string."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; the built-in ``lower`` does that for pure ASCII texts at a fraction of the cost."""
    ascii_only = F.octet_length(col) == F.char_length(col)
    return F.when(ascii_only, F.lower(col)).otherwise(F.translate(col, UPPER, UPPER.lower()))


def fold(col: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % mod


def hash_unit(col: Column, seed: int) -> Column:
    """A repeatable number in [0, 1) from a value, for bounded samples and splits."""
    return F.shiftrightunsigned(F.xxhash64(col, F.lit(seed)), 11) / float(1 << 53)


def join_counted(rows: DataFrame, lookup: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """``rows`` with the columns of ``lookup``: one row per key, whose column ``n`` counts the rows of that key.

    Keys that hold more than a ``share``-th of the rows are fewer than ``share``. They are broadcast and their rows
    stay where they are; only the other keys are shuffled, so no task gathers a hot key. Rows without a
    key in the lookup go, as in any inner join.
    """
    total = lookup.agg(F.sum("n")).first()[0] or 0
    hot = lookup.where(F.col("n") * share > total).drop("n")
    rest = lookup.where(F.col("n") * share <= total).drop("n")
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key)
    return rows.join(F.broadcast(hot), key).unionByName(others)


def blocks(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with at most ``limit`` bytes of text each (or one longer row)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``start .. start + length - 1`` of every piece, one after another."""
    if not len(starts):
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))
