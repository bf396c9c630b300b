"""Small helpers that decide how often an expression is evaluated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once per row, also inside nested lambdas."""
    return F.transform(F.array(value), use)[0]


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``withColumns`` for costly expressions that later filters refer to.

    A filter on a plain projection is pushed below it, and the expression is then evaluated once
    per predicate and once more for the output. Predicates do not move through a generator,
    so each expression here runs once per row.
    """
    rest = [c for c in df.columns if c not in columns]
    packed = F.array(F.struct(*[e.alias(c) for c, e in columns.items()]))
    out = df.select(*rest, F.inline(packed))
    return out.select(*df.columns, *[c for c in columns if c not in df.columns])
