"""Vector arithmetic on array columns, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from deskwise.functions.columns import col, let


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column | str) -> Column:
    squares = F.aggregate(col(v), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return F.sqrt(squares)


def l2_normalize(v: Column | str) -> Column:
    """Unit-length copy as doubles; the zero vector stays as it is."""
    scale = F.coalesce(F.nullif(norm(v), F.lit(0.0)), F.lit(1.0))
    return let(scale, lambda n: F.transform(col(v), lambda x: x.cast("double") / n))


def argmax(probabilities: Column | str) -> Column:
    """0-based index of the first maximum."""
    p = col(probabilities)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def softmax(scores: Column | str) -> Column:
    s = col(scores)
    powers = let(F.array_max(s), lambda top: F.transform(s, lambda x: F.exp(x - top)))
    total = F.aggregate(powers, F.lit(0.0), lambda acc, x: acc + x)
    return let(total, lambda t: F.transform(powers, lambda x: x / t))
