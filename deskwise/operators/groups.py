"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskwise.operators.joins import lookup_join
from deskwise.session import materialize


def _follow(rows: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    """``rows`` with ``column`` replaced by its root in ``parents`` (node, root), where it has one."""
    lookup = parents.select(F.col("node").alias("__node"), F.col("root").alias("__root"))
    joined = lookup_join(rows, column, lookup, "__node", "left")
    return joined.withColumn(column, F.coalesce("__root", column)).select(*rows.columns)


def _flat(parents: DataFrame) -> DataFrame:
    """Every node directly below its root. Chains halve in each round; parents are smaller than their nodes."""
    while True:
        jumped = materialize(_follow(parents.withColumn("before", F.col("root")), "root", parents), "parents")
        parents = jumped.drop("before")
        if jumped.where("root <> before").isEmpty():
            return parents


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): the smallest node that links reach.

    Each round ties every node to its smallest neighbour and replaces groups by their smallest node; what
    is left are links between such groups. Rounds grow with the logarithm of a component's size, and all
    are stored tables, so that nothing is computed twice. Links may repeat, point both ways or to themselves.
    """
    links = links.select("a", "b")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now, labels = materialize(both.distinct(), "links"), None
    while True:
        least = now.groupBy("a").agg(F.min("b").alias("b"))
        parents = _flat(materialize(least.select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "parents"))
        labels = parents if labels is None else materialize(_follow(labels, "root", parents), "labels")
        contracted = _follow(_follow(now, "a", parents), "b", parents)
        now = materialize(contracted.where("a <> b").distinct(), "links")
        if now.isEmpty():
            return labels
