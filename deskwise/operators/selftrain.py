"""Pseudo-labels by self-training: each round, the most confident rows of every class join the training rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskwise.operators import curation as cu
from deskwise.operators import models
from deskwise.operators.joins import lookup_join


@dataclass(frozen=True)
class SelfTraining:
    """Rounds below ``path``: ``accepted/round=<n>`` (id, label, confidence) and, once that is written in full, one row in
    ``done/round=<n>``. A run that broke off goes on behind the last round that is done.

    A round accepts at most ``quota`` rows of a class, with a confidence of ``least`` or more (ties: the lowest id). It
    ends when a round accepts nothing, a fixed point, or after ``max_rounds``.
    """

    path: str
    quota: int = 50
    least: float = 0.5
    max_rounds: int = 10

    def done(self, spark) -> dict[int, int]:
        """Rounds that are done and how many rows each accepted."""
        try:
            rows = spark.read.schema("n bigint, round int").parquet(f"{self.path}/done").collect()
        except AnalysisException:
            return {}
        return {r["round"]: r["n"] for r in rows}

    def accepted(self, schema: DataFrame, rounds: int) -> DataFrame:
        """(id, label, confidence, round) of the first ``rounds`` rounds."""
        spark = schema.sparkSession
        if not rounds:
            return schema.select("id", "label", F.lit(0.0).alias("confidence"), F.lit(0).alias("round")).where("false")
        parts = [spark.read.parquet(f"{self.path}/accepted/round={r}").withColumn("round", F.lit(r)) for r in range(1, rounds + 1)]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def run(self, seeds: DataFrame, pool: DataFrame) -> DataFrame:
        """``seeds``: id, label, vector; ``pool``: id, vector, ids of its own. Returns what all rounds accepted.

        The classifier is the centroid scorer, refitted in every round on the seeds and all accepted rows.
        """
        spark = seeds.sparkSession
        done = self.done(spark)
        while len(done) < self.max_rounds and (not done or done[max(done)]):
            r = len(done) + 1
            known = self.accepted(seeds, r - 1)
            marks = known.select(F.col("id").alias("__id"), F.col("label").alias("__label"))
            taught = lookup_join(pool, "id", marks, "__id", "inner").select("id", F.col("__label").alias("label"), "vector")
            classes = models.centroids(seeds.select("id", "label", "vector").unionByName(taught), "label", "vector")
            left = lookup_join(pool.select("id", "vector"), "id", marks.select("__id"), "__id", "left_anti")
            scored = models.centroid_predict(models.centroid_scores(left, classes, "vector"))
            scored = scored.select("id", F.col("predicted_intent").alias("label"), "confidence").where(F.col("confidence") >= self.least)
            best = cu.first_rows(scored, ["label"], [F.desc("confidence"), "id"], self.quota)
            target = f"{self.path}/accepted/round={r}"
            best.write.mode("overwrite").parquet(target)
            n = spark.read.schema(best.schema).parquet(target).count()
            spark.createDataFrame([(n,)], "n bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/done/round={r}")
            done[r] = n
        return self.accepted(seeds, len(done))
