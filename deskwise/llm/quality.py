"""Quality classifier: a sparse ensemble of tree-path rules over text statistics, as one column expression."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskwise.llm.blocks import fold, hash_unit
from deskwise.session import materialize

STATISTICS = [
    "log_words", "word_length", "capital_share", "digit_share", "symbol_share", "mark_rate", "bar_rate", "stop_rate",
    "exclaim_rate", "line_rate", "other_share", "distinct_share", "same_next_share", "repeat_share", "dup_line_share",
    "top_word_share",
]

_KIND = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:?", b"!", b"|", b"#*$%&<>=@^~{}[]_\\/+"), 1):
    _KIND[list(_chars)] = _k
_KIND[128:] = 10


def describe(text: str | None) -> list[float]:
    """The statistics of one whole text; null and empty texts have zeros throughout."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, kinds = len(words), np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=11).tolist()
    _, upper, lower, digits, blanks, breaks, stops, exclaims, bars, marks, other = kinds
    solid, letters = max(1, len(raw) - blanks - breaks), max(1, upper + lower)
    grams = set(zip(words, words[1:], words[2:], words[3:], strict=False))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        math.log1p(n), solid / n, upper / letters, digits / solid, (marks + bars) / solid, marks / n, bars / n, stops / n,
        exclaims / n, breaks / n, other / solid, len(set(words)) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        1 - len(grams) / (n - 3) if n > 3 else 0.0,
        1 - len(set(lines)) / len(lines),
        max(Counter(words).values()) / n,
    ]


@F.pandas_udf(T.StructType([T.StructField(name, T.DoubleType()) for name in STATISTICS]))
def statistics(texts: pd.Series) -> pd.DataFrame:
    """The statistics of each text as a struct column."""
    return pd.DataFrame([describe(t) for t in texts], columns=STATISTICS)


@dataclass(frozen=True)
class RuleEnsemble:
    """Weighted conjunctions of ``statistic <= bound`` (or ``>``), and what their sum starts from."""

    intercept: float
    rules: list[tuple[float, tuple[tuple[str, bool, float], ...]]]

    def score(self, of: str = "statistics") -> Column:
        """Probability of label 1 as a column expression over the statistics."""
        total = F.lit(self.intercept)
        for weight, conditions in self.rules:
            holds = F.lit(True)
            for name, above, bound in conditions:
                value = F.col(f"{of}.{name}")
                holds = holds & (value > bound if above else value <= bound)
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def tree_paths(debug: str, names: list[str]) -> set[tuple[tuple[str, bool, float], ...]]:
    """Every path from a root to a node below it, as its conditions; one bound per statistic and side."""
    paths, stack = set(), []
    for line in debug.splitlines():
        found = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not found:
            continue
        depth, name, above, bound = len(found[1]), names[int(found[2])], found[3] == ">", float(found[4])
        stack = [s for s in stack if s[0] < depth] + [(depth, (name, above, bound))]
        tight: dict[tuple[str, bool], float] = {}
        for _, (n, a, b) in stack:
            tight[n, a] = max(tight.get((n, a), b), b) if a else min(tight.get((n, a), b), b)
        paths.add(tuple(sorted((n, a, b) for (n, a), b in tight.items())))
    return paths


def fit(rows: DataFrame, trees: int = 12, depth: int = 3, penalty: float = 0.002, seed: int = 5) -> RuleEnsemble:
    """Fit on rows (label, statistics).

    Forest trees propose rules, the lasso keeps the few that matter. With no rows, or one class only, the
    ensemble is a constant (that class's share, smoothed).
    """
    flat = rows.select(F.col("label").cast("double").alias("label"), *(F.col(f"statistics.{s}").alias(s) for s in STATISTICS))
    flat = materialize(flat, "quality-train")
    ones, total = flat.agg(F.sum("label"), F.count("*")).first()
    if not total or ones in (0, total):
        share = ((ones or 0) + 1) / (total + 2)
        return RuleEnsemble(math.log(share / (1 - share)), [])
    ready = VectorAssembler(inputCols=STATISTICS, outputCol="features").transform(flat)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="0.5", minInstancesPerNode=5).fit(ready)
    rules = sorted(set().union(*(tree_paths(t.toDebugString, STATISTICS) for t in forest.trees)))
    rules = [r for r in rules if r]
    columns = []
    for k, conditions in enumerate(rules):
        holds = F.lit(True)
        for name, above, bound in conditions:
            holds = holds & (F.col(name) > bound if above else F.col(name) <= bound)
        columns.append(holds.cast("double").alias(f"r{k}"))
    if not rules:
        share = ones / total
        return RuleEnsemble(math.log(share / (1 - share)), [])
    held = VectorAssembler(inputCols=[f"r{k}" for k in range(len(rules))], outputCol="features").transform(flat.select("label", *columns))
    held = held.select("label", "features").persist()
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False).fit(held)
    kept = [(float(w), rules[k]) for k, w in enumerate(lasso.coefficients.toArray()) if abs(w) > 1e-6]
    held.unpersist()
    return RuleEnsemble(float(lasso.intercept), kept)


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", mod: int = 5, left_out: int = 0, max_rows: int = 50_000, **options
) -> RuleEnsemble:
    """Fit on the labelled documents, at most about ``max_rows`` of them, drawn by hash of the id.

    Labels (doc_id, quality) of rows whose crc32(id) mod ``mod`` is ``left_out`` are never learned from.
    """
    known = labels.select("doc_id", F.col("quality").alias("label")).where("label is not null")
    known = known.where(fold(F.col("doc_id"), mod) != left_out).groupBy("doc_id").agg(F.max("label").alias("label"))
    share = min(1.0, max_rows / max(known.count(), 1))
    known = F.broadcast(known.where(hash_unit(F.col("doc_id"), 5) < share))  # bounded by max_rows
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(known, "doc_id")
    return fit(rows.dropDuplicates(["doc_id"]).select("label", statistics("text").alias("statistics")), **options)


def with_scores(docs: DataFrame, model: RuleEnsemble, id_col: str = "doc_id", text_col: str = "text", mod: int = 5, left_out: int = 0) -> DataFrame:
    """(doc_id, held_out, score) for every row of ``docs``.

    Null and empty texts are scored by their statistics, all zero; a document without a label is scored like
    any other; repeated rows are scored alike; an empty table gives no rows. Only the text enters a score.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), statistics(F.col(text_col)).alias("statistics"))
    return rows.select("doc_id", (fold(F.col("doc_id"), mod) == left_out).alias("held_out"), model.score().alias("score"))


def keep_good(docs: DataFrame, model: RuleEnsemble, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with their own columns."""
    scored = docs.withColumn("_statistics", statistics(F.col(text_col)))
    return scored.where(model.score("_statistics") >= threshold).drop("_statistics")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Train and score: doc_id, held_out, score, predicted (1 if the score reaches the threshold)."""
    scored = with_scores(docs, train(docs, labels))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
