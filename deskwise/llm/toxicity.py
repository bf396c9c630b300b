"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskwise.llm.blocks import blocks, fold, hash_unit
from deskwise.session import materialize

# Common English insults, the core of the lexicon; the rest is learned.
INSULTS = ("idiot", "stupid", "moron", "loser", "scum", "trash", "clown", "worthless", "pathetic", "disgusting", "dumb", "ugly", "hate", "jerk", "fool")
SECOND_PERSON = frozenset("you your yours yourself tu toi te vous votre du dich dir dein ihr euch usted ti tus".split())
STEM_SIZES = range(3, 9)
LEET = str.maketrans("0134579@$!", "oieastgasi")

FEATURES = [
    "insult_rate", "insults", "insult_kinds", "learned_rate", "learned_sum", "learned_kinds", "learned_top", "near_you",
    "you_rate", "capital_share", "exclaim_rate", "punctuation_rate", "hidden_rate", "hidden", "log_words",
]


TOKEN = re.compile(r"\S*[0134579@$!*._\-]\S*")  # what may be disguised: a look-alike, a star or a separator somewhere
SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_] ){3,}[^\W\d_](?![^\W_])")  # single letters in a row
EDGES = ".,;:?!\"'()[]-_"


def disguised(token: str, lexicon: Lexicon, insults: frozenset[str]) -> bool:
    """Is a token an insult or a learned word behind look-alikes at any place, separators between letters, or stars for letters?"""
    token = token.lstrip("([\"'").rstrip(EDGES)
    if not re.search(r"[0134579@$!*._\-]", token) or not re.search(r"[^\W\d_]", token):
        return False
    plain = token.translate(LEET)
    if "*" in plain and any(len(w) == len(plain) and all(a in ("*", b) for a, b in zip(plain, w, strict=True)) for w in insults):
        return True
    plain = re.sub(r"[*.\-_]", "", plain)
    return plain in insults or bool(lexicon.of([plain]))


def describe(text: str | None, lexicon: Lexicon, insults: frozenset[str], reach: int = 5) -> list[float]:
    """The features of one whole text; null and empty texts have zeros throughout."""
    text = text or ""
    lower = text.lower()
    words = re.findall(r"[^\W\d_]+", lower)
    n = max(1, len(words))
    found = [w for w in words if w in insults]
    learned = lexicon.of(words)
    near = 0
    you = sum(w in SECOND_PERSON for w in words)
    if found and you:
        at = [k for k, w in enumerate(words) if w in SECOND_PERSON]
        near = sum(any(words[j] in insults for j in range(max(0, k - reach), min(len(words), k + reach + 1))) for k in at)
    hidden = sum(disguised(token, lexicon, insults) for token in TOKEN.findall(lower))
    hidden += sum(any(w in spaced.replace(" ", "") for w in insults) for spaced in SPACED.findall(lower))
    letters = max(1, len(text) - text.count(" "))
    return [
        len(found) / n, math.log1p(len(found)), len(set(found)), len(learned) / n, math.log1p(sum(w for _, w in learned)),
        len({t for t, _ in learned}), max((w for _, w in learned), default=0.0), near / n, you / n,
        sum(map(str.isupper, text)) / letters if lower != text else 0.0, text.count("!") / n,
        sum(map(text.count, ".,;:?!")) / n, hidden / n, math.log1p(hidden), math.log1p(len(words)),
    ]


def stems(text: str | None) -> set[str]:
    """All beginnings of STEM_SIZES letters of the words of a text."""
    words = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
    return {w[:k] for w in words for k in STEM_SIZES if len(w) >= k}


def learn_lexicon(train: DataFrame, size: int = 400, least: int = 4, floor: float = 2.0) -> dict[str, float]:
    """Word beginnings far more frequent in toxic documents, with their log-odds; at most ``size``, shortest first.

    Insults come with endings, so words are counted by their beginnings, and of those that are each other's
    beginnings the shortest that is telling stays. Equal texts count once; the number of toxic documents
    is lowered by its standard error, so that a few like documents do not make a stem look telling.
    """
    texts = train.groupBy(F.xxhash64("text").alias("copy")).agg(F.max("label").alias("label"), F.first("text").alias("text"))
    toxic, total = texts.agg(F.sum("label"), F.count("*")).first()
    if not total or not toxic or toxic == total:
        return {}

    def counted(rows: DataFrame, only: frozenset[str] | None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in blocks(batch, "text", 1 << 20):
                    seen = Counter(t for text in part.column("text").to_pylist() for t in (stems(text) & only if only is not None else stems(text)))
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["stem", "n"])

        return rows.select("text").mapInArrow(run, "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n"))

    often = counted(texts.where("label = 1"), None).where(F.col("n") >= least)
    found = {r["stem"]: r["n"] for r in often.collect()}  # bounded by the sample of toxic documents
    known = frozenset(found)
    clean = {r["stem"]: r["n"] for r in counted(texts.where("label = 0"), known).collect()}
    odds = {
        t: math.log((n - math.sqrt(n) + 0.5) / (toxic + 1)) - math.log((clean.get(t, 0) + 0.5) / (total - toxic + 1)) for t, n in found.items()
    }
    kept: dict[str, float] = {}
    for stem in sorted((t for t, o in odds.items() if o >= floor), key=lambda t: (len(t), t)):
        if not any(stem[:k] in kept for k in STEM_SIZES if k < len(stem)):
            kept[stem] = odds[stem]
    best = sorted(kept, key=lambda t: (-odds[t] * math.log1p(found[t]), t))[:size]
    return {t: odds[t] for t in best}


class Lexicon:
    """Weights of word beginnings."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.heads = frozenset(t[: STEM_SIZES[0]] for t in weights)

    def of(self, words: list[str]) -> list[tuple[str, float]]:
        """(stem, weight) of the words that begin with a known stem."""
        first, out = STEM_SIZES[0], []
        for w in words:
            if w[:first] in self.heads:
                hit = next((w[:k] for k in STEM_SIZES if w[:k] in self.weights), None)
                if hit is not None:
                    out.append((hit, self.weights[hit]))
        return out


def with_features(docs: DataFrame, weights: dict[str, float], insults: tuple[str, ...] = INSULTS) -> DataFrame:
    """``docs`` (with a column ``text``) and a struct column ``features``; the weights are bounded by their size limit."""
    known, lexicon = frozenset(insults), Lexicon(weights)
    schema = T.StructType([T.StructField(f, T.DoubleType()) for f in FEATURES])

    @F.pandas_udf(schema)
    def features(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([describe(t, lexicon, known) for t in texts], columns=FEATURES, dtype="float64")

    return docs.withColumn("features", features("text"))


def with_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", mod: int = 3, left_out: int = 1,
    max_rows: int = 20_000, rounds: int = 15, depth: int = 3, seed: int = 3,
) -> DataFrame:
    """(doc_id, held_out, score) for every row of ``docs``.

    Labels (doc_id, toxic) of rows whose crc32(id) mod ``mod`` is ``left_out`` are never learned from. The lexicon, the
    trees and the calibration use at most about ``max_rows`` labelled rows, drawn by hash of the id; the
    calibration sees scores of trees that were fitted on the other half of the rows. Without rows of both classes every score is the smoothed share of
    label 1. Null and empty texts are scored by their features, all zero; repeated rows alike; an empty table
    gives no rows. Only the text enters a score.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("held_out", fold(F.col("doc_id"), mod) == left_out)
    known = labels.select("doc_id", F.col("toxic").cast("double").alias("label")).where("label is not null")
    known = known.where(fold(F.col("doc_id"), mod) != left_out).groupBy("doc_id").agg(F.max("label").alias("label"))
    share = min(1.0, max_rows / max(known.count(), 1))
    known = F.broadcast(known.where(hash_unit(F.col("doc_id"), seed) < share))  # bounded by max_rows
    train = rows.where(~F.col("held_out")).join(known, "doc_id").select("doc_id", "text", "label")
    train = materialize(train.dropDuplicates(["doc_id"]), "toxic-train")

    ones, total = train.agg(F.sum("label"), F.count("*")).first()
    if not total or ones in (0, total):
        return rows.select("doc_id", "held_out", F.lit(((ones or 0.0) + 1) / (total + 2)).alias("score"))
    lexicon = learn_lexicon(train)
    names = [F.col(f"features.{f}").alias(f) for f in FEATURES]
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="vector")
    fitted = with_features(train, lexicon).select("label", *names, hash_unit(F.col("doc_id"), seed + 1).alias("part"))
    fitted = materialize(assembler.transform(fitted).select("label", "vector", "part"), "toxic-features")
    boost = GBTClassifier(featuresCol="vector", maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=seed)
    raw = vector_to_array("probability")[1]
    trees = boost.fit(fitted)
    one, two = fitted.where("part < 0.5"), fitted.where("part >= 0.5")
    both = all(part.agg(F.min("label") != F.max("label")).first()[0] for part in (one, two))
    unseen = boost.fit(two).transform(one).unionByName(boost.fit(one).transform(two)) if both else trees.transform(fitted)
    calibration = materialize(unseen.select("label", raw.alias("raw")), "toxic-calibration")
    steps = IsotonicRegression(featuresCol="raw").fit(calibration)

    scored = assembler.transform(with_features(rows, lexicon).select("doc_id", "held_out", *names))
    scored = steps.transform(trees.transform(scored).select("doc_id", "held_out", raw.alias("raw")))
    # The calibrated score is a step function; the raw score orders what shares a step.
    score = 0.98 * F.col("prediction") + 0.02 * F.col("raw")
    return scored.select("doc_id", "held_out", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """:func:`with_scores` with ``predicted``: 1 if the score reaches the threshold."""
    scored = with_scores(docs, labels, **options)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
