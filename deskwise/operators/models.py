"""Intent discovery, intent classification and language detection with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import HashingTF, IndexToString, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskwise.functions import vectors as vx
from deskwise.functions.columns import compute_once
from deskwise.operators.features import char_ngrams


def to_vector(df: DataFrame, column: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(column).cast("array<double>")))


# --- clusters ------------------------------------------------------------------------------


def kmeans(
    df: DataFrame, features: str = "features", k: int = 12, restarts: int = 10, seed: int = 42
) -> KMeansModel:
    """Best of ``restarts`` runs by training cost; the input is cached across the runs."""
    df = df.select(features).persist()
    try:
        runs = [
            KMeans(k=k, seed=seed + i, featuresCol=features, predictionCol="cluster").fit(df)
            for i in range(restarts)
        ]
    finally:
        df.unpersist()
    return min(runs, key=lambda m: m.summary.trainingCost)


# --- classifier ----------------------------------------------------------------------------


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight n / (k * n_c) per class."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("support"))
    totals = counts.agg(F.struct(F.sum("support").alias("n"), F.count(F.lit(1)).alias("k")))
    weight = F.col("__t.n") / (F.col("__t.k") * F.col("support"))
    return counts.withColumn("__t", totals.scalar()).select(label, "support", weight.alias("weight"))


def fit_classifier(
    df: DataFrame,
    features: str,
    label: str,
    c: float = 1.0,
    max_iter: int = 2000,
    tol: float = 1e-8,
    max_classes: int = 10_000,
) -> PipelineModel:
    """Multinomial logistic regression with balanced classes and L2 strength ``1/C``.

    Spark divides the loss by the weight sum, which equals n for balanced weights, hence
    ``regParam = 1 / (C * n)``. The classes are those of the training data, alphabetically.
    """
    classes = class_weights(df, label).orderBy(label).limit(max_classes + 1).collect()
    if len(classes) > max_classes:
        raise ValueError(f"more than {max_classes} classes in {label}")
    n = sum(row["support"] for row in classes)
    lookup = df.sparkSession.createDataFrame(
        [(row[label], float(i), row["weight"]) for i, row in enumerate(classes)],
        f"`{label}` string, __y double, __w double",
    )
    train = df.join(F.broadcast(lookup), label).select("__y", "__w", features)
    regression = LogisticRegression(
        featuresCol=features, labelCol="__y", weightCol="__w", family="multinomial",
        regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False,
        maxIter=max_iter, tol=tol, predictionCol="__pred", probabilityCol="__prob",
        rawPredictionCol="__raw",
    )
    names = IndexToString(
        inputCol="__pred", outputCol="predicted_intent", labels=[row[label] for row in classes]
    )
    return PipelineModel(stages=[regression.fit(train), names])


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds ``predicted_intent``, ``confidence`` (highest probability) and ``probability``."""
    scored = model.transform(df).withColumn("probability", vector_to_array("__prob"))
    return scored.withColumn("confidence", F.array_max("probability")).drop("__raw", "__prob", "__pred")


def label_tiers(df: DataFrame, high: float, low: float, confidence: str = "confidence") -> DataFrame:
    """HIGH / MEDIUM / LOW by confidence."""
    c = F.col(confidence)
    return df.withColumn("tier", F.when(c >= high, "HIGH").when(c >= low, "MEDIUM").otherwise("LOW"))


# --- centroid scorer: a linear classifier that plain SQL can reproduce ----------------------


def centroids(df: DataFrame, label: str, vector: str = "embedding") -> DataFrame:
    """Vector sum and size per label; one row per label, combined map-side."""
    total = Summarizer.sum(array_to_vector(F.col(vector).cast("array<double>")))
    return df.groupBy(F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("n"), vector_to_array(total).alias("total")
    )


def centroid_scores(
    df: DataFrame,
    classes: DataFrame,
    vector: str = "embedding",
    own_label: str | None = None,
    decimals: int = 6,
) -> DataFrame:
    """Adds ``labels`` and ``scores``: the dot product with every class centroid.

    With ``own_label`` a training row is left out of its own class, so that it can be scored
    without leakage. The classes (one row per label) enter as a scalar subquery: no join, no shuffle.
    """
    packed = classes.agg(F.array_sort(F.collect_list(F.struct("label", "n", "total"))).alias("c"))
    v = F.col(vector)

    def score(c: Column) -> Column:
        raw = vx.dot(v, c["total"])
        if own_label is None:
            return raw / c["n"]
        own = c["label"] == F.col(own_label)
        rest = F.try_divide(raw - vx.dot(v, v), (c["n"] - 1).cast("double"))
        return F.when(own, F.coalesce(rest, F.lit(0.0))).otherwise(raw / c["n"])

    return (
        df.withColumn("__c", packed.scalar())
        .withColumn("labels", F.transform("__c", lambda c: c["label"]))
        .withColumn("scores", F.transform("__c", lambda c: F.round(score(c), decimals)))
        .drop("__c")
    )


def centroid_predict(scored: DataFrame, sharpness: float = 10.0) -> DataFrame:
    """``predicted_intent`` and ``confidence`` from softmax(sharpness * score); ties: first label."""
    p = vx.softmax(F.transform("scores", lambda s: s * sharpness))
    return (
        scored.withColumn("__at", vx.argmax("scores"))
        .withColumn("predicted_intent", F.element_at("labels", F.col("__at") + 1))
        .withColumn("confidence", F.round(F.array_max(p), 6))
        .drop("__at", "scores", "labels")
    )


# --- language ------------------------------------------------------------------------------


def fit_language(df: DataFrame, text: str, lang: str, dims: int = 1 << 14) -> PipelineModel:
    """Naive Bayes over hashed character trigrams of the whole text."""
    # The labels are read before the texts are touched; the texts are then passed over once.
    indexer = StringIndexer(inputCol=lang, outputCol="__y", stringOrderType="alphabetAsc").fit(df.select(lang))
    hashing = HashingTF(inputCol="grams", outputCol="__f", numFeatures=dims)
    bayes = NaiveBayes(
        featuresCol="__f", labelCol="__y", probabilityCol="__prob", predictionCol="__pred", rawPredictionCol="__raw"
    )
    model = bayes.fit(hashing.transform(char_ngrams(indexer.transform(df.select(text, lang)), text)))
    names = IndexToString(inputCol="__pred", outputCol="detected_lang", labels=indexer.labels)
    return PipelineModel(stages=[hashing, model, names])


def language_probability(
    model: PipelineModel, df: DataFrame, text: str, lang: str = "en", out: str = "english_probability"
) -> DataFrame:
    """Probability of ``lang``; a text too short for any n-gram scores 0."""
    labels: Sequence[str] = model.stages[-1].getLabels()
    at = list(labels).index(lang)
    scored = model.transform(char_ngrams(df, text))
    value = F.when(F.size("grams") > 0, vector_to_array("__prob")[at]).otherwise(F.lit(0.0))
    return compute_once(scored, {out: value}).drop("grams", "__f", "__raw", "__prob", "__pred")
