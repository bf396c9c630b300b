import math
from collections import Counter

import numpy as np
import pytest
from frames import column, rows
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from deskwise.functions import vectors as vx
from deskwise.operators import features as ft
from deskwise.operators import models as ml
from deskwise.plans import corpus

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def labelled(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    df = df.where("label < 4 or vec_id < 100").withColumn("intent", F.concat(F.lit("i"), F.col("label")))
    return ml.to_vector(df, "embedding").select("vec_id", "embedding", "intent", "features")


def test_classifier_minimises_the_balanced_objective(labelled):
    """Gradient of sum(w * logloss) + |W|^2 / 2 (C = 1, free intercept) vanishes at the solution."""
    model = ml.fit_classifier(labelled, "features", "intent")
    got = ml.predict(model, labelled).orderBy("vec_id").collect()
    classes = model.stages[-1].getLabels()
    assert classes == sorted(classes)
    x = np.array([r["embedding"] for r in got], dtype=np.float64)
    p = np.array([r["probability"] for r in got])
    y = np.array([[r["intent"] == c for c in classes] for r in got], dtype=float)
    assert p.sum(axis=1) == pytest.approx(np.ones(len(p)))
    assert all(r["confidence"] == max(r["probability"]) for r in got)
    assert all(classes[int(np.argmax(r["probability"]))] == r["predicted_intent"] for r in got)
    w = len(y) / (len(classes) * (y @ y.sum(axis=0)))
    gradient = ((p - y) * w[:, None]).T @ x + model.stages[0].coefficientMatrix.toArray()
    assert np.abs(gradient).max() < 1e-3
    assert np.abs(((p - y) * w[:, None]).sum(axis=0)).max() < 1e-3


def test_class_weights(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 2 + [(None,)], "l string")
    assert rows(ml.class_weights(df, "l"), "l") == [("a", 6, 8 / 12), ("b", 2, 2.0)]


def test_centroids_leave_their_own_row_out(spark):
    df = spark.createDataFrame(
        [(1, "a", [1.0, 0.0]), (2, "a", [0.0, 1.0]), (3, "b", [1.0, 0.0])], "id int, l string, v array<float>"
    )
    scored = ml.centroid_scores(df, ml.centroids(df, "l", "v"), "v", own_label="l")
    got = {r["id"]: r["scores"] for r in scored.collect()}
    assert got == {1: [0.0, 1.0], 2: [0.0, 0.0], 3: [0.5, 0.0]}
    plain = ml.centroid_scores(df, ml.centroids(df, "l", "v"), "v")
    assert {r["id"]: r["scores"] for r in plain.collect()}[1] == [0.5, 1.0]
    guess = {r["id"]: (r["predicted_intent"], r["confidence"]) for r in ml.centroid_predict(plain).collect()}
    assert guess[1] == ("b", round(1 / (1 + math.exp(-5)), 6)) and guess[2][0] == "a"


def test_vocabulary_and_tfidf_in_both_forms(spark, tmp_path):
    texts = ["late parcel late", "late parcel came", "refund parcel refund refund", "", "the of"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, t string")
    terms = ft.with_terms(df, "t")
    counts = Counter()
    docs = Counter()
    for r in terms.collect():
        counts.update(r["terms"])
        docs.update(set(r["terms"]))
    voc = ft.vocabulary(terms, min_df=1, max_features=4).collect()
    best = sorted(counts, key=lambda t: (-counts[t], t))[:4]
    assert [r["term"] for r in voc] == best
    assert all(r["df"] == docs[r["term"]] and r["cf"] == counts[r["term"]] for r in voc)

    long = {(r["doc_id"], r["term"]): r["tfidf"] for r in ft.tfidf_long(terms, "doc_id", min_df=2).collect()}
    raw = {t: (2 if t == "late" else 1) * (math.log(6 / (1 + docs[t])) + 1) for t in ("late", "parcel", "late parcel")}
    norm = math.sqrt(sum(v * v for v in raw.values()))
    for t, v in raw.items():
        if t in {k[1] for k in long}:
            assert long[(0, t)] == pytest.approx(v / norm)
    wide = ft.fit_tfidf(terms, min_df=2).transform(terms).select("doc_id", vector_to_array("features").alias("v"))
    sums = {r["doc_id"]: sum(r["v"]) for r in wide.collect()}
    for doc in range(5):
        assert sums[doc] == pytest.approx(sum(v for (d, _), v in long.items() if d == doc))
    damped = ft.fit_tfidf(terms, min_df=2, sublinear=True)
    damped.write().overwrite().save(str(tmp_path / "tfidf"))
    damped = PipelineModel.load(str(tmp_path / "tfidf")).transform(terms)
    totals = {r["doc_id"]: sum(r["v"]) for r in damped.select("doc_id", vector_to_array("features").alias("v")).collect()}
    want = ft.tfidf_long(terms, "doc_id", min_df=2, sublinear=True).groupBy("doc_id").agg(F.sum("tfidf").alias("s"))
    assert all(totals[r["doc_id"]] == pytest.approx(r["s"]) for r in want.collect())
    sub = {(r["doc_id"], r["term"]): r["tfidf"] for r in ft.tfidf_long(terms, "doc_id", min_df=1, sublinear=True).collect()}
    assert 1 < sub[(2, "refund")] / sub[(2, "parcel")] < long.get((2, "refund"), 9) / 0.1


def test_discovery_covers_every_message_once(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumnRenamed("text", "customer_message")
    out = corpus.discover_intents(docs, ["doc_id"], k=4, restarts=2).select("doc_id", "cluster", "customer_message")
    assert out.count() == docs.select("customer_message").distinct().count()
    assert {r["cluster"] for r in out.select("cluster").distinct().collect()} <= set(range(4))
    again = corpus.discover_intents(docs, ["doc_id"], k=4, restarts=2).select("doc_id", "cluster")
    assert rows(again, "doc_id") == rows(out.select("doc_id", "cluster"), "doc_id")
    report = corpus.cluster_report(out, "doc_id", "customer_message", n=3)
    assert report.agg(F.max("cluster_size")).first()[0] >= 1 and report.count() <= 12


def test_char_ngrams_cover_the_whole_text(spark):
    df = spark.createDataFrame([("Äb  cd",), ("ab",), (None,), ("x" * 40000,)], "t string").coalesce(1)
    grams = column(ft.char_ngrams(df, "t"), F.col("grams"))
    assert grams[0] == ["ä b  ", "b   c", "  c d"] and grams[1] == grams[2] == [] and len(grams[3]) == 39998


def test_language_model(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = ml.fit_language(docs, "text", "lang")
    seen = ml.language_probability(model, docs, "text")
    hits = seen.where("(lang = 'en') = (english_probability >= 0.8)").count()
    assert hits / docs.count() > 0.95
    blank = spark.createDataFrame([("",), (None,)], "text string")
    assert [r["english_probability"] for r in ml.language_probability(model, blank, "text").collect()] == [0.0, 0.0]


def test_encoders_give_unit_vectors(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    model = ft.hashed_encoder(docs, "text", dims=64)
    lengths = ft.encode_hashed(model, docs, "text").select(vx.norm("embedding").alias("n")).collect()
    assert all(abs(r["n"] - 1) < 1e-5 for r in lengths)

    def load():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    out = ft.encode_with(docs.limit(3), "text", load).select(F.length("text").alias("n"), "embedding")
    assert all(r["embedding"] == [float(r["n"]), 1.0] for r in out.collect())


def test_tiers(spark):
    df = spark.createDataFrame([(0.9,), (0.5,), (0.49,)], "confidence double")
    assert [r["tier"] for r in ml.label_tiers(df, 0.9, 0.5).collect()] == ["HIGH", "MEDIUM", "LOW"]
