import numpy as np
import pytest
from frames import rows
from pyspark.sql import functions as F

from deskwise.functions import lexicon as lx
from deskwise.operators import failures, metrics, quality, review


def labelled(spark, counts):
    """A table with the given number of rows per (truth, prediction)."""
    data = [pair for pair, n in counts.items() for _ in range(n)]
    return spark.createDataFrame(data, "y string, p string")


def pair_table(spark, counts):
    return metrics.pair_counts(labelled(spark, counts), "y", "p")


def test_published_escalation_table(spark):
    counts = {("ESCALATE", "ESCALATE"): 79, ("AUTO_HANDLE", "ESCALATE"): 112,
              ("ESCALATE", "AUTO_HANDLE"): 8, ("AUTO_HANDLE", "AUTO_HANDLE"): 41}
    row = metrics.binary_prf(pair_table(spark, counts), "ESCALATE").first().asDict()
    assert [round(100 * row[k], 2) for k in ("accuracy", "precision", "recall", "f1")] == [50.0, 41.36, 90.80, 56.83]
    matrix = metrics.confusion_matrix(pair_table(spark, counts), ["AUTO_HANDLE", "ESCALATE"])
    assert rows(matrix, "actual") == [("AUTO_HANDLE", 41, 112), ("ESCALATE", 8, 79)]


EDGE = {("a", "a"): 3, ("a", "b"): 1, ("b", "b"): 2, ("never predicted", "a"): 2, ("b", "never true"): 1, ("a", None): 1}


def test_labels_without_truth_or_prediction(spark):
    table = pair_table(spark, EDGE)
    got = {r["label"]: r for r in metrics.label_metrics(table).collect()}
    assert sorted(got) == ["", "a", "b", "never predicted", "never true"]
    assert (got["a"]["precision"], got["a"]["recall"], got["a"]["support"]) == (3 / 5, 3 / 5, 5)
    assert got["never predicted"]["precision"] == got["never true"]["recall"] == got["never true"]["f1"] == 0
    report = {r["label"]: r for r in metrics.class_report(table).collect()}
    assert report["accuracy"]["f1"] == 0.5 and report["macro avg"]["support"] == 10
    macro = np.mean([r["f1"] for r in got.values()])
    assert report["macro avg"]["f1"] == pytest.approx(macro)
    weighted = sum(r["f1"] * r["support"] for r in got.values()) / 10
    assert report["weighted avg"]["f1"] == pytest.approx(weighted)
    matrix = metrics.confusion_matrix(table, ["a", "b", "never true"])
    assert rows(matrix.where("actual = 'never true'"), "actual") == [("never true", 0, 0, 0)]
    assert [r["label"] for r in metrics.label_domain(table).collect()] == sorted(got)


def test_weighted_scores_agree_with_the_ml_evaluator(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    counts = {("0", "0"): 5, ("0", "1"): 2, ("1", "1"): 4, ("1", "2"): 1, ("2", "2"): 3, ("2", "0"): 2}
    doubles = labelled(spark, counts).select(*[F.col(c).cast("double") for c in ("y", "p")])
    ours = metrics.macro_weighted(pair_table(spark, counts)).where("average = 'weighted'").first()
    for name, ml in (("precision", "weightedPrecision"), ("recall", "weightedRecall"), ("f1", "f1")):
        theirs = MulticlassClassificationEvaluator(labelCol="y", predictionCol="p", metricName=ml).evaluate(doubles)
        assert ours[name] == pytest.approx(theirs)


def test_describe_equals_numpy(spark):
    rng = np.random.default_rng(0)
    values = np.round(np.concatenate([rng.uniform(-1, 1, 501), [0.25] * 300]), 6)
    df = spark.createDataFrame([("g", float(v)) for v in values] + [("one", 0.5), ("one", None)], "g string, s double")
    got = {r["g"]: r for r in metrics.describe_scores(df, "g", "s").collect()}
    g = got["g"]
    assert (g["count"], g["min"], g["max"]) == (801, values.min(), values.max())
    assert [g[p] for p in ("p25", "p50", "p75")] == pytest.approx(list(np.percentile(values, [25, 50, 75])))
    assert (g["mean"], g["std"]) == pytest.approx((values.mean(), values.std(ddof=1)))
    assert got["one"]["std"] is None and got["one"]["p25"] == 0.5


def test_frequency_drops_nulls_and_orders(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("c",), ("a",)], "k string")
    assert [tuple(r) for r in metrics.frequency(df, "k").collect()] == [("a", 2), ("b", 2), ("c", 1)]
    assert [r["k"] for r in metrics.frequency(df, "k", by="key").collect()] == ["a", "b", "c"]


def test_majority_and_lift(spark):
    train = spark.createDataFrame([("x",), ("y",), ("y",), ("x",), (None,)], "l string")
    test = spark.createDataFrame([("x",)] * 70 + [("y",)] * 170, "l string")
    row = metrics.majority_baseline(train, test, "l").first()
    assert (row["majority_label"], row["n_rows"], round(100 * row["accuracy"], 2)) == ("x", 240, 29.17)
    table = spark.createDataFrame([("majority", 70 / 240), ("tfidf", 125 / 240), ("embedding", 134 / 240)], "method string, accuracy double")
    lift = {r["method"]: round(r["lift_pp"], 2) for r in metrics.method_lift(table, "embedding").collect()}
    assert lift == {"majority": 26.67, "tfidf": 3.75, "embedding": 0.0}


def test_first_match_and_hit_rates(spark):
    data = [(q, r, r == first) for q, first in ((1, 1), (2, 3), (3, 5), (4, None)) for r in range(1, 6)]
    cases = spark.createDataFrame(data, "query_id int, rank int, match boolean")
    firsts = metrics.first_match(cases)
    assert rows(firsts, "query_id") == [(1, 1), (2, 3), (3, 5), (4, None)]
    assert metrics.hit_rates(firsts).first()[:] == (4, 0.25, 0.5, 0.75)


def test_unpivot_skips_absent_ranks(spark):
    wide = spark.createDataFrame([(1, "A", "B")], "query_id int, retrieved_1_intent string, retrieved_3_intent string")
    assert metrics.available_ranks(wide) == [1, 3]
    assert rows(metrics.wide_to_long(wide, ["query_id"], ["intent"]), "rank") == [(1, 1, "A"), (1, 3, "B")]
    with pytest.raises(ValueError, match="retrieved"):
        metrics.wide_to_long(wide.select("query_id"), ["query_id"], ["intent"])


def responses(spark):
    data = [
        (1, "Delivery Delay", "The latest tracking shows your delivery."),  # 4: "late" in "latest"
        (2, "Payment / Billing", "Please reset your password for this account."),  # unsafe
        (3, "Delivery Delay", "Nothing to be said of it."),  # present and safe only
        (4, "No such intent", "x" * 19),  # short, nothing to do, safe, relevant by default
        (5, "Delivery Delay", "my otp  "),  # nothing
        (6, None, "  " + "y" * 20 + "  "),
        (7, "Return / Refund", None),
    ]
    return spark.createDataFrame(data, "query_id int, predicted_intent string, generated_response string")


def test_screening(spark):
    got = quality.screen(responses(spark)).select("query_id", "quality_score", "quality")
    assert rows(got, "query_id") == [
        (1, 4, "GOOD"), (2, 3, "PARTIAL"), (3, 2, "PARTIAL"), (4, 2, "PARTIAL"), (5, 0, "POOR"),
        (6, 3, "PARTIAL"), (7, 1, "POOR"),
    ]
    summary = {r["metric"]: r["value"] for r in quality.summary(quality.screen(responses(spark))).collect()}
    assert summary["Total Responses"] == 7.0 and summary["POOR %"] == 28.57 and summary["Safe %"] == 71.43
    poor = quality.poor_examples(quality.screen(responses(spark)), "query_id", 1)
    assert [r["query_id"] for r in poor.collect()] == [5]


def test_template_quirks(spark):
    """The account template mentions passwords, the hand-over text is always actionable."""
    data = [(1, "Account / Login / Security", lx.BATCH_TEMPLATES["Account / Login / Security"]),
            (2, "Return / Refund", lx.HANDOVER["batch"])]
    df = spark.createDataFrame(data, "query_id int, predicted_intent string, generated_response string")
    got = quality.screen(df).select("query_id", "actionable", "safe", "intent_relevant")
    assert rows(got, "query_id") == [(1, True, False, True), (2, True, True, False)]


def test_failure_modes_and_examples(spark):
    cls = spark.createDataFrame(
        [(i, f"m{i}", "Delivery Delay", "Delivered but Not Received") for i in range(11)]
        + [(90, "m90", "Return / Refund", "Return / Refund "), (91, "m91", "Return / Refund", "x")],
        "query_id int, customer_message string, true_intent string, predicted_intent string",
    )
    ret = cls.select("query_id", "customer_message", F.col("true_intent").alias("corrected_intent"), F.col("predicted_intent").alias("retrieved_1_intent"))
    esc = spark.createDataFrame(
        [(1, "a", "Escalate", "AUTO_HANDLE", "r1"), (2, "b", "AUTO_HANDLE", "ESCALATE", "r2"), (3, "c", "ESCALATE", "ESCALATE", "r3")],
        "query_id int, customer_message string, system_decision string, expected_decision string, system_reason string",
    )
    scr = quality.screen(responses(spark).withColumn("customer_message", F.lit("m")))
    modes = {r["rank"]: r["evidence"] for r in failures.failure_modes(cls, ret, esc, scr).collect()}
    assert modes[1] == "Delivery Delay was predicted as Delivered but Not Received 11 times."
    assert modes[2].startswith("12 of 13 Golden queries")
    assert modes[3].startswith("1 routine cases") and modes[4].startswith("1 cases required")
    assert modes[5].startswith("4 of 7 responses were rated PARTIAL; intent relevance was only 57.14%")
    ex = failures.failure_examples(cls, ret, esc, scr).select("failure_rank", "customer_message", "reason")
    got = rows(ex, "failure_rank", "customer_message")
    assert [r[:2] for r in got] == [(1, "m0"), (1, "m1"), (2, "m0"), (2, "m1"), (3, "a"), (4, "b"), (5, "m"), (5, "m")]
    assert got[0][2].endswith("confusion: Delivery Delay → Delivered but Not Received.")
    right = cls.where("query_id = 90").withColumn("predicted_intent", F.col("true_intent"))
    assert {r["rank"] for r in failures.failure_modes(right, ret, esc, scr).collect()} == {2, 3, 4, 5}


def test_review_scores(spark):
    data = [(1, "5.0"), (2, "0"), (3, "6"), (4, "x"), (5, ""), (6, None), (7, "4.5"), (8, "1")]
    df = spark.createDataFrame(data, "id int, human_overall string")
    got = rows(review.check_scores(df, ("human_overall",)).select("id", "human_overall", "valid"), "id")
    assert [g[0] for g in got if g[2]] == [1, 8] and got[0][1] == 5
    new = spark.createDataFrame([(1, "3"), (9, "2")], "id int, human_overall string")
    assert rows(review.upsert(df.where("id < 3"), new, "id"), "id") == [(1, "3"), (2, "0"), (9, "2")]


def test_published_review_averages(spark):
    """Score counts of the published review: 50 rows, 38 of them rated four or five."""
    def spread(**counts):
        return [int(k[1:]) for k, n in counts.items() for _ in range(n)]

    columns = {
        "human_relevance": spread(s5=38, s4=2, s3=8, s2=2),
        "human_actionability": spread(s2=44, s3=6),
        "human_safety": spread(s5=50),
        "human_grounding": spread(s4=45, s3=3, s2=2),
        "human_overall": spread(s4=38, s3=6, s2=6),
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} int" for c in columns))
    row = review.review_summary(df).first()
    assert [round(row[f"avg_{c}"], 2) for c in columns] == [4.52, 2.12, 5.0, 3.86, 3.64]
    assert (row["n_good"], row["good_pct"]) == (38, 76.0)


def test_review_sheet(spark):
    df = spark.range(60).select("id", F.lit("m").alias("customer_message"), F.lit("i").alias("predicted_intent"), F.lit("r").alias("generated_response"))
    sheet = review.review_sheet(df, "id")
    assert sheet.count() == 50 and sheet.columns[-6:] == [*review.SCORES, review.NOTES]
    assert sheet.where("human_overall is not null").count() == 0


def test_evaluation_tables(spark):
    from deskwise.plans import evaluation as ev

    data = [(i, " escalate" if i < 3 else "auto_handle", "ESCALATE" if i % 2 else "AUTO_HANDLE") for i in range(10)]
    df = spark.createDataFrame(data, "i int, s string, e string")
    out = ev.evaluate_escalation(df, "e", "s", "i")
    assert out["binary"].first()[:4] == (1, 2, 4, 3)
    assert [r["i"] for r in out["wrong"].collect()] == [0, 2, 3, 5, 7, 9]
    assert rows(out["confusion"], "actual") == [("AUTO_HANDLE", 3, 2), ("ESCALATE", 4, 1)]
    cases = spark.createDataFrame(
        [(q, r, "A", "A" if q == r else "B", 0.5, 1) for q in (1, 2) for r in (1, 2)],
        "query_id int, rank int, truth string, intent string, similarity double, history_id int",
    )
    got = ev.evaluate_retrieval(cases, "truth")
    assert got["hit_rates"].first()[:] == (2, 0.5, 1.0, 1.0)
    assert rows(got["consistency"], "rank") == [(1, 2, 0.5), (2, 2, 0.5)]
    assert [r["query_id"] for r in got["worst"].collect()] == [2]
    assert metrics.with_correct(cases, "truth", "absent").where("correct").count() == 0


def test_training_rows_share_nothing_with_golden(spark):
    from deskwise.plans import evaluation as ev

    train = spark.createDataFrame([(1, "a"), (2, "b"), (3, " c"), (4, "d"), (5, "d")], "id int, m string")
    golden = spark.createDataFrame([(1, "x"), (9, "c ")], "id int, m string")
    assert [r["id"] for r in ev.training_rows(train, golden, "id", "m", ["id"]).orderBy("id").collect()] == [2, 4]
