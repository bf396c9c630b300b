import random

import pytest
from frames import rows
from pyspark.sql import functions as F

from deskwise.operators import curation, guards, ranking
from deskwise.plans import corpus


@pytest.mark.parametrize("piece", [1024, 7, 1])
def test_every_result_meets_every_truth_of_its_text(spark, piece):
    """One text holds a third of both sides; nulls and texts of one side meet nothing."""
    rng = random.Random(0)
    left = [(k, "hot" if k % 3 == 0 else rng.choice(["a", "b", "c", "only left", None])) for k in range(90)]
    right = [(100 + k, "hot" if k % 3 == 0 else rng.choice(["a", "b", "only right", None]), k % 2) for k in range(60)]
    a = spark.createDataFrame(left, "id long, text string").repartition(4)
    b = spark.createDataFrame(right, "truth_id long, text string, label int").repartition(3)
    got = guards.join_truth_all(a, b, "text", ["id", "text"], ["truth_id", "label"], piece)
    assert got.columns == ["id", "text", "truth_id", "label"]
    want = sorted((i, t, j, y) for i, t in left for j, u, y in right if t is not None and t == u)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 600
    if piece == 7:
        assert guards.join_truth_all(a, b.where("false"), "text", ["id"], ["label"]).count() == 0


def test_conflicts_are_counted(spark):
    truth = [(1, "x", 1), (2, "x", 1), (3, "y", 0), (4, "y", 1), (5, "y", None), (6, "z", 1), (7, None, 1), (8, None, 0)]
    got = guards.truth_conflicts(spark.createDataFrame(truth, "id long, text string, label int"), "text", ["label"], "id")
    assert rows(got, "first_id") == [(1, 2, 1, False), (3, 3, 3, True)]


def test_guard_counts_come_from_the_writing_job(spark, tmp_path):
    golden = spark.createDataFrame([("1", " hi "), ("9", None), (None, "late")], "id string, message string")
    sent = spark.createDataFrame([("1", "x"), ("2", "hi"), ("3", "late "), ("1", "hi"), (None, "y"), ("4", None)], "id string, message string")
    counts = guards.write_guarded(sent, golden, "id", "message", str(tmp_path / "kept"))
    assert counts == guards.removed_counts(sent, golden, "id", "message").first().asDict()
    kept = spark.read.parquet(str(tmp_path / "kept"))
    assert kept.columns == sent.columns and kept.count() == counts["n_kept"] == 2


def test_the_funnel_comes_from_the_writing_job(spark, tmp_path):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    sent = curation.pair_turns(turns).withColumn("pos", F.col("conv_id") * 1000 + F.col("turn"))
    odd = [("thanks", "ok then, the bye"), ("", "the end is near"), (None, "x"), ("the same is the same", "as it was in the end"), ("the same is the same", "as it was in the end"), ("a b", "c")]
    odd = spark.createDataFrame([(10**9 + k, *p) for k, p in enumerate(odd)], "pos long, customer_message string, agent_response string")
    sent = sent.select("pos", *corpus.PAIR).unionByName(odd)
    counts = corpus.write_clean_pairs(sent, ["pos"], str(tmp_path / "clean"))
    assert counts == {r.step: r.n_rows for r in corpus.cleaning_funnel(sent).collect()}
    assert rows(spark.read.parquet(str(tmp_path / "clean")), "pos") == rows(corpus.clean_pairs(sent, ["pos"]), "pos")
    assert len(set(counts.values())) > 3


@pytest.mark.parametrize("share", [0.0, 0.1, 0.2, 0.37, 0.5, 1.0])
def test_a_split_has_the_total_asked_for(spark, share):
    sizes = {"a": 33, "b": 7, "c": 1, "d": 12, None: 5}
    data = [(k, c) for c, n in sizes.items() for k in range(n)]
    df = spark.createDataFrame([(i, c) for i, (_, c) in enumerate(data)], "id long, label string")
    got = ranking.split_exact_total(df, "label", share, 3, "id")
    tested = {r.label: r["n"] for r in got.where("split = 'test'").groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = int(share * len(data) + 0.5)
    quota = {c: total * n / len(data) for c, n in sizes.items()}
    assert sum(tested.values()) == total and got.count() == len(data)
    assert all(int(q) <= tested.get(c, 0) <= int(q) + 1 for c, q in quota.items())
