import hashlib
from itertools import accumulate

from frames import rows
from pyspark.sql import functions as F

from deskwise.operators import ranking as rk


def test_hash_rank_equals_a_global_sort(spark):
    df = spark.range(5000)
    got = {r["id"]: r["shuffle_pos"] for r in rk.shuffled(df, 7, "id").collect()}
    keys = sorted(range(5000), key=lambda i: hashlib.md5(f"7|{i}".encode()).hexdigest())
    assert got == {i: n for n, i in enumerate(keys, 1)}
    plan = rk.shuffled(df, 7, "id")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_split_is_exact_for_hot_and_null_classes(spark):
    label = F.when(F.col("id") < 3000, "hot").when(F.col("id") < 3007, "rare").when(F.col("id") < 3009, None).otherwise("one")
    df = spark.range(3010).withColumn("y", label)
    out = rk.stratified_split(df, "y", 0.2, 42, "id")
    counts = {(r["y"], r["split"]): r["n"] for r in out.groupBy("y", "split").agg(F.count("*").alias("n")).collect()}
    assert counts == {
        ("hot", "test"): 600, ("hot", "train"): 2400, ("rare", "test"): 1, ("rare", "train"): 6,
        (None, "train"): 2, ("one", "train"): 1,
    }
    hot = sorted(range(3000), key=lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest())[:600]
    test_ids = {r["id"] for r in out.where("y = 'hot' and split = 'test'").collect()}
    assert test_ids == set(hot)


def test_split_all_and_none(spark):
    df = spark.range(50).withColumn("y", F.lit("a"))
    assert rk.stratified_split(df, "y", 1.0, 1, "id").where("split = 'test'").count() == 50
    assert rk.stratified_split(df, "y", 0.0, 1, "id").where("split = 'test'").count() == 0


def test_samples(spark):
    df = spark.range(1000).withColumn("c", F.when(F.col("id") < 900, "big").otherwise("small"))
    out = rk.stratified_sample(df, ["c"], 150, 42, "id")
    assert rows(out.groupBy("c").count(), "c") == [("big", 150), ("small", 100)]
    assert out.select("id").distinct().count() == 250
    a, b = (sorted(r["id"] for r in rk.uniform_sample(df, 50, 42, "id").collect()) for _ in range(2))
    assert a == b and len(set(a)) == 50
    assert rk.uniform_sample(df.limit(10), 50, 42, "id").count() == 10


def test_first_n(spark):
    df = spark.range(20000, numPartitions=8).select((F.col("id") * 7 + 3).alias("pos"), "id")
    for n in (1, 17, 999, 19999):
        got = rk.first_n(df, "pos", n)
        assert got.count() == n and got.agg(F.max("id")).first()[0] == n - 1
    assert rk.first_n(df, "pos", 20000).count() == 20000
    assert rk.first_n(df, "pos", 10**6).count() == 20000


def test_first_n_kept_widens_until_enough_rows_are_left(spark):
    df = spark.range(10000, numPartitions=8).withColumnRenamed("id", "pos")
    seen = []

    def keep(part):
        seen.append(part.count())
        return part.where("pos % 50 = 0")

    got = rk.first_n_kept(df, "pos", 20, keep)
    assert sorted(r["pos"] for r in got.collect()) == [50 * i for i in range(20)]
    assert list(accumulate(seen)) == [40, 160, 640, 2560]  # each round sees the rows the one before did not
    assert rk.first_n_kept(df, "pos", 900, lambda d: d.where("pos % 50 = 0")).count() == 200


def test_samples_move_no_wide_rows(spark):
    """The table itself is scanned and filtered; only keys are shuffled."""
    df = spark.range(5000, numPartitions=8).withColumn("c", F.col("id") % 3).withColumn("wide", F.repeat(F.lit("x"), 50))
    plan = rk.stratified_sample(df, ["c"], 20, 42, "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    want = sorted(range(5000), key=lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest())
    got = {r["id"] for r in rk.stratified_sample(df, ["c"], 20, 42, "id").collect()}
    assert got == {i for c in range(3) for i in [j for j in want if j % 3 == c][:20]}
    assert {r["id"] for r in rk.uniform_sample(df, 33, 42, "id").collect()} == set(want[:33])
