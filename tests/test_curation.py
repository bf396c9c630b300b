import pytest
from frames import rows
from pyspark.sql import functions as F

from deskwise.config import BATCH, RUNTIME
from deskwise.operators import curation as cu
from deskwise.operators import guards
from deskwise.plans import corpus
from deskwise.sources import tables as src

LONG = "where is my late parcel and the refund"


def pairs(spark):
    data = [
        (1, "a", f"{LONG} @me ^JS", "we are on it and will help you"),
        (2, "b", LONG, "we are on it and will help you"),  # equals row 1 once cleaned
        (3, "c", LONG, "another answer to the same of them"),
        (4, "d", None, "no question is in this row at all"),
        (5, "e", "https://only.url", "we are on it and will help you"),
        (6, "f", "the short", "we are on it and will help you"),  # nine characters
        (7, "g", "Appreciate it!!", "we are on it and will help you"),
        (8, "h", "der Auftrag ist nicht da und die Ware auch", "wir sind nicht zu sehen und das ist so"),
    ]
    return spark.createDataFrame(data, "pos int, message_id string, customer_message string, agent_response string")


def test_clean_pairs_and_funnel(spark):
    out = corpus.clean_pairs(pairs(spark), ["pos"])
    assert [r[0] for r in rows(out.select("pos"), "pos")] == [1, 3]
    again = cu.dedupe_first(out, list(corpus.PAIR), ["pos"])
    assert again.count() == out.count()  # a second de-duplication removes nothing
    funnel = [r[1] for r in rows(corpus.cleaning_funnel(pairs(spark)), "step")]
    assert funnel == [8, 7, 6, 5, 4, 3, 2]


def test_cleaning_runs_once_per_row(spark):
    plan = corpus.clean_pairs(pairs(spark), ["pos"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("https?") == 2  # one cleaning chain per column, none inside the filter


def test_pairing_needs_the_direct_answer(spark):
    turns = [(1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 2, "user", "q2"), (1, 3, "user", "q3"),
             (1, 4, "assistant", "a3"), (2, 0, "assistant", "x"), (2, 1, "user", "open")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = cu.pair_turns(df).select("message_id", "response_id", "agent_response")
    assert rows(out, "message_id") == [("1-0", "1-1", "a1"), ("1-3", "1-4", "a3")]


def test_dedupe_treats_nulls_as_equal_and_follows_order(spark):
    df = spark.createDataFrame([(3, "x"), (1, "x"), (2, None), (4, None)], "pos int, k string")
    assert rows(cu.dedupe_first(df, ["k"], ["pos"]), "pos") == [(1, "x"), (2, None)]
    assert rows(cu.first_rows(df, ["k"], [F.desc("pos")], 1), "pos") == [(3, "x"), (4, None)]


def test_hot_key_is_limited_before_the_shuffle(spark):
    df = spark.range(30000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    out = cu.dedupe_first(df, ["k"], ["id"])
    assert out.count() == 20001
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_duplicate_audit(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", "x"), (None, None)], "k string, m string")
    assert rows(cu.duplicate_audit(df, ["k", "m"]), "column_name") == [("k", 4, 1), ("m", 4, 2)]


def test_guards(spark):
    df = spark.createDataFrame([("1", " a "), ("2", "b"), (None, "c"), ("4", None)], "id string, m string")
    golden = spark.createDataFrame([("1", "z"), ("9", " b"), (None, None)], "id string, m string")
    assert {r["m"] for r in guards.exclude_ids(df, golden, "id").collect()} == {"b", "c", None}
    assert {r["m"] for r in guards.exclude_messages(df, golden, "m").collect()} == {" a ", "c", None}
    assert [r["m"] for r in guards.golden_matches(df, golden, "m").collect()] == ["b"]
    assert rows(guards.removed_counts(df, golden, "id", "m"), "n_rows") == [(4, 1, 1, 2)]


@pytest.mark.parametrize("limit", [200_000, 0])
def test_guards_with_a_hot_key_in_both_ways(spark, monkeypatch, limit):
    """A third of the rows share one golden text; broadcast and salted joins agree."""
    from deskwise import session

    monkeypatch.setattr(session, "MAX_BROADCAST_ROWS", limit)
    hot = F.when(F.col("id") % 3 == 0, " hot").otherwise(F.col("id").cast("string"))
    df = spark.range(9000).select(F.col("id"), hot.alias("m"))
    golden = spark.createDataFrame([(1, "hot"), (5, "7"), (99999, None)], "id long, m string")
    kept = guards.exclude_messages(df, golden, "m")
    assert (kept.count(), kept.columns) == (5999, ["id", "m"])
    assert guards.golden_matches(df, golden, "m").count() == 3001
    assert guards.exclude_ids(df, golden, "id").count() == 8998
    assert guards.removed_counts(df, golden, "id", "m").first()[:] == (9000, 2, 3001, 5997)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert ("__salt" in plan) == (limit == 0)
    truth = spark.createDataFrame([("7", 1), (" hot", 2), (" hot", 3)], "m string, y int")
    joined = guards.join_truth(df, truth, "m", ["y"])
    assert (joined.count(), joined.agg(F.sum("y")).first()[0]) == (3001, 6001)
    assert joined.columns == ["id", "m", "y"]


def test_fan_out_is_counted_not_built(spark):
    left = spark.createDataFrame([("t",)] * 300 + [("u",)], "m string")
    right = spark.createDataFrame([("t",)] * 200, "m string")
    assert rows(guards.text_fan_out(left, right, "m"), "n_texts") == [(1, 300, 60000)]
    truth = spark.createDataFrame([("t", 2), ("t", 1)], "m string, y int")
    assert guards.join_truth(left, truth, "m", ["y"]).agg(F.count("*"), F.max("y")).first()[:] == (300, 1)


def test_combined_training_prefers_reviewed_rows(spark):
    cols = "message_id string, customer_message string, {} string, confidence string, reason string, pos int"
    verified = spark.createDataFrame(
        [("1", "m1", "R", "HIGH", "r", 1), ("2", "m2", "R", "HIGH", "r", 2), ("9", "gold", "R", "HIGH", "r", 3)],
        cols.format("corrected_intent"),
    )
    selected = spark.createDataFrame(
        [("1", "m1b", "S", "MEDIUM", "s", 1), ("3", "m2", "S", "MEDIUM", "s", 2), ("4", "m4", "S", "MEDIUM", "s", 3),
         ("4", "m5", "S", "MEDIUM", "s", 4)],
        cols.format("intent"),
    )
    golden = spark.createDataFrame([("9",)], "message_id string")
    out = corpus.combined_training(verified, selected, golden, "pos").select("message_id", "customer_message", "intent")
    assert rows(out, "message_id") == [("1", "m1", "R"), ("2", "m2", "R"), ("4", "m4", "S")]


def test_history_profiles(spark):
    golden = spark.createDataFrame([("b", LONG)], "message_id string, customer_message string")
    runtime = corpus.retrieval_history(pairs(spark), golden, RUNTIME.with_(history_limit=3), "pos")
    # 4 and 5 are empty, 2 is golden; limit 3 keeps 1, 3, 6; 3 repeats the cleaned text of 1
    assert [r[0] for r in rows(runtime.select("message_id"), "message_id")] == ["a", "f"]
    batch = corpus.retrieval_history(pairs(spark), golden, BATCH.with_(history_limit=5), "pos")
    # first five rows, 4 has no message, 2 and 3 are the golden text
    assert [r[0] for r in rows(batch.select("message_id"), "message_id")] == ["a", "e"]


def test_csv_round_trip(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_bytes(
        '﻿ id , note,n\n1,"a ""quoted"" word, and\na line",5.0\n2,NA,x\n3,,7\n'.encode()
    )
    df = src.read_table(spark, str(path))
    assert df.columns == ["id", "note", "n"]
    got = rows(src.coerce_numbers(df, ["n"]), "id")
    assert got == [("1", 'a "quoted" word, and\na line', 5.0), ("2", None, None), ("3", None, 7.0)]
    src.write_table(df, str(tmp_path / "out"), "csv")
    assert rows(src.read_table(spark, str(tmp_path / "out")), "id") == rows(df, "id")
    src.write_table(df, str(tmp_path / "pq"))
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 3


def test_column_checks(spark):
    df = spark.createDataFrame([(1, "a")], "id int, m string")
    with pytest.raises(ValueError, match="gone"):
        src.require_columns(df, ["id", "gone"])
    assert src.select_present(df, ["m", "gone"]).columns == ["m"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet("/nowhere/at/all")


def test_brand_filter_reaches_the_scan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = src.by_source(docs, "src3").select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(source,src3)" in plan and "ReadSchema: struct<doc_id:bigint,source:string>" in plan


def test_history_has_no_bound_by_default(spark):
    many = spark.range(12_000).selectExpr(
        "id AS pos", "CAST(id AS STRING) AS message_id", "concat('my parcel number ', id, ' is late') AS customer_message",
        "concat('we are sorry about parcel ', id) AS agent_response",
    )
    none = many.limit(0)
    for cfg in (RUNTIME, BATCH):
        assert corpus.retrieval_history(many, none, cfg, "pos").count() == 12_000


def test_lookup_is_broadcast_by_bytes(spark):
    from deskwise import session

    wide = spark.range(10).selectExpr("id", "repeat('x', 1000) AS text")
    assert session.small_table(wide, max_bytes=5_000) is None and session.small_table(wide).count() == 10
