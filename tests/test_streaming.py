from frames import rows
from pyspark.sql import functions as F

from deskwise import catalog, session
from deskwise.config import BATCH
from deskwise.operators.guards import exclude_ids
from deskwise.plans import triage as plan
from deskwise.streaming import messages as ms

SCHEMA = "query_id long, customer_message string, predicted_intent string, confidence double, embedding array<float>"


def test_stream_equals_batch_and_isolates_bad_rows(spark, tmp_path):
    history = spark.createDataFrame(
        [(i, [1.0 - i / 10, i / 10], "Return / Refund") for i in range(8)],
        "history_id long, embedding array<float>, intent string",
    )

    def score(batch):
        cases = plan.retrieve_cases(batch, history, BATCH)
        return plan.triage(batch, cases, BATCH)

    sent = [
        (1, "where is my parcel", "Return / Refund", 0.9, [1.0, 0.0]),
        (2, "   ", "Return / Refund", 0.9, [1.0, 0.0]),
        (3, "my password is gone", "Return / Refund", 0.9, [0.0, 1.0]),
        (4, None, "Return / Refund", 0.9, [0.0, 1.0]),
        (5, "late again", "Return / Refund", 0.2, [0.6, 0.8]),
    ]
    all_rows = spark.createDataFrame(sent, SCHEMA)
    inbox = str(tmp_path / "in")
    out, bad, check = (str(tmp_path / d) for d in ("out", "bad", "check"))
    for part in (all_rows.where("query_id < 3"), all_rows.where("query_id >= 3")):  # two arrivals
        part.coalesce(1).write.mode("append").parquet(inbox)
        stream = ms.file_stream(spark, inbox, part.schema)
        query = ms.triage_stream(stream, score, out, bad, check)
        query.awaitTermination()
        assert query.exception() is None
    got = spark.read.parquet(out).drop("epoch")
    want = score(all_rows.where("query_id in (1, 3, 5)"))
    assert rows(got, "query_id") == rows(want.select(*got.columns), "query_id")
    assert sorted(r["query_id"] for r in spark.read.parquet(bad).collect()) == [2, 4]


def run(spark, stream, tmp_path, name):
    query = ms.write_stream(stream, str(tmp_path / name), str(tmp_path / f"{name}-check"))
    query.awaitTermination()
    assert query.exception() is None
    return spark.read.parquet(str(tmp_path / name))


def test_control_words_and_guard(spark, tmp_path):
    sent = spark.createDataFrame([("1", "hi"), ("2", " "), ("3", " EXIT "), ("4", "quit"), ("5", "exit now"), ("6", None)], "id string, customer_message string")
    sent.write.parquet(str(tmp_path / "in"))
    stream = ms.real_messages(ms.file_stream(spark, str(tmp_path / "in"), sent.schema))
    golden = spark.createDataFrame([("5",)], "id string")
    got = run(spark, exclude_ids(stream, golden, "id"), tmp_path, "kept")
    assert [r["id"] for r in got.collect()] == ["1"]


def test_dedupe_and_mix_over_events(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = ms.file_stream(spark, "/root/testdata/sf0.001", events.schema, glob="events.parquet")
    got = run(spark, ms.dedupe_stream(stream, ["user_id", "event_type"], "ts", "3650 days"), tmp_path, "first")
    assert got.count() == events.select("user_id", "event_type").distinct().count()
    mix = run(spark, ms.decision_mix(stream.withColumn("d", F.col("event_type")), "ts", "d"), tmp_path, "mix")
    total = mix.agg(F.sum("n")).first()[0]
    assert 0 < total <= events.count()


def folder_of_folders(spark, path):
    """The smallest tables, each a folder of two files."""
    for name in ("conversations", "documents", "labels", "events"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").repartition(2).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def same_as_one_file(spark, name, path):
    run = catalog.queries()[name]
    found, want = (run(spark, folder) for folder in (folder_of_folders(spark, path), "/root/testdata/sf0.001"))
    assert rows(found, *found.columns) == rows(want, *found.columns) and found.count() > 0


def test_messages_of_a_table_of_several_files(spark, tmp_path):
    same_as_one_file(spark, "stream_messages", tmp_path)


def test_guarded_documents_of_a_table_of_several_files(spark, tmp_path):
    same_as_one_file(spark, "stream_guard", tmp_path)


def test_growing_history_of_a_table_of_several_files(spark, tmp_path):
    same_as_one_file(spark, "stream_growing_history", tmp_path)


def test_triage_of_a_table_of_several_files(spark, tmp_path):
    same_as_one_file(spark, "stream_triage", tmp_path)


def test_guard_with_more_labels_than_are_sent(spark, tmp_path, monkeypatch):
    """The labels are shuffled, and so is a stream that is joined as it is."""
    monkeypatch.setattr(session, "MAX_BROADCAST_ROWS", 10)
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet") for name in ("documents", "labels"))
    want = rows(docs.join(labels, "doc_id", "left_anti").select("doc_id", "lang"), "doc_id")
    got = catalog.queries()["stream_guard"](spark, folder_of_folders(spark, tmp_path / "tables"))
    assert rows(got, "doc_id") == want
    docs.select(F.expr("nullif(doc_id, 3)").alias("doc_id"), "lang").write.parquet(str(tmp_path / "in"))
    sent = spark.read.parquet(str(tmp_path / "in"))
    guarded = exclude_ids(ms.file_stream(spark, str(tmp_path / "in"), sent.schema), labels, "doc_id")
    want = rows(exclude_ids(sent, labels, "doc_id"), "doc_id")
    assert rows(run(spark, guarded, tmp_path, "kept"), "doc_id") == want and None in [r[0] for r in want]
