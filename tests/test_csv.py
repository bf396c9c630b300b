from pyspark.sql import types as T

from deskwise.sources import tables as src

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.DoubleType())])


def test_byte_order_mark(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", é'), (2, None), (3, "line\nbreak")], "id long, text string").coalesce(1)
    for bom in (True, False):
        path = tmp_path / str(bom)
        src.write_table(df, str(path), "csv", bom=bom)
        raw = next(path.glob("part-*.csv")).read_bytes()
        assert raw.startswith(b"\xef\xbb\xbfid,text") == bom and raw.count(b"\xef\xbb\xbf") == bom
        back = src.read_table(spark, str(path), ["id", "text"])
        assert sorted(map(tuple, back.collect())) == [("1", 'say "hi", é'), ("2", None), ("3", "line\nbreak")]


def test_malformed_records_are_kept_apart(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text,score\n1,"a, b",0.5\n2,few\n3,many,1.0,more\nx,bad id,1\n5,bad score,high\n6,,\n,,\n7,"say ""hi""",1e3\n')
    good, bad = src.read_checked(spark, str(tmp_path / "a.csv"), SCHEMA)
    assert good.schema == SCHEMA
    assert sorted(map(tuple, good.collect()), key=repr) == sorted([(1, "a, b", 0.5), (6, None, None), (None, None, None), (7, 'say "hi"', 1000.0)], key=repr)
    found = {r.record: r.reason for r in bad.collect()}
    assert found["2,few"] == found["3,many,1.0,more"] == "number of fields"
    assert {v for k, v in found.items() if "bad id" in k} == {"id is not bigint"} and {v for k, v in found.items() if "bad score" in k} == {"score is not double"}
    assert len(found) == 4 and all(r.file.endswith("a.csv") and r.split_start == 0 for r in bad.collect())


def test_round_trip_of_a_table(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    src.write_table(docs, str(tmp_path / "out"), "csv", bom=True)
    good, bad = src.read_checked(spark, str(tmp_path / "out"), docs.schema, multi_line=True)
    assert bad.count() == 0 and sorted(map(tuple, good.collect())) == sorted(map(tuple, docs.collect()))
