import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from deskwise.llm import pii
from test_native import brute_contamination
from test_simhash import brute_fp, classes

FOLDER = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "PII", "BPE encoding and decoding"]

    good = stages["quality classifier"](spark, docs, FOLDER).collect()
    kept = {r.doc_id for r in good}
    assert all(labels[i] == (i in kept) for i in labels)

    good = spark.createDataFrame(good, docs.schema)
    unique = stages["SimHash near-dedup"](spark, good, FOLDER)
    fps = {r.doc_id: brute_fp(r.text) for r in good.collect()}
    tied, least = classes(set(fps.values())), {}
    for i, f in fps.items():
        least[tied[f]] = min(least.get(tied[f], i), i)
    assert sorted(r.doc_id for r in unique.collect()) == sorted(least.values())

    clean = stages["benchmark decontamination"](spark, unique, FOLDER).collect()
    assert sorted(r.doc_id for r in clean) == sorted(r.doc_id for r in unique.collect() if not brute_contamination(r.text, items)[4])

    masked = stages["PII"](spark, spark.createDataFrame(clean, docs.schema), FOLDER)
    assert masked.columns == docs.columns and masked.count() == len(clean)
    assert all(not pii.base_spans(r.text) and r.n_chars == len(r.text) for r in masked.collect())
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in masked.collect()}
    coded = stages["BPE encoding and decoding"](spark, masked, FOLDER).collect()
    assert len(coded) == len(clean)
    for r in coded:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)


def test_stages_take_odd_tables(spark, hostile, empty):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, columns named like inner ones; nothing at all."""
    kinds = {"quality classifier": None, "SimHash near-dedup": 7, "benchmark decontamination": None, "PII": 14}
    for name, stage in corpus_pipeline.STAGES:
        for table in (hostile, empty):
            docs = table.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.lit(None).cast("long")})
            rows = stage(spark, docs, FOLDER).collect()
            if table is empty:
                assert not rows, name
            elif name in kinds:
                assert set(rows[0].asDict()) == set(corpus_pipeline.COLUMNS) and len(rows) <= 14, name
            else:
                assert len(rows) == 14 and {r.n_tokens for r in rows if r.doc_id in (2, 3)} == {0}
            if name == "SimHash near-dedup" and rows:
                assert len({brute_fp(r.text) for r in rows}) == len(rows) == len({find for find in classes({brute_fp(r.text) for r in hostile.collect()}).values()})
            if name == "PII" and rows:
                assert len(rows) == 14 and not any(pii.base_spans(r.text or "") for r in rows)


def test_registered_names():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 14)] and "pipeline" in entry.queries()
