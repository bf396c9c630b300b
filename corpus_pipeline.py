"""From raw documents to token ids: quality, near-duplicates, benchmark passages, personal data, encoding.

Every stage works on all rows its predecessor kept. All but the last return the columns of ``documents``; other columns
go. A null or empty text is a text without words; a null id stays null. An empty table gives an empty table. What stages do
with repeated rows and ties is said at each.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskwise.llm import bpe, decontaminate, pii, quality, simhash
from deskwise.session import materialize, tables

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores 0.3 or more. The classifier learns from the labels of ``docs``.

    Without usable labels (none, or one class only) it has nothing to learn from and says so in its score, the same for
    all. Repeated rows are scored alike, so all of them stay or go.
    """
    docs = docs.select(*COLUMNS)
    return quality.keep_good(docs, quality.train(docs, tables(spark, sf_dir)("labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every SimHash component (four-word shingles, four bits), that of the smallest id.

    Of rows of one id the smallest text hash stays, of repeated rows one; a null id stays only where a component has no
    other. Texts without words share the fingerprint zero, so one of them stays.
    """
    return simhash.keep_one(docs.select(*COLUMNS), shingle=4, bits=4)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window (or whole shorter item) of the benchmark.

    A text without words has no window and stays; repeated rows stay or go together; an empty benchmark keeps all.
    """
    return decontaminate.keep_clean(docs.select(*COLUMNS), tables(spark, sf_dir)("benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; ``n_chars`` follows the text.

    No row goes, repeated ones neither. Of overlapping spans the one that begins first is masked whole.
    """
    docs = docs.select(*COLUMNS)
    return pii.redact(docs, pii.fit(docs)).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (packed unsigned 32-bit integers) and digests of ids and of what they decode to.

    One row per row, repeated ones too; a null or empty text has no ids.
    """
    encoded = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), decoded=True)
    decoded = F.sha2(F.col("decoded").cast("binary"), 256)
    return encoded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), decoded.alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", benchmark_stage),
    ("PII", pii_stage),
    ("BPE encoding and decoding", encoding_stage),
]

#: SQL has no rule ensemble, SimHash or BPE; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir)("documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
