"""The registered queries opN_* and ``pipeline``, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_pipeline import run as pipeline
from deskwise.llm import bpe, clusters, decontaminate, minhash, pii, quality, shards, simhash, tokens, toxicity, weak_rules, whitening, wrappers
from deskwise.llm.sql import ORACLE
from deskwise.session import materialize, tables


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    return quality.classify(t("documents"), t("labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir)("documents")
    counts = tokens.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tables(spark, sf_dir)("pages")
    return wrappers.main_texts(pages, materialize(wrappers.infer_wrappers(pages), "wrappers"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    return decontaminate.contamination(t("documents"), t("benchmark")).drop("digest")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir)("documents")
    encoded = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), decoded=True)
    return encoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    return toxicity.classify(t("documents"), t("labels"))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_rows(tables(spark, sf_dir)("documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"]
    return weak_rules.judge(tables(spark, sf_dir)("documents")).select(*kept)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(tables(spark, sf_dir)("documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir)("documents")
    return pii.digest(pii.find(docs, pii.fit(docs)))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(tables(spark, sf_dir)("documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(tables(spark, sf_dir)("embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(tables(spark, sf_dir)("embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_token_counts": op2_token_counts,
    "op3_main_text": op3_main_text,
    "op4_decontaminate": op4_decontaminate,
    "op5_bpe": op5_bpe,
    "op6_toxicity": op6_toxicity,
    "op7_shards": op7_shards,
    "op8_quality_rules": op8_quality_rules,
    "op9_simhash": op9_simhash,
    "op10_pii": op10_pii,
    "op11_minhash": op11_minhash,
    "op12_centroids": op12_centroids,
    "op13_whitening": op13_whitening,
    "pipeline": pipeline,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
