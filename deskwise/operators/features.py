"""TF-IDF features, language features and the text encoder."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import (
    IDF,
    NGram,
    CountVectorizerModel,
    ElementwiseProduct,
    HashingTF,
    Normalizer,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskwise.functions import text as tx
from deskwise.functions.columns import compute_once, let
from deskwise.functions.lexicon import FUNCTION_WORDS
from deskwise.operators.joins import lookup_join
from deskwise.operators.ranking import hash_rank, sample_key
from deskwise.session import materialize

ENGLISH = FUNCTION_WORDS["en"]


def with_terms(
    df: DataFrame, text: str, stop_words: Sequence[str] = ENGLISH, bigrams: bool = True, out: str = "terms"
) -> DataFrame:
    """Array of unigrams (and bigrams of what the stop list leaves over) per row."""
    words = tx.tokens(text, stop_words)
    return compute_once(df, {out: let(words, tx.with_bigrams) if bigrams else words})


def term_counts(df: DataFrame, terms: str = "terms") -> DataFrame:
    """term, df and corpus frequency cf; the row without a term carries the number of documents.

    One exploded pass with map-side combine gives all three.
    """
    entry = "array<struct<t: string, c: int, d: int>>"
    terms = F.coalesce(terms, F.array().cast("array<string>"))
    entries = F.concat(
        F.transform(terms, lambda t: F.struct(t.alias("t"), F.lit(1).alias("c"), F.lit(0).alias("d"))),
        F.transform(
            F.array_distinct(terms), lambda t: F.struct(t.alias("t"), F.lit(0).alias("c"), F.lit(1).alias("d"))
        ),
        F.array(F.struct(F.lit(None).alias("t"), F.lit(0).alias("c"), F.lit(1).alias("d"))).cast(entry),
    )
    return (
        df.select(F.explode(entries).alias("e"))
        .groupBy(F.col("e.t").alias("term"))
        .agg(F.sum("e.d").alias("df"), F.sum("e.c").alias("cf"))
    )


def commonest(counts: DataFrame, min_df: int, max_features: int) -> DataFrame:
    """The ``max_features`` commonest terms (ties by term), with the number of documents ``n``.

    The limit bounds every later broadcast. The documents' row comes along under the same limit,
    so that ``counts`` is computed once.
    """
    marker = F.col("term").isNull()
    top = counts.where(marker | (F.col("df") >= min_df))
    top = top.orderBy(marker.desc(), F.desc("cf"), F.asc("term")).limit(max_features + 1)
    n = F.max(F.when(marker, F.col("df"))).over(Window.partitionBy(F.lit(0)))
    return top.withColumn("n", n).where(~marker)


def vocabulary(
    df: DataFrame, terms: str = "terms", min_df: int = 3, max_features: int | None = 5000
) -> DataFrame:
    """term, df and corpus frequency of the commonest terms; of all terms where ``max_features`` is None."""
    if max_features is None:
        return term_counts(df, terms).where(F.col("term").isNotNull() & (F.col("df") >= min_df))
    return commonest(term_counts(df, terms), min_df, max_features).drop("n")


def _of_unit_length(entries: str, name: str) -> Column:
    """Entries (name, w) of a document as (name, tfidf). The length is taken once, not beside every entry."""
    length = F.sqrt(F.aggregate(entries, F.lit(0.0), lambda total, e: total + e["w"] * e["w"]))
    scaled = lambda n: F.transform(entries, lambda e: F.struct(e[name].alias(name), (e["w"] / n).alias("tfidf")))
    return let(length, scaled)


def tfidf_long(
    df: DataFrame,
    id_col: str,
    terms: str = "terms",
    min_df: int = 3,
    max_features: int | None = 5000,
    sublinear: bool = False,
) -> DataFrame:
    """(id, term, tfidf) with idf = ln((1+n)/(1+df)) + 1 and unit length per document.

    ``max_features`` keeps that many of the commonest terms; None keeps all, see :func:`tfidf_unbounded`.

    Only the vocabulary pass shuffles, and it moves counted terms. The terms of a document are counted, weighted
    and scaled where the document lies; the names, at most ``max_features`` rows, are broadcast.
    """
    if max_features is None:
        return tfidf_unbounded(df, id_col, terms, min_df, sublinear)
    df = materialize(df.select(id_col, terms), "terms")  # the vocabulary and the weights both read them
    try:
        stages = fit_tfidf(df, terms, "__unit", min_df, max_features).stages
    except EmptyVocabulary:
        return df.select(id_col, F.lit("").alias("term"), F.lit(0.0).alias("tfidf")).where(F.lit(False))
    rows = stages[0].transform(df.select(id_col, F.coalesce(terms, F.array().cast("array<string>")).alias(terms)))
    rows = stages[-2].transform(rows)
    counts, weighted = F.unwrap_udt("__counts"), F.unwrap_udt("__weighted")
    rows = rows.select(id_col, counts["indices"].alias("i"), counts["values"].alias("tf"), weighted["values"].alias("w"))

    def weight(e: Column) -> Column:
        return (e["w"] * (F.log(e["tf"]) + 1) / e["tf"] if sublinear else e["w"]).alias("w")

    rows = rows.select(id_col, F.transform(F.arrays_zip("i", "tf", "w"), lambda e: F.struct(e["i"].alias("i"), weight(e))).alias("e"))
    rows = rows.select(id_col, F.inline(_of_unit_length("e", "i")))
    names = F.broadcast(df.sparkSession.createDataFrame(list(enumerate(stages[0].vocabulary)), "i int, term string"))
    return rows.join(names, "i").select(id_col, "term", "tfidf")


def counted(terms: Column | str) -> Column:
    """Distinct terms of an array in order, as (term, tf); sorted and counted where the row lies."""

    def runs(ordered: Column) -> Column:
        n = F.size(ordered)
        places = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))

        def entries(starts: Column) -> Column:
            return F.transform(
                starts, lambda i, at: F.struct(F.get(ordered, i).alias("term"), (F.coalesce(F.get(starts, at + 1), n) - i).alias("tf"))
            )

        return F.when(n == 0, F.array().cast("array<struct<term: string, tf: int>>")).otherwise(let(places, entries))

    return let(F.array_sort(F.coalesce(terms, F.array().cast("array<string>"))), runs)


def term_ids(counts: DataFrame, name: str = "term_id") -> DataFrame:
    """Gapless ids from 0 for a vocabulary of any size, in the order of the terms' md5.

    Ids are a hash bucket's offset and the place inside it, so no task sorts the vocabulary and the driver
    sees bucket counts only.
    """
    ranked = hash_rank(materialize(counts, "vocabulary"), sample_key(0, "term"), name=name)
    return ranked.withColumn(name, F.col(name).cast("bigint") - 1)


def tfidf_unbounded(df: DataFrame, id_col: str, terms: str = "terms", min_df: int = 3, sublinear: bool = False) -> DataFrame:
    """:func:`tfidf_long` over every term of ``min_df`` documents or more, however many there are.

    Terms are counted in their documents and stored; texts are read once. Weights are joined by term: broadcast while
    they are few, else shuffled, a frequent term's rows dealt to as many tasks as its document frequency asks for.
    What comes together in one task is a document.
    """
    rows = df.select(F.col(id_col).alias("id"), counted(F.col(terms)).alias("e"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "counted-terms")
    entries = rows.select("row", "id", F.inline("e"))
    found = entries.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
    total = rows.agg(F.count(F.lit(1)).alias("n"))  # one row
    idf = (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")
    weights = materialize(found.crossJoin(F.broadcast(total)).select(F.col("term").alias("t"), "df", idf), "term-weights")
    joined = lookup_join(entries, "term", weights.select("t", "idf"), "t", "inner", weights.select("t", "df"))
    tf = F.log("tf") + 1 if sublinear else F.col("tf")
    per_row = joined.groupBy("row", "id").agg(F.collect_list(F.struct("term", (tf * F.col("idf")).alias("w"))).alias("e"))
    return per_row.select(F.col("id").alias(id_col), F.inline(_of_unit_length("e", "term")))


class EmptyVocabulary(ValueError):
    """No term occurs in enough documents."""


class SublinearTf(
    Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable
):
    """Term counts to ``1 + ln(count)``, entry by entry of a sparse vector."""

    def __init__(self, inputCol: str = "counts", outputCol: str = "sublinear"):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        damp = F.udf(lambda v: Vectors.sparse(v.size, v.indices, 1 + np.log(v.values)), VectorUDT(), useArrow=True)
        return dataset.withColumn(self.getOutputCol(), damp(self.getInputCol()))


def fit_tfidf(
    df: DataFrame,
    terms: str = "terms",
    out: str = "features",
    min_df: int = 3,
    max_features: int = 5000,
    sublinear: bool = False,
) -> PipelineModel:
    """Row-local TF-IDF transformer for Spark ML; only the vocabulary pass shuffles.

    The vocabulary (bounded by ``max_features``) is fixed first, with a deterministic tie rule;
    the weights ``idf = ln((1+n)/(1+df)) + 1`` follow from it without a second pass.
    """
    rows = commonest(term_counts(df, terms), min_df, max_features).collect()
    if not rows:
        raise EmptyVocabulary("empty vocabulary: lower min_df")
    n_docs = rows[0]["n"]
    counts = CountVectorizerModel.from_vocabulary([r["term"] for r in rows], terms, "__counts")
    idf = [math.log((1 + n_docs) / (1 + r["df"])) + 1 for r in rows]
    tf = [SublinearTf("__counts", "__tf")] if sublinear else []
    scale = ElementwiseProduct(
        scalingVec=Vectors.dense(idf), inputCol="__tf" if sublinear else "__counts", outputCol="__weighted"
    )
    unit = Normalizer(p=2.0, inputCol="__weighted", outputCol=out)
    return PipelineModel(stages=[counts, *tf, scale, unit])


def hashed_encoder(df: DataFrame, text: str, dims: int = 256, out: str = "embedding") -> PipelineModel:
    """Offline stand-in for a sentence encoder: hashed TF-IDF of unit length.

    Any producer of a unit-length ``embedding`` column can take its place, see
    :func:`encode_with`.
    """
    terms = with_terms(df, text, (), False, "__terms")
    pipeline = Pipeline(
        stages=[
            HashingTF(numFeatures=dims, inputCol="__terms", outputCol="__tf"),
            IDF(inputCol="__tf", outputCol="__idf"),
            Normalizer(p=2.0, inputCol="__idf", outputCol="__unit"),
        ]
    )
    return pipeline.fit(terms)


def encode_hashed(model: PipelineModel, df: DataFrame, text: str, out: str = "embedding") -> DataFrame:
    encoded = model.transform(with_terms(df, text, (), False, "__terms"))
    return encoded.withColumn(out, vector_to_array("__unit", "float32")).drop(
        "__terms", "__tf", "__idf", "__unit"
    )


def encode_with(df: DataFrame, text: str, load_model, out: str = "embedding") -> DataFrame:
    """Encode with a model: ``load_model()`` returns ``texts -> (n, d) matrix``.

    It is called once per task, and texts arrive in Arrow batches.
    """
    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()
        for texts in batches:
            yield pd.Series([v.astype("float32") for v in model(texts.fillna("").tolist())])

    return df.withColumn(out, encode(F.col(text)))


def word_counter(dims: int = 64) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """Offline model for :func:`encode_with`: counts of space-separated words, of unit length.

    A word's place is the first 28 bits of its md5 modulo ``dims``, the same on every engine. A text without
    words is the zero vector.
    """

    def load():
        @lru_cache(1 << 18)
        def place(word: str) -> int:
            return int(hashlib.md5(word.encode()).hexdigest()[:7], 16) % dims

        def model(texts: list[str]) -> np.ndarray:
            counts = np.zeros((len(texts), dims))
            for row, text in zip(counts, texts, strict=True):
                row += np.bincount([place(w) for w in text.split()], minlength=dims)
            return counts / np.sqrt(np.maximum((counts * counts).sum(axis=1, keepdims=True), 1))

        return model

    return load


def char_ngrams(df: DataFrame, text: str, n: int = 3, out: str = "grams") -> DataFrame:
    """Overlapping character n-grams of the whole lower-cased text."""
    low = tx.squeeze_space(F.lower(F.coalesce(F.col(text), F.lit(""))))
    empty = F.array().cast("array<string>")
    chars = F.when(F.col("__low") == "", empty).otherwise(F.split("__low", ""))
    split = compute_once(df, {"__low": low}).withColumn("__chars", chars)
    return NGram(n=n, inputCol="__chars", outputCol=out).transform(split).drop("__low", "__chars")
