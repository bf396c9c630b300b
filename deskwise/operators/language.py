"""Language by naive Bayes over character trigrams, as tables: no hashing, so no two trigrams share a weight."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskwise.functions import text as tx
from deskwise.functions.columns import let
from deskwise.operators.features import counted
from deskwise.operators.joins import lookup_join
from deskwise.session import materialize


def trigrams(text: Column | str, n: int = 3) -> Column:
    """Overlapping character n-grams of the whole lower-cased text; a shorter text has none."""

    def of(chars: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(chars) - n)
        grams = F.transform(starts, lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)]))
        return F.when(F.size(chars) >= n, grams).otherwise(F.array().cast("array<string>"))

    low = tx.squeeze_space(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))))
    return let(F.split(low, ""), of)


@dataclass(frozen=True)
class LanguageTables:
    """``langs``: languages in order; ``priors``: one row, log priors and log weights of an unseen trigram;
    ``weights``: t, w (log likelihoods in the order of ``langs``)."""

    langs: list[str]
    priors: DataFrame
    weights: DataFrame


def counted_rows(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """Stored: row number, kept columns and the counted trigrams of every text."""
    rows = df.select(*keep, counted(trigrams(text)).alias("e"))
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()), "trigrams")


def fit(rows: DataFrame, lang: str, alpha: float = 1.0) -> LanguageTables:
    """Log priors and smoothed log likelihoods from :func:`counted_rows`; rows without a language are left out.

    Counts are combined in the tasks that read the texts. One row a language reaches the driver; the weights,
    one row a trigram, stay a table.
    """
    known = rows.where(F.col(lang).isNotNull())
    counts = known.select(lang, F.inline("e")).groupBy(F.col("term").alias("t"), lang).agg(F.sum("tf").alias("c"))
    counts = materialize(counts, "trigram-counts")
    docs = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}
    langs = sorted(docs)
    totals = {r[0]: r[1] for r in counts.groupBy(lang).agg(F.sum("c")).collect()}
    size = counts.select("t").distinct().count()
    room = [float(totals.get(x, 0)) + alpha * size for x in langs]
    c = [F.coalesce(F.max(F.when(F.col(lang) == x, F.col("c"))), F.lit(0)) for x in langs]
    weights = counts.groupBy("t").agg(F.array(*[F.log((n + alpha) / r) for n, r in zip(c, room, strict=True)]).alias("w"))
    whole = float(sum(docs.values()))
    one = rows.sparkSession.range(1).select(
        F.array(*[F.log(F.lit(docs[x] / whole)) for x in langs]).alias("prior"), F.array(*[F.log(F.lit(alpha / r)) for r in room]).alias("unseen")
    )
    return LanguageTables(langs, one, materialize(weights, "trigram-weights"))


def detect(tables: LanguageTables, rows: DataFrame, keep: Sequence[str], decimals: int = 6) -> DataFrame:
    """``keep``, detected_lang (ties: first) and p, the rounded posteriors in the order of ``tables.langs``, by log-sum-exp.

    A text without trigrams has the priors. Sums are taken per row number, partly in the tasks that hold the row.
    """
    k = len(tables.langs)
    entries = rows.select("row", F.inline("e"))
    joined = lookup_join(entries, "term", tables.weights, "t", "left").crossJoin(F.broadcast(tables.priors.select("unseen")))
    sums = [F.sum(F.col("tf") * F.coalesce(F.col("w")[i], F.col("unseen")[i])).alias(f"s{i}") for i in range(k)]
    scored = rows.drop("e").join(joined.groupBy("row").agg(*sums), "row", "left").crossJoin(F.broadcast(tables.priors.select("prior")))
    logs = F.array(*[F.col("prior")[i] + F.coalesce(f"s{i}", F.lit(0.0)) for i in range(k)])
    scored = scored.select(*keep, logs.alias("l"))
    top = F.array_max("l")
    total = F.aggregate("l", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("l")))
    names = F.array(*[F.lit(x) for x in tables.langs])
    return scored.select(
        *keep, F.element_at(names, F.array_position("l", top).cast("int")).alias("detected_lang"),
        let(total, lambda n: F.transform("l", lambda x: F.round(F.exp(x - F.array_max("l")) / n, decimals))).alias("p"),
    )
