"""Corpus preparation: cleaned pairs, labelling samples, training sets and retrieval history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from deskwise.config import TriageConfig
from deskwise.functions import text as tx
from deskwise.functions.columns import compute_once
from deskwise.operators import curation as cu
from deskwise.operators import guards, ranking
from deskwise.operators.features import fit_tfidf, with_terms
from deskwise.operators.models import kmeans, language_probability
from deskwise.session import materialize

PAIR = ("customer_message", "agent_response")


def clean_pairs(
    pairs: DataFrame,
    order: Sequence[str],
    profile: str = "strict",
    min_chars: int = 10,
    english: float | None = 0.80,
    language_model: PipelineModel | None = None,
) -> DataFrame:
    """Raw pairs to cleaned, distinct, English pairs.

    Row filters commute with the keep-first de-duplication, because equal pairs pass or fail
    together; all of them run before the only shuffle, the language test last as the dearest. A
    second de-duplication has nothing left to remove and is not made. English is told by the
    share of function words, or by ``language_model`` (see ``models.fit_language``), which then
    only sees the distinct pairs that are left.
    """
    a, b = PAIR
    df = pairs.dropna(subset=list(PAIR))
    df = cu.clean_columns(df, PAIR, profile)
    df = cu.non_empty(df, a, b)
    df = cu.min_length(df, PAIR, min_chars)
    df = cu.drop_acknowledgements(df, a)
    if english is not None and language_model is None:
        df = cu.keep_language(df, PAIR, "en", english)
    df = cu.dedupe_first(df, PAIR, order)
    if english is not None and language_model is not None:
        for c in PAIR:
            scored = language_probability(language_model, df, c, out="__english")
            df = scored.where(F.col("__english") >= english).drop("__english", "detected_lang")
    return df


def cleaning_funnel(pairs: DataFrame, profile: str = "strict", min_chars: int = 10, english: float = 0.80) -> DataFrame:
    """Rows left after every cleaning step, from one scan and one shuffle.

    Per distinct cleaned pair the number of copies and the row-local flags are kept; a step before
    the de-duplication counts copies, a later one counts distinct pairs. Pairs are grouped by
    digest, so the shuffle carries flags and counts but no text.
    """
    a, b = PAIR
    whole = F.col(a).isNotNull() & F.col(b).isNotNull()
    cleaned = cu.clean_columns(pairs.select(*PAIR, whole.alias("full")), PAIR, profile)
    filled = F.col("full") & (F.col(a) != "") & (F.col(b) != "")
    long = (F.length(a) >= min_chars) & (F.length(b) >= min_chars)
    wordy = ~tx.is_acknowledgement(a)
    speaks = (tx.language_share(a) >= english) & (tx.language_share(b) >= english)
    # The step a row gets to; the language test only runs on what the cheap steps leave over.
    step = (
        F.when(~F.col("full"), 1).when(~filled, 2).when(~long, 4).when(~wordy, 5).when(~speaks, 6).otherwise(7)
    )
    per_pair = (
        cleaned.select(tx.digest(a, b).alias("k"), step.alias("step"))
        .groupBy("k", "step")
        .agg(F.count(F.lit(1)).alias("n"))
    )

    def rows(least: int):
        return F.coalesce(F.sum(F.when(F.col("step") >= least, F.col("n"))), F.lit(0))

    def distinct(least: int):
        return F.count_if(F.col("step") >= least)

    one = per_pair.agg(
        rows(1).alias("1 input"),
        rows(2).alias("2 not null"),
        rows(4).alias("3 not empty"),
        distinct(4).alias("4 distinct"),
        distinct(5).alias("5 long enough"),
        distinct(6).alias("6 not an acknowledgement"),
        distinct(7).alias("7 english"),
    )
    return one.unpivot([], one.columns, "step", "n_rows")


def write_clean_pairs(
    pairs: DataFrame, order: Sequence[str], path: str, profile: str = "strict", min_chars: int = 10, english: float = 0.80
) -> dict[str, int]:
    """Write what :func:`clean_pairs` keeps and return the figures of :func:`cleaning_funnel`, from that one job.

    Rows are observed as they flow by, once before the de-duplication and once behind it. Here it comes before the tests that
    follow it in the funnel, which is the same result: equal pairs pass or fail together.
    """
    a, b = PAIR
    before, after = Observation("cleaned"), Observation("distinct")
    whole = F.col(a).isNotNull() & F.col(b).isNotNull()
    cleaned = cu.clean_columns(pairs.withColumn("__full", whole), PAIR, profile)
    filled = F.col("__full") & (F.col(a) != "") & (F.col(b) != "")
    counts = [F.count(F.lit(1)).alias("1 input"), F.count_if("__full").alias("2 not null"), F.count_if(filled).alias("3 not empty")]
    distinct = cu.dedupe_first(cleaned.observe(before, *counts).where(filled).drop("__full"), PAIR, order)
    long = (F.length(a) >= min_chars) & (F.length(b) >= min_chars)
    speaks = (tx.language_share(a) >= english) & (tx.language_share(b) >= english)
    # The step a pair gets to; the language test only runs on what the cheap tests leave over.
    step = F.when(~long, 4).when(tx.is_acknowledgement(a), 5).when(~speaks, 6).otherwise(7)
    judged = compute_once(distinct, {"__step": step})
    names = {4: "4 distinct", 5: "5 long enough", 6: "6 not an acknowledgement", 7: "7 english"}
    judged = judged.observe(after, *[F.count_if(F.col("__step") >= k).alias(n) for k, n in names.items()])
    judged.where("__step = 7").drop("__step").write.parquet(path)
    return {**before.get, **after.get}


def discover_intents(
    messages: DataFrame,
    order: Sequence[str],
    message: str = "customer_message",
    k: int = 12,
    restarts: int = 10,
    seed: int = 42,
    min_df: int = 3,
    max_features: int = 5000,
) -> DataFrame:
    """Distinct messages with a ``cluster``: TF-IDF of 1- and 2-grams, then k-means."""
    distinct = cu.dedupe_first(messages.dropna(subset=[message]), [message], order)
    ready = with_terms(distinct.withColumn("__text", tx.clean_for_clustering(message)), "__text")
    # The vocabulary pass, the ten k-means runs and the final assignment all start here.
    ready = materialize(ready.drop("__text"), "terms")
    features = fit_tfidf(ready, min_df=min_df, max_features=max_features).transform(ready)
    model = kmeans(features, k=k, restarts=restarts, seed=seed)
    drop = ("terms", "__counts", "__weighted", "features")
    return model.transform(features).drop(*drop)


def cluster_report(clustered: DataFrame, order: str, message: str, n: int = 10) -> DataFrame:
    """Size of every cluster and its first ``n`` messages."""
    sizes = clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("cluster_size"))
    first = cu.first_rows(clustered.select("cluster", order, message), ["cluster"], [order], n)
    return first.join(sizes, "cluster")


def labelling_sample(
    clustered: DataFrame, golden: DataFrame, key: str, per_cluster: int = 50, seed: int = 42
) -> DataFrame:
    """Up to ``per_cluster`` rows per cluster without golden ids, shuffled, with empty label columns."""
    free = guards.exclude_ids(clustered, golden, key)
    picked = ranking.stratified_sample(free, ["cluster"], per_cluster, seed, key)
    mixed = ranking.shuffled(picked, seed + 1, key)
    return cu.blank_columns(mixed, ["intent", "notes"])


TRAINING = ("message_id", "customer_message", "intent", "confidence", "reason")


def combined_training(verified: DataFrame, selected: DataFrame, golden: DataFrame, order: str) -> DataFrame:
    """Reviewed rows first, then selected ones; golden ids out, one row per id and per message."""
    verified = verified.withColumnRenamed("corrected_intent", "intent").select(*TRAINING, order)
    parts = [
        guards.exclude_ids(p, golden, "message_id")
        for p in (verified, selected.select(*TRAINING, order))
    ]
    merged = cu.union_by_priority(*parts)
    return cu.dedupe_chain(merged, [["message_id"], ["customer_message"]], ["priority", order])


def retrieval_history(pairs: DataFrame, golden: DataFrame, cfg: TriageConfig, pos: str) -> DataFrame:
    """Pairs that may be retrieved; golden examples never enter.

    The whole table is read unless ``history_limit`` is set. Runtime cleans and filters first, excludes golden
    ids, then keeps the first ``history_limit`` rows; batch takes the first rows as they are, only strips,
    and excludes golden messages. Both de-duplicate messages last, so fewer rows may remain.
    """
    a, b = PAIR
    if cfg.profile == "runtime":

        def keep(rows: DataFrame) -> DataFrame:
            rows = cu.non_empty(cu.clean_columns(rows, PAIR, "runtime"), a, b)
            return guards.exclude_ids(rows, golden, "message_id")

        bounded = cfg.history_limit is not None
        kept = ranking.first_n_kept(pairs, pos, cfg.history_limit, keep) if bounded else keep(pairs)
        return cu.dedupe_first(kept, [a], [pos])
    df = pairs if cfg.history_limit is None else ranking.first_n(pairs, pos, cfg.history_limit)
    df = df.dropna(subset=list(PAIR))
    df = df.withColumns({c: tx.strip(c) for c in PAIR})
    return guards.exclude_messages(cu.dedupe_first(df, [a], [pos]), golden, a)
