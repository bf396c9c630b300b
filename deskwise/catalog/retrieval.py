"""Vector retrieval, re-ranking and its evaluation.

The embeddings play both parts: every vector is a query against all others (its own id is
excluded, the leakage guard), and intents are predicted by leave-one-out class centroids.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from deskwise.catalog import sql as s
from deskwise.catalog.registry import query
from deskwise.config import BATCH
from deskwise.functions import lexicon as lx
from deskwise.functions import vectors as vx
from deskwise.operators import metrics, models, quantised
from deskwise.operators import retrieval as rt
from deskwise.plans.triage import retrieve_cases


def intents(t):
    """Vectors with the intent their label stands for."""
    names = F.array(*[F.lit(i) for i in lx.INTENTS])
    return t("embeddings").select(
        "vec_id", F.element_at(names, F.col("label") + 1).alias("true_intent"), "embedding"
    )


def predicted(t):
    """Leave-one-out prediction for every vector."""
    rows = intents(t)
    scored = models.centroid_scores(rows, models.centroids(rows, "true_intent"), own_label="true_intent")
    return models.centroid_predict(scored)


def sides(t):
    """(queries, history) for retrieval: the same vectors in both roles."""
    rows = predicted(t)
    history = rows.select(
        F.col("vec_id").alias("history_id"), "embedding",
        F.col("predicted_intent").alias("intent"), F.col("confidence").alias("intent_confidence"),
    )
    return rows.withColumnRenamed("vec_id", "query_id"), history


def cases(t, **options):
    queries, history = sides(t)
    found = retrieve_cases(queries, history, BATCH, True, ("intent_confidence",), **options)
    truth = queries.select("query_id", "true_intent")
    return found.join(truth, "query_id").withColumn("match", F.col("intent") == F.col("true_intent"))


_CASE_COLUMNS = (
    "query_id", "rank", "history_id", "similarity", "score", "intent", "intent_confidence",
    "intent_match", "semantic_rank",
)
CASE_SQL = s.ctes(*s.RETRIEVE)
LONG = "m AS (SELECT *, intent = true_intent AS match FROM cases)"
LONG_SQL = s.ctes(*s.RETRIEVE, LONG)


def as_bigint(df, *columns):
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})


@query("l2_normalize", """
SELECT vec_id, round(list_dot_product(e, c), 6) AS dot_with_copy, round(sqrt(list_dot_product(e, e)), 6) AS length
FROM (SELECT vec_id, [x * 3::DOUBLE / sqrt(list_dot_product([y * 3::DOUBLE for y in v], [y * 3::DOUBLE for y in v])) for x in v] AS e, v AS c
      FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings))""")
def l2_normalize(t):
    tripled = F.transform("embedding", lambda x: x.cast("double") * 3)
    unit = t("embeddings").withColumn("u", vx.l2_normalize(tripled))
    return unit.select(
        "vec_id",
        F.round(vx.dot("u", "embedding"), 6).alias("dot_with_copy"),
        F.round(vx.norm("u"), 6).alias("length"),
    )


@query("cosine_to_centroid", s.ctes(s.VECTORS, s.CENTROIDS) + """
SELECT v.vec_id, round(list_dot_product(v.e, c.total) / sqrt(list_dot_product(c.total, c.total)), 6) AS cosine
FROM v JOIN cent c ON c.label = v.true_intent""")
def cosine_to_centroid(t):
    rows = intents(t)
    # One centroid per intent: the broadcast side is bounded by the intent list.
    classes = F.broadcast(models.centroids(rows, "true_intent").withColumnRenamed("label", "true_intent"))
    joined = rows.join(classes, "true_intent")
    return joined.select("vec_id", F.round(vx.dot("embedding", vx.l2_normalize("total")), 6).alias("cosine"))


@query("argmax_conf", s.ctes(*s.CLASSIFY) + "SELECT vec_id, true_intent, predicted_intent, confidence FROM pred")
def argmax_conf(t):
    return predicted(t).select("vec_id", "true_intent", "predicted_intent", "confidence")


_TOP50 = s.ctes(s.VECTORS, s.CANDIDATES) + "SELECT query_id, history_id, similarity, semantic_rank FROM cand"


def _top50(t, **options):
    rows = t("embeddings")
    found = rt.semantic_candidates(
        rows.select(F.col("vec_id").alias("query_id"), "embedding"),
        rows.select(F.col("vec_id").alias("history_id"), "embedding"),
        exclude_self=True, **options,
    )
    return as_bigint(found, "semantic_rank")


@query("semantic_top50", _TOP50)
def semantic_top50(t):
    return _top50(t)


@query("semantic_top50_grid", _TOP50)
def semantic_top50_grid(t):
    """The strategy for query sets too large to ship; small blocks, so that cells do get cut."""
    return _top50(t, strategy="grid", block_rows=256)


def _quantised_top50(t):
    rows = t("embeddings")
    index = quantised.index_quantised(rows.select(F.col("vec_id").alias("history_id"), "embedding"))
    return quantised.quantised_candidates(rows.select(F.col("vec_id").alias("query_id"), "embedding"), index, exclude_self=True)


@query("semantic_top50_pq")
def semantic_top50_pq(t):
    """Approximate: one byte for every two dimensions is scanned, 150 rows of a query are scored exactly."""
    return as_bigint(_quantised_top50(t), "semantic_rank")


@query("semantic_top50_pq_recall", s.ctes(s.VECTORS, s.CANDIDATES) + """
SELECT count(DISTINCT query_id) AS n_queries, count(*) AS n_true, true AS enough FROM cand""")
def semantic_top50_pq_recall(t):
    """At least 95 in a hundred of the exact rows are among the approximate ones."""
    found = quantised.recall(_quantised_top50(t), _top50(t))
    return found.select("n_queries", "n_true", (F.col("recall") >= 0.95).alias("enough"))


@query("retrieve_top5", CASE_SQL + f"SELECT {', '.join(_CASE_COLUMNS)} FROM cases")
def retrieve_top5(t):
    return as_bigint(cases(t).select(*_CASE_COLUMNS), "rank", "semantic_rank")


_WIDE = ("history_id", "intent", "intent_confidence", "similarity", "score", "intent_match")


@query("retrieved_wide", CASE_SQL + "SELECT query_id, " + ", ".join(
    f"max({f}) FILTER (rank = {r}) AS retrieved_{r}_{f}" for r in range(1, 6) for f in _WIDE
) + " FROM cases GROUP BY query_id")
def retrieved_wide(t):
    return rt.wide_cases(cases(t), _WIDE)


@query("wide_to_long", CASE_SQL + "SELECT query_id, rank::INTEGER AS rank, intent, similarity FROM cases")
def wide_to_long(t):
    wide = rt.wide_cases(cases(t), ("intent", "similarity"))
    return metrics.wide_to_long(wide, ["query_id"], ["intent", "similarity"])


@query("gather_cases", CASE_SQL + """
SELECT c.query_id, c.rank, c.history_id, d.text AS customer_message, d.source
FROM cases c LEFT JOIN documents d ON d.doc_id = c.history_id""")
def gather_cases(t):
    history = t("documents").select(
        F.col("doc_id").alias("history_id"), F.col("text").alias("customer_message"), "source"
    )
    found = rt.gather_cases(cases(t), history, ["customer_message", "source"])
    return as_bigint(found.select("query_id", "rank", "history_id", "customer_message", "source"), "rank")


@query("best_similarity", CASE_SQL + """SELECT query_id, max(similarity) FILTER (rank = 1) AS of_first,
max(similarity) AS of_best FROM cases GROUP BY query_id""")
def best_similarity(t):
    found = cases(t, stored=True)
    first, best = (rt.best_similarity(found, p) for p in ("runtime", "batch"))
    return first.withColumnRenamed("best_similarity", "of_first").join(
        best.withColumnRenamed("best_similarity", "of_best"), "query_id"
    )


# --- evaluation ----------------------------------------------------------------------------


@query("rank_consistency", LONG_SQL + """
SELECT rank, count(*) AS n_queries, round(avg(match::INTEGER), 6) AS consistency FROM m GROUP BY rank""")
def rank_consistency(t):
    out = metrics.rank_consistency(cases(t)).withColumn("consistency", F.round("consistency", 6))
    return as_bigint(out, "rank")


@query("topk_hit_rate", LONG_SQL + """, f AS (SELECT query_id, min(rank) FILTER (match) AS r FROM m GROUP BY query_id)
SELECT count(*) AS n_queries, """ + ", ".join(
    f"round(avg(coalesce(r <= {k}, false)::INTEGER), 6) AS top{k}" for k in (1, 3, 5)
) + " FROM f")
def topk_hit_rate(t):
    rates = metrics.hit_rates(metrics.first_match(cases(t)))
    return rates.withColumns({c: F.round(c, 6) for c in ("top1", "top3", "top5")})


@query("first_match_rank", LONG_SQL + "SELECT query_id, min(rank) FILTER (match) AS first_matching_rank FROM m GROUP BY query_id")
def first_match_rank(t):
    return as_bigint(metrics.first_match(cases(t)), "first_matching_rank")


@query("first_match_histogram", LONG_SQL + """, f AS (SELECT min(rank) FILTER (match) AS first_matching_rank FROM m GROUP BY query_id)
SELECT first_matching_rank, count(*) AS count FROM f WHERE first_matching_rank IS NOT NULL GROUP BY 1""")
def first_match_histogram(t):
    hist = metrics.frequency(metrics.first_match(cases(t)), "first_matching_rank", by="key")
    return as_bigint(hist, "first_matching_rank")


@query("any_match", LONG_SQL + "SELECT query_id, bool_or(match) FILTER (rank <= 3) AS in_top3, bool_or(match) AS in_top5 FROM m GROUP BY query_id")
def any_match(t):
    flags = rt.wide_cases(cases(t), ("match",))
    names = [f"retrieved_{r}_match" for r in range(1, 6)]
    return flags.select(
        "query_id", F.greatest(*names[:3]).alias("in_top3"), F.greatest(*names).alias("in_top5")
    )


@query("describe_similarity", CASE_SQL + """
SELECT rank, count(*) AS count, round(avg(similarity), 8) AS mean, round(stddev_samp(similarity), 8) AS std,
       min(similarity) AS min, round(quantile_cont(similarity, 0.25), 8) AS p25,
       round(quantile_cont(similarity, 0.5), 8) AS p50, round(quantile_cont(similarity, 0.75), 8) AS p75,
       max(similarity) AS max FROM cases GROUP BY rank""")
def describe_similarity(t):
    out = metrics.describe_scores(cases(t), "rank", "similarity")
    return as_bigint(out.withColumns({c: F.round(c, 8) for c in ("mean", "std", "p25", "p50", "p75")}), "rank")


@query("intent_retrieval_table", LONG_SQL + "SELECT true_intent, count(*) FILTER (rank = 1) AS support, " + ", ".join(
    f"round(avg(match::INTEGER) FILTER (rank = {r}), 6) AS top_{r}_intent_consistency" for r in range(1, 6)
) + " FROM m GROUP BY true_intent")
def intent_retrieval_table(t):
    out = metrics.intent_table(cases(t), "true_intent")
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.startswith("top_")})


_EXAMPLE = ("query_id", "true_intent", "intent", "similarity")


@query("retrieval_worst", LONG_SQL + f"SELECT {', '.join(_EXAMPLE)} FROM m WHERE rank = 1 AND NOT match ORDER BY query_id LIMIT 20")
def retrieval_worst(t):
    return metrics.retrieval_examples(cases(t), False, 20).select(*_EXAMPLE)


@query("retrieval_best", LONG_SQL + f"SELECT {', '.join(_EXAMPLE)} FROM m WHERE rank = 1 AND match ORDER BY query_id LIMIT 10")
def retrieval_best(t):
    return metrics.retrieval_examples(cases(t), True, 10).select(*_EXAMPLE)
