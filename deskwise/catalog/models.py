"""Text features and trained models."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from deskwise.catalog import sql as s
from deskwise.catalog.corpus import docs, pairs
from deskwise.catalog.registry import query
from deskwise.catalog.retrieval import as_bigint, intents
from deskwise.catalog.triage import messages
from deskwise.config import BATCH
from deskwise.functions import text as tx
from deskwise.functions import vectors as vx
from deskwise.functions.lexicon import FUNCTION_WORDS
from deskwise.operators import embeddings, features, language, metrics, models, ranking
from deskwise.operators.selftrain import SelfTraining
from deskwise.plans import corpus, evaluation
from deskwise.plans import triage as plan
from deskwise.session import materialize, shared_dir

_WORDS = f"""words AS (SELECT doc_id, [w for w in regexp_extract_all(lower(clean), '[{s.W}]{{2,}}')
  if NOT list_contains({s.str_list(FUNCTION_WORDS['en'])}, w)] AS ws
  FROM (SELECT doc_id, {s.squeeze(s.sub('lower(text)', s.URL['cluster'], ' '))} AS clean FROM documents)),
uni AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM words),
terms AS (SELECT doc_id, w AS term FROM uni UNION ALL
  SELECT doc_id, w || ' ' || nxt FROM (SELECT doc_id, w, lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM uni)
  WHERE nxt IS NOT NULL)"""


def _tfidf_sql(min_df: int, size: int | None, weight: str) -> str:
    return s.ctes(_WORDS, f"""tf AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM terms GROUP BY ALL),
voc AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term HAVING count(*) >= {min_df}
        {f"ORDER BY cf DESC, term LIMIT {size}" if size else ""}),
raw AS (SELECT doc_id, term, {weight} * (ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + df)) + 1) AS w
        FROM tf JOIN voc USING (term))""") + """
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS tfidf FROM raw"""


def terms_of(t):
    cleaned = docs(t).select("doc_id", tx.clean_for_clustering("text").alias("clean"))
    return features.with_terms(cleaned, "clean").select("doc_id", "terms")


@query("tfidf_long", _tfidf_sql(3, 5000, "tf"))
def tfidf_long(t):
    return features.tfidf_long(terms_of(t), "doc_id").withColumn("tfidf", F.round("tfidf", 6))


@query("tfidf_sublinear", _tfidf_sql(2, 20000, "(1 + ln(tf))"))
def tfidf_sublinear(t):
    out = features.tfidf_long(terms_of(t), "doc_id", min_df=2, max_features=20000, sublinear=True)
    return out.withColumn("tfidf", F.round("tfidf", 6))


@query("vocabulary", s.ctes(_WORDS) + """
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM terms GROUP BY term
HAVING count(DISTINCT doc_id) >= 3 ORDER BY cf DESC, term LIMIT 5000""")
def vocabulary(t):
    return features.vocabulary(terms_of(t))


@query("tfidf_unbounded", _tfidf_sql(3, None, "tf"))
def tfidf_unbounded(t):
    """Every term of three documents or more has a weight."""
    return features.tfidf_long(terms_of(t), "doc_id", max_features=None).withColumn("tfidf", F.round("tfidf", 6))


@query("vocabulary_ids", s.ctes(_WORDS) + """
SELECT term, df, cf, row_number() OVER (ORDER BY md5('0|' || term)) - 1 AS term_id FROM (
  SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM terms GROUP BY term HAVING count(DISTINCT doc_id) >= 2)""")
def vocabulary_ids(t):
    """The whole vocabulary with gapless term ids."""
    return features.term_ids(features.vocabulary(terms_of(t), min_df=2, max_features=None))


@query("tfidf_vectors", s.ctes(_WORDS, """voc AS (SELECT term, sum(n) AS cf FROM (
  SELECT doc_id, term, count(*) AS n FROM terms GROUP BY ALL) GROUP BY term HAVING count(*) >= 3 ORDER BY cf DESC, term LIMIT 5000)""") + """
SELECT doc_id, (doc_id IN (SELECT doc_id FROM terms JOIN voc USING (term)))::INTEGER::DOUBLE AS length FROM documents""")
def tfidf_vectors(t):
    """Row-local TF-IDF vectors; their length is 1, or 0 for a document without known terms."""
    ready = terms_of(t)
    out = features.fit_tfidf(ready).transform(ready)
    values = vector_to_array("features")
    return out.select("doc_id", F.round(vx.norm(values), 6).alias("length"))


@query("kmeans_intents")
def kmeans_intents(t):
    """Clusters of the messages that the cleaning flow leaves."""
    clustered = corpus.discover_intents(corpus.clean_pairs(pairs(t), ["pos"]), ["message_id"])
    return clustered.select("message_id", F.col("cluster").cast("bigint").alias("cluster"))


@query("lr_predict")
def lr_predict(t):
    """Balanced multinomial regression on the embeddings: fit on 80 %, predict the other 20 %."""
    rows = ranking.stratified_split(intents(t), "true_intent", 0.2, 42, "vec_id")
    rows = models.to_vector(rows, "embedding")
    model = models.fit_classifier(rows.where("split = 'train'"), "features", "true_intent")
    out = models.predict(model, rows.where("split = 'test'"))
    return out.select("vec_id", "true_intent", "predicted_intent", F.round("confidence", 4).alias("confidence"))


def split_messages(t):
    """Every document as an encoded message, a fifth of each intent held out."""
    rows = materialize(messages(docs(t), t).drop("source"), "messages")
    return models.to_vector(ranking.stratified_split(rows, "true_intent", 0.2, 42, "query_id"), "embedding")


@query("lr_evaluation")
def lr_evaluation(t):
    """Guarded training rows, fit, prediction of the golden rows, report."""
    rows = split_messages(t)
    golden = rows.where("split = 'test'")
    train = evaluation.training_rows(rows, golden, "query_id", "customer_message", ["query_id"])
    report = evaluation.evaluate_classifier(train, golden, "features", "true_intent")["report"]
    return report.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("lr_triage")
def lr_triage(t):
    """The trained form of the flow: held-out messages are triaged against the training history."""
    rows = split_messages(t)
    model = models.fit_classifier(rows.where("split = 'train'"), "features", "true_intent")
    scored = models.predict(model, rows).drop("features", "probability")
    queries = scored.where("split = 'test'")
    history = scored.where("split = 'train'").select(
        F.col("query_id").alias("history_id"), "embedding",
        F.col("predicted_intent").alias("intent"), F.col("confidence").alias("intent_confidence"),
    )
    found = plan.retrieve_cases(queries, history, BATCH, carry=("intent_confidence",))
    out = plan.triage(queries, found, BATCH, keep=("true_intent",))
    return out.withColumns({c: F.round(c, 4) for c in ("confidence", "best_similarity")})


@query("lr_report")
def lr_report(t):
    """TF-IDF and regression with a stratified hold-out; the language is the class."""
    labelled = docs(t).select("doc_id", "lang", tx.clean_for_clustering("text").alias("clean"))
    ready = features.with_terms(labelled, "clean").drop("clean")
    rows = ranking.stratified_split(ready, "lang", 0.2, 42, "doc_id")
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    tfidf = features.fit_tfidf(train, min_df=2, max_features=20000, sublinear=True)
    model = models.fit_classifier(tfidf.transform(train), "features", "lang")
    scored = models.predict(model, tfidf.transform(test))
    report = metrics.class_report(metrics.pair_counts(scored, "lang", "predicted_intent"))
    return report.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("lang_model")
def lang_model(t):
    """English probability of both sides of every pair, from a model of the documents."""
    model = models.fit_language(docs(t).select("text", "lang"), "text", "lang")
    rows = pairs(t).select("message_id", "customer_message", "agent_response")
    rows = models.language_probability(model, rows, "customer_message", out="english_customer")
    rows = models.language_probability(model, rows.drop("detected_lang"), "agent_response", out="english_response")
    both = (F.col("english_customer") >= 0.8) & (F.col("english_response") >= 0.8)
    return rows.select(
        "message_id", *[F.round(c, 4).alias(c) for c in ("english_customer", "english_response")],
        both.alias("kept"),
    )


@query("clean_pairs_model")
def clean_pairs_model(t):
    """The cleaning flow with the trained language test instead of the function-word share."""
    model = models.fit_language(docs(t).select("text", "lang"), "text", "lang")
    return corpus.clean_pairs(pairs(t), ["pos"], language_model=model).select("message_id", *corpus.PAIR)


@query("encode_hash", f"""
SELECT doc_id, 256::BIGINT AS dims, (len(regexp_extract_all(lower(text), '[{s.W}]{{2,}}')) > 0)::INTEGER::DOUBLE AS length FROM documents""")
def encode_hash(t):
    rows = docs(t).select("doc_id", "text")
    model = features.hashed_encoder(rows, "text")
    out = features.encode_hashed(model, rows, "text")
    return as_bigint(
        out.select("doc_id", F.size("embedding").alias("dims"), F.round(vx.norm("embedding"), 4).alias("length")),
        "dims",
    )


QUOTA, LEAST, ROUNDS = 8, 0.15, 3


def _self_training_sql() -> str:
    """Three rounds one after another."""
    steps = [s.VECTORS, "seed AS (SELECT vec_id, true_intent AS label, e FROM v WHERE vec_id IN (SELECT doc_id FROM labels))"]
    for r in range(1, ROUNDS + 1):
        before = " UNION ALL ".join(["SELECT vec_id, label FROM seed", *(f"SELECT vec_id, label FROM acc{k}" for k in range(1, r))])
        steps.append(f"""known{r} AS ({before}),
sums{r} AS (SELECT label, i, sum(x) AS s FROM (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM known{r} JOIN v USING (vec_id)) GROUP BY ALL),
cent{r} AS (SELECT label, list(s ORDER BY i) AS total, (SELECT count(*) FROM known{r} k WHERE k.label = sums{r}.label) AS n FROM sums{r} GROUP BY label),
scores{r} AS (SELECT vec_id, label, round(list_dot_product(e, total) / n, 6) AS s
              FROM (SELECT * FROM v WHERE vec_id NOT IN (SELECT vec_id FROM known{r})) CROSS JOIN cent{r}),
pred{r} AS (SELECT vec_id, first(label ORDER BY s DESC, label) AS label, round(1 / sum(exp(10 * (s - m))), 6) AS confidence
            FROM (SELECT *, max(s) OVER (PARTITION BY vec_id) AS m FROM scores{r}) GROUP BY vec_id),
acc{r} AS (SELECT vec_id, label, confidence, {r} AS round FROM pred{r} WHERE confidence >= {LEAST}
           QUALIFY row_number() OVER (PARTITION BY label ORDER BY confidence DESC, vec_id) <= {QUOTA})""")
    return s.ctes(*steps) + " UNION ALL ".join(f"SELECT * FROM acc{r}" for r in range(1, ROUNDS + 1))


@query("self_training", _self_training_sql())
def self_training(t):
    """Labelled vectors teach the others in three rounds of at most eight rows a class."""
    rows = intents(t).select(F.col("vec_id").alias("id"), F.col("true_intent").alias("label"), F.col("embedding").alias("vector"))
    known = t("labels").select(F.col("doc_id").alias("id")).distinct()
    job = SelfTraining(shared_dir(rows.sparkSession, "self-training"), QUOTA, LEAST, ROUNDS)
    found = job.run(rows.join(known, "id", "left_semi"), rows.join(known, "id", "left_anti").drop("label"))
    return found.withColumnRenamed("id", "vec_id")


@query("method_comparison")
def method_comparison(t):
    """Majority, TF-IDF with regression, and vectors with regression on the same held-out messages, with their lift."""
    rows = split_messages(t)
    golden = rows.where("split = 'test'")
    train = evaluation.training_rows(rows, golden, "query_id", "customer_message", ["query_id"])
    compared = evaluation.compare_methods(train, golden, "true_intent", "customer_message", "features")
    return compared.withColumns({c: F.round(c, 6) for c in ("accuracy", "macro_f1", "lift_pp")})


@query("lang_bayes", rf"""
WITH low AS (SELECT doc_id, lang, {s.squeeze('lower(text)')} AS x FROM documents),
grams AS (SELECT doc_id, lang, substring(x, i, 3) AS t FROM low, unnest(generate_series(1, length(x) - 2)) AS s(i)),
tf AS (SELECT doc_id, lang, t, count(*) AS n FROM grams GROUP BY ALL),
counts AS (SELECT lang, t, sum(n) AS c FROM tf GROUP BY ALL),
room AS (SELECT lang, sum(c) + (SELECT count(DISTINCT t) FROM counts) AS r FROM counts GROUP BY lang),
prior AS (SELECT lang, ln(count(*)::DOUBLE / (SELECT count(*) FROM documents)) AS p FROM documents GROUP BY lang),
cells AS (SELECT l.lang, t.t, ln((coalesce(c, 0) + 1)::DOUBLE / r) AS w
          FROM (SELECT DISTINCT t FROM counts) t CROSS JOIN room l LEFT JOIN counts USING (lang, t)),
sums AS (SELECT doc_id, cells.lang, sum(n * w) AS s FROM tf JOIN cells USING (t) GROUP BY ALL),
logs AS (SELECT doc_id, lang, p + coalesce(s, 0) AS l FROM (SELECT doc_id FROM documents) CROSS JOIN prior LEFT JOIN sums USING (doc_id, lang)),
top AS (SELECT *, max(l) OVER (PARTITION BY doc_id) AS m FROM logs)
SELECT doc_id, first(lang ORDER BY l DESC, lang) AS detected_lang,
       round(max(exp(l - m)) FILTER (lang = 'en') / sum(exp(l - m)), 6) AS p_english FROM top GROUP BY doc_id""")
def lang_bayes(t):
    """Every document's language and its probability of being English, by tables of trigram weights."""
    rows = language.counted_rows(docs(t), "text", "doc_id", "lang")
    tables = language.fit(rows, "lang")
    found = language.detect(tables, rows, ["doc_id"])
    return found.select("doc_id", "detected_lang", F.col("p")[tables.langs.index("en")].alias("p_english"))


def tokenised(t):
    cleaned = docs(t).select("doc_id", "lang", tx.clean_for_clustering("text").alias("clean"))
    return features.with_terms(cleaned, "clean", (), bigrams=False, out="words").drop("clean")


_TOKENS = f"""words AS (SELECT doc_id, regexp_extract_all(lower(clean), '[{s.W}]{{2,}}') AS ws
  FROM (SELECT doc_id, {s.squeeze(s.sub('lower(text)', s.URL['cluster'], ' '))} AS clean FROM documents)),
uni AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM words)"""


@query("ppmi_table", s.ctes(_TOKENS, """known AS (SELECT w FROM uni GROUP BY w HAVING count(DISTINCT doc_id) >= 3),
pairs AS (SELECT a.w, b.w AS c FROM uni a JOIN uni b ON a.doc_id = b.doc_id AND b.i > a.i AND b.i <= a.i + 4),
counts AS (SELECT w, c, count(*) AS n FROM (SELECT w, c FROM pairs UNION ALL SELECT c, w FROM pairs)
           WHERE w IN (FROM known) AND c IN (FROM known) GROUP BY ALL),
margins AS (SELECT w, sum(n) AS m FROM counts GROUP BY w),
weighed AS (SELECT counts.w, c, n, ln(n * (SELECT sum(n) FROM counts)::DOUBLE / (x.m::DOUBLE * y.m)) AS p
            FROM counts JOIN margins x ON x.w = counts.w JOIN margins y ON y.w = c)""") + """
SELECT w, c, n, round(p, 6) AS ppmi FROM weighed WHERE p > 0""")
def ppmi_table(t):
    """Weights of all pairs of words that stand near each other more often than by chance."""
    found = embeddings.ppmi(embeddings.cooccurrences(tokenised(t), "words"))
    return found.withColumn("ppmi", F.round("ppmi", 6))


@query("text_vectors")
def text_vectors(t):
    """Every document's learned vector, from the words of all documents."""
    rows = materialize(tokenised(t), "tokens")
    words = materialize(embeddings.word_vectors(embeddings.ppmi(embeddings.cooccurrences(rows, "words"))), "word-vectors")
    return embeddings.text_vectors(rows, "doc_id", "words", words)


@query("text_vectors_accuracy")
def text_vectors_accuracy(t):
    """Share of held-out documents whose language the nearest class centroid tells: learned vectors against word counts."""
    rows = materialize(tokenised(t), "tokens")
    words = materialize(embeddings.word_vectors(embeddings.ppmi(embeddings.cooccurrences(rows, "words"))), "word-vectors")
    split = ranking.stratified_split(rows.select("doc_id", "lang"), "lang", 0.2, 42, "doc_id")
    learned = embeddings.text_vectors(rows, "doc_id", "words", words)
    joined = rows.select("doc_id", F.concat_ws(" ", "words").alias("text"))
    counts = features.encode_with(joined, "text", features.word_counter(64)).drop("text")
    found = []
    for method, vectors in (("learned", learned), ("word counts", counts)):
        both = materialize(vectors.join(split, "doc_id"), "split-vectors")
        classes = models.centroids(both.where("split = 'train'"), "lang")
        scored = models.centroid_predict(models.centroid_scores(both.where("split = 'test'"), classes))
        rate = metrics.accuracy(metrics.pair_counts(scored, "lang", "predicted_intent"))
        found.append(rate.select(F.lit(method).alias("method"), "n_rows", F.round("accuracy", 6).alias("accuracy")))
    return metrics.union_all(found)
