"""Reading, cleaning, filtering, guarding, de-duplicating and sampling message tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskwise.catalog import sql as s
from deskwise.catalog.registry import query
from deskwise.config import BATCH, RUNTIME
from deskwise.functions import text as tx
from deskwise.operators import curation as cu
from deskwise.operators import guards, metrics, ranking, review
from deskwise.plans import corpus
from deskwise.session import shared_dir
from deskwise.sources import tables as src

BOUND = 10_000  # rows of the bounded reads


def docs(t):
    return src.spread(t("documents"), "doc_id")


def pairs(t):
    df = cu.pair_turns(src.spread(t("conversations"), "conv_id", "turn"))
    return df.withColumn("pos", F.col("conv_id").cast("bigint") * (1 << 32) + F.col("turn"))


def reviewed(t):
    return docs(t).join(t("labels"), "doc_id")


def noisy(t):
    c = F.col
    message = F.concat(
        F.lit("@"), c("source"), F.lit(" "), c("text"), F.lit(" &amp;lt;tag&gt; http://t.example/"),
        c("doc_id").cast("string"), F.lit(" www.example.org/"), c("lang"),
        F.lit("\n line\\nbreak\\tend ^AB, ^"), F.upper("lang"), F.lit("  "),
    )
    return docs(t).select("doc_id", message.alias("message"), "lang", "source")


# --- sources -------------------------------------------------------------------------------


@query("pair_turns", """
SELECT conv_id, turn, conv_id || '-' || turn AS message_id, text AS customer_message,
       conv_id || '-' || next_turn AS response_id, next_text AS agent_response
FROM (SELECT *, lead(turn) OVER w AS next_turn, lead(text) OVER w AS next_text, lead(role) OVER w AS next_role
      FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
WHERE role = 'user' AND next_role = 'assistant'""")
def pair_turns(t):
    return cu.pair_turns(t("conversations"))


@query("pair_replies", s.ctes(s.PAIRS) + "SELECT message_id, customer_message, response_id, agent_response FROM pairs")
def pair_replies(t):
    before = F.col("turn") - 1
    messages = t("conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("message_id"),
        F.concat_ws("-", F.col("conv_id"), before).alias("in_reply_to"),
        F.col("role").alias("role"), "text",
    )
    people = messages.where(F.col("role").isin("user", "assistant"))
    return cu.pair_replies(people.withColumn("inbound", F.col("role") == "user"))


@query("na_tokens", f"""
WITH raw AS (
  SELECT d.doc_id, CASE l.toxic WHEN 1 THEN 'NA' WHEN 0 THEN d.lang ELSE 'null' END AS note
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT doc_id, CASE WHEN note NOT IN {s.in_list(['', 'NA', 'null', 'None', 'nan', 'N/A'])}
                    THEN note END AS note FROM raw""")
def na_tokens(t):
    raw = t("documents").join(t("labels"), "doc_id", "left").select(
        "doc_id",
        F.when(F.col("toxic") == 1, "NA").when(F.col("toxic") == 0, F.col("lang")).otherwise("null").alias("note"),
    )
    return src.tokens_to_null(raw, ["note"])


@query("numeric_coerce", """
SELECT event_id, TRY_CAST(CASE WHEN event_type = 'error' THEN props ELSE value::VARCHAR END AS DOUBLE)
       AS amount FROM events""")
def numeric_coerce(t):
    raw = F.when(F.col("event_type") == "error", F.col("props")).otherwise(F.col("value").cast("string"))
    return src.coerce_numbers(t("events").select("event_id", raw.alias("amount")), ["amount"])


@query("format_round", """
SELECT event_id, printf('%.2f', value) AS two_places, printf('%.4f', value) AS four_places,
       round(value / 7, 4) AS rounded FROM events""")
def format_round(t):
    return t("events").select(
        "event_id",
        F.format_string("%.2f", "value").alias("two_places"),
        F.format_string("%.4f", "value").alias("four_places"),
        F.round(F.col("value") / 7, 4).alias("rounded"),
    )


@query("brand_filter", "SELECT doc_id, lang, n_chars FROM documents WHERE source = 'src3'")
def brand_filter(t):
    return src.by_source(t("documents"), "src3").select("doc_id", "lang", "n_chars")


_AFTER = s.ctes(
    s.PAIRS,
    f"""cleaned AS (SELECT message_id, pos, {s.clean('customer_message', 'runtime')} AS customer_message,
         {s.clean('agent_response', 'runtime')} AS agent_response FROM pairs)""",
    """first_rows AS (SELECT * FROM cleaned WHERE customer_message <> '' AND agent_response <> ''
         ORDER BY pos LIMIT 10000)""",
)


@query("bounded_history_after", _AFTER + "SELECT message_id, customer_message, agent_response FROM first_rows")
def bounded_history_after(t):
    def keep(rows):
        return cu.non_empty(cu.clean_columns(rows, corpus.PAIR, "runtime"), *corpus.PAIR)

    df = ranking.first_n_kept(pairs(t), "pos", BOUND, keep)
    return df.select("message_id", *corpus.PAIR)


@query("bounded_history_before", s.ctes(s.PAIRS) + f"""
SELECT message_id, {s.strip('customer_message')} AS customer_message,
       {s.strip('agent_response')} AS agent_response
FROM (SELECT * FROM pairs ORDER BY pos LIMIT 10000)
WHERE customer_message IS NOT NULL AND agent_response IS NOT NULL""")
def bounded_history_before(t):
    df = ranking.first_n(pairs(t), "pos", BOUND).dropna(subset=list(corpus.PAIR))
    return df.withColumns({c: tx.strip(c) for c in corpus.PAIR}).select("message_id", *corpus.PAIR)


# The limit binds on this table from sf0.01 on.
@query("bounded_rows", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10000")
def bounded_rows(t):
    df = t("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return ranking.first_n(df, "o_orderkey", BOUND)


@query("bounded_rows_kept", """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12) ORDER BY o_orderkey LIMIT 10000""")
def bounded_rows_kept(t):
    away = t("customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("o_custkey"))
    df = t("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return ranking.first_n_kept(
        df, "o_orderkey", BOUND, lambda rows: guards.exclude_ids(rows, away, "o_custkey")
    )


# --- row filters ---------------------------------------------------------------------------

_OPTIONAL = """raw AS (
  SELECT d.doc_id, d.lang, CASE WHEN l.toxic = 0 THEN d.source END AS note
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def optional_notes(t):
    note = F.when(F.col("toxic") == 0, F.col("source"))
    return t("documents").join(t("labels"), "doc_id", "left").select("doc_id", "lang", note.alias("note"))


@query("drop_null_rows", s.ctes(_OPTIONAL) + "SELECT * FROM raw WHERE note IS NOT NULL AND lang IS NOT NULL")
def drop_null_rows(t):
    return optional_notes(t).dropna(subset=["note", "lang"])


@query("fill_null_text", s.ctes(_OPTIONAL) + "SELECT doc_id, coalesce(lang, '') AS lang, coalesce(note, '') AS note FROM raw")
def fill_null_text(t):
    return optional_notes(t).fillna("")


@query("nonempty", s.ctes(_OPTIONAL) + "SELECT doc_id, lang, note FROM raw WHERE coalesce(note, '') <> '' AND lang <> ''")
def nonempty(t):
    return cu.non_empty(optional_notes(t).fillna(""), "note", "lang")


@query("min_length", s.ctes(s.PAIRS) + """
SELECT message_id, length(customer_message)::INTEGER AS n_customer, length(agent_response)::INTEGER AS n_agent
FROM pairs WHERE length(customer_message) >= 100 AND length(agent_response) >= 100""")
def min_length(t):
    return cu.min_length(pairs(t), corpus.PAIR, 100).select(
        "message_id", F.length("customer_message").alias("n_customer"), F.length("agent_response").alias("n_agent")
    )


@query("ack_filter", f"""
SELECT event_id, event_type || '!!' AS message FROM events
WHERE NOT {s.ack("event_type || '!!'", ('view', 'click', 'ok', 'thanks'))}""")
def ack_filter(t):
    df = t("events").select("event_id", F.concat("event_type", F.lit("!!")).alias("message"))
    return df.where(~tx.is_acknowledgement("message", ("view", "click", "ok", "thanks")))


@query("english_share", f"SELECT doc_id, round({s.language_share('text')}, 6) AS share FROM documents")
def english_share(t):
    return docs(t).select("doc_id", F.round(tx.language_share("text"), 6).alias("share"))


# --- text ----------------------------------------------------------------------------------


def text_query(name: str, table: str, key: str, column: str, expr, sql_expr):
    """A scalar text function over one whole table."""
    source = {"noisy": s.ctes(s.NOISY), "pages": ""}[table]

    @query(name, f"{source}SELECT {key}, {sql_expr(column)} AS cleaned FROM {table}")
    def run(t):
        df = noisy(t) if table == "noisy" else src.spread(t(table), key)
        return df.select(key, expr(column).alias("cleaned"))


text_query("html_decode", "pages", "page_id", "html", tx.decode_entities, s.decode)
text_query("strip_urls", "pages", "page_id", "html", tx.strip_urls, lambda c: s.sub(c, s.URL["strict"], " "))
text_query("strip_urls_runtime", "noisy", "doc_id", "message",
           lambda c: tx.strip_urls(c, "runtime"), lambda c: s.sub(c, s.URL["runtime"], " "))
text_query("strip_mentions", "noisy", "doc_id", "message", tx.strip_mentions, lambda c: s.sub(c, f"@[{s.W}]+", " "))
text_query("strip_signature", "noisy", "doc_id", "message", tx.strip_signature, lambda c: s.sub(c, *s.SIGN["strict"]))
text_query("strip_signature_runtime", "noisy", "doc_id", "message",
           lambda c: tx.strip_signature(c, "runtime"), lambda c: s.sub(c, *s.SIGN["runtime"]))
text_query("literal_escapes", "noisy", "doc_id", "message", tx.drop_literal_escapes, s.escapes)
text_query("squeeze_space", "noisy", "doc_id", "message", tx.squeeze_space, s.squeeze)
text_query("clean_strict", "noisy", "doc_id", "message", tx.clean_text, lambda c: s.clean(c, "strict"))
text_query("clean_runtime", "noisy", "doc_id", "message",
           lambda c: tx.clean_text(c, "runtime"), lambda c: s.clean(c, "runtime"))
text_query("clean_cluster", "noisy", "doc_id", "message", tx.clean_for_clustering,
           lambda c: s.squeeze(s.sub(f"lower({c})", s.URL["cluster"], " ")))

# Words of the synthetic prose, standing in for the phrase lists, which it never contains.
ABUSE = ("trash", "scum", "idiot", "clown", "worthless", "moron", "pathetic", "loser", "stupid", "disgusting")
URGENT = ("thatble", "with the", "ungen", "erations")


@query("contains_any", f"""
SELECT doc_id, {s.contains_any('text', ABUSE)} AS abusive, {s.contains_any('text', URGENT)} AS urgent,
       {s.contains_any('text', RUNTIME.security_terms)} AS security,
       {s.contains_any('text', RUNTIME.human_terms)} AS human FROM documents""")
def contains_any(t):
    return docs(t).select(
        "doc_id",
        tx.contains_any("text", ABUSE).alias("abusive"),
        tx.contains_any("text", URGENT).alias("urgent"),
        tx.contains_any("text", RUNTIME.security_terms).alias("security"),
        tx.contains_any("text", RUNTIME.human_terms).alias("human"),
    )


# --- pipelines -----------------------------------------------------------------------------

_STEP1 = f"""cleaned AS (
  SELECT message_id, pos, customer_message IS NOT NULL AND agent_response IS NOT NULL AS complete,
         {s.clean('customer_message', 'strict')} AS customer_message,
         {s.clean('agent_response', 'strict')} AS agent_response FROM pairs)"""
_SHARES = f"""flagged AS (
  SELECT *, customer_message <> '' AND agent_response <> '' AS filled,
         length(customer_message) >= 10 AND length(agent_response) >= 10 AS long_enough,
         NOT {s.ack('customer_message')} AS wordy,
         {s.language_share('customer_message')} >= 0.8 AND {s.language_share('agent_response')} >= 0.8 AS english
  FROM cleaned)"""
_FIRST = """kept AS (SELECT * FROM flagged WHERE complete AND filled
  QUALIFY row_number() OVER (PARTITION BY customer_message, agent_response ORDER BY pos) = 1)"""


@query("clean_pairs", s.ctes(s.PAIRS, _STEP1, _SHARES, _FIRST) + """
SELECT message_id, customer_message, agent_response FROM kept WHERE long_enough AND wordy AND english""")
def clean_pairs(t):
    return corpus.clean_pairs(pairs(t), ["pos"]).select("message_id", *corpus.PAIR)


# Exact copies occur among the documents, so this run also shows the de-duplication step.
_DOC_PAIRS = """pairs AS (SELECT doc_id::VARCHAR AS message_id, doc_id AS pos, text AS customer_message,
  source || ' answers in ' || lang || ' ' || text AS agent_response FROM documents)"""


def doc_pairs(t):
    reply = F.concat_ws(" ", F.col("source"), F.lit("answers in"), F.col("lang"), F.col("text"))
    return docs(t).select(
        F.col("doc_id").cast("string").alias("message_id"), F.col("doc_id").alias("pos"),
        F.col("text").alias("customer_message"), reply.alias("agent_response"),
    )


@query("clean_funnel", s.ctes(_DOC_PAIRS, _STEP1, _SHARES, _FIRST) + """
SELECT '1 input' AS step, count(*) AS n_rows FROM flagged
UNION ALL SELECT '2 not null', count(*) FROM flagged WHERE complete
UNION ALL SELECT '3 not empty', count(*) FROM flagged WHERE complete AND filled
UNION ALL SELECT '4 distinct', count(*) FROM kept
UNION ALL SELECT '5 long enough', count(*) FROM kept WHERE long_enough
UNION ALL SELECT '6 not an acknowledgement', count(*) FROM kept WHERE long_enough AND wordy
UNION ALL SELECT '7 english', count(*) FROM kept WHERE long_enough AND wordy AND english""")
def clean_funnel(t):
    return corpus.cleaning_funnel(doc_pairs(t))


# --- files ---------------------------------------------------------------------------------


@query("csv_round_trip", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_round_trip(t):
    """Documents written as CSV files that begin with a byte order mark, and read again with their types."""
    rows = docs(t)
    path = shared_dir(rows.sparkSession, "csv")
    src.write_table(rows, path, "csv", bom=True)
    return src.read_checked(rows.sparkSession, path, t("documents").schema, multi_line=True)[0]


@query("csv_rejects", """
SELECT CASE WHEN lang = 'de' THEN doc_id || ',' || lang ELSE '{"doc_id":"no ' || doc_id || '","lang":"' || lang || '","n_chars":"' || n_chars || '"}' END AS record,
       CASE WHEN lang = 'de' THEN 'number of fields' ELSE 'doc_id is not bigint' END AS reason
FROM documents WHERE lang IN ('de', 'fr')""")
def csv_rejects(t):
    """Of records without a field (German) or with a broken id (French) those that the reader keeps apart."""
    c = F.col
    line = F.when(c("lang") == "de", F.concat_ws(",", "doc_id", "lang")).when(
        c("lang") == "fr", F.concat(F.lit("no "), F.concat_ws(",", "doc_id", "lang", "n_chars"))
    )
    rows = docs(t).select(F.coalesce(line, F.concat_ws(",", "doc_id", "lang", "n_chars")).alias("value"))
    path = shared_dir(rows.sparkSession, "lines")
    rows.write.text(path)
    schema = t("documents").select("doc_id", "lang", "n_chars").schema
    return src.read_checked(rows.sparkSession, path, schema, header=False)[1].select("record", "reason")


# --- sets and guards -----------------------------------------------------------------------


@query("dedupe_first", """
SELECT doc_id, text FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""")
def dedupe_first(t):
    return cu.dedupe_first(t("documents").select("doc_id", "text"), ["text"], ["doc_id"])


@query("union_precedence", s.ctes(s.REVIEWED) + """
SELECT doc_id, lang, 0 AS priority FROM reviewed UNION ALL SELECT doc_id, lang, 1 FROM documents""")
def union_precedence(t):
    cols = ["doc_id", "lang"]
    return cu.union_by_priority(reviewed(t).select(*cols), t("documents").select(*cols))


_MERGED = """merged AS (SELECT doc_id, text, 0 AS priority FROM reviewed
  UNION ALL SELECT doc_id, text, 1 FROM documents)"""


@query("dedupe_chain", s.ctes(
    s.REVIEWED, _MERGED,
    """by_id AS (SELECT * FROM merged
         QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY priority, doc_id) = 1)""",
) + """SELECT doc_id, text, priority FROM by_id
QUALIFY row_number() OVER (PARTITION BY text ORDER BY priority, doc_id) = 1""")
def dedupe_chain(t):
    cols = ["doc_id", "text"]
    merged = cu.union_by_priority(reviewed(t).select(*cols), t("documents").select(*cols))
    return cu.dedupe_chain(merged, [["doc_id"], ["text"]], ["priority", "doc_id"])


@query("duplicate_audit", """
SELECT 'doc_id' AS column_name, count(*) AS n_rows, count(*) - count(DISTINCT doc_id) AS n_duplicates FROM documents
UNION ALL SELECT 'text', count(*), count(*) - count(DISTINCT text) FROM documents""")
def duplicate_audit(t):
    return cu.duplicate_audit(t("documents"), ["doc_id", "text"])


@query("guard_by_id", """
SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)""")
def guard_by_id(t):
    return guards.exclude_ids(t("documents"), t("labels"), "doc_id").select("doc_id", "lang")


@query("guard_by_message", s.ctes(s.REVIEWED) + f"""
SELECT doc_id, lang FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM reviewed r WHERE {s.strip('r.text')} = {s.strip('d.text')})""")
def guard_by_message(t):
    return guards.exclude_messages(t("documents"), reviewed(t), "text").select("doc_id", "lang")


@query("guard_removed_count", s.ctes(s.REVIEWED, f"""flags AS (
  SELECT doc_id IN (SELECT doc_id FROM reviewed) AS i,
         {s.strip('text')} IN (SELECT {s.strip('text')} FROM reviewed) AS m FROM documents)""") + """
SELECT count(*) AS n_rows, count(*) FILTER (i) AS removed_by_id, count(*) FILTER (m) AS removed_by_message,
       count(*) FILTER (NOT i AND NOT m) AS n_kept FROM flags""")
def guard_removed_count(t):
    return guards.removed_counts(t("documents"), reviewed(t), "doc_id", "text")


@query("join_truth", """
SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def join_truth(t):
    docs = t("documents").select("doc_id", "lang", "source")
    return guards.join_truth(docs, t("labels"), "doc_id", ["quality", "toxic"])


@query("join_fan_out", s.ctes(s.REVIEWED, """n AS (
  SELECT text, (SELECT count(*) FROM documents d WHERE d.text = r.text) AS n_left, count(*) AS n_right
  FROM reviewed r GROUP BY text)""") + """
SELECT count(*) AS n_texts, sum(n_left)::BIGINT AS n_matched, sum(n_left * n_right)::BIGINT AS n_joined FROM n""")
def join_fan_out(t):
    return guards.text_fan_out(t("documents"), reviewed(t), "text")


@query("join_truth_all", s.ctes(s.REVIEWED) + """
SELECT d.doc_id, d.source, r.doc_id AS truth_id, r.quality, r.toxic FROM documents d JOIN reviewed r ON d.text = r.text""")
def join_truth_all(t):
    """Every document with every truth of the same text; copies multiply, as in a plain join on the text."""
    truth = reviewed(t).select("text", F.col("doc_id").alias("truth_id"), "quality", "toxic")
    return guards.join_truth_all(docs(t), truth, "text", ["doc_id", "source"], ["truth_id", "quality", "toxic"], piece=8)


@query("truth_conflicts", s.ctes(s.REVIEWED) + """
SELECT min(doc_id) AS first_id, count(*) AS n_truth, count(DISTINCT (quality, toxic)) AS n_values,
       count(DISTINCT (quality, toxic)) > 1 AS conflict FROM reviewed WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1""")
def truth_conflicts(t):
    return guards.truth_conflicts(reviewed(t), "text", ["quality", "toxic"], "doc_id")


# --- samples -------------------------------------------------------------------------------


@query("stratified_sample", """
SELECT doc_id, lang FROM documents
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id)) <= 50""")
def stratified_sample(t):
    return ranking.stratified_sample(t("documents").select("doc_id", "lang"), ["lang"], 50, 42, "doc_id")


@query("shuffle_pos", "SELECT doc_id, row_number() OVER (ORDER BY md5('43|' || doc_id)) AS shuffle_pos FROM documents")
def shuffle_pos(t):
    return ranking.shuffled(t("documents").select("doc_id"), 43, "doc_id")


@query("uniform_sample", "SELECT doc_id, source FROM documents ORDER BY md5('42|' || doc_id) LIMIT 50")
def uniform_sample(t):
    return ranking.uniform_sample(t("documents").select("doc_id", "source"), 50, 42, "doc_id")


_SPLIT = """split AS (SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id))
  <= round(0.2::DOUBLE * count(*) OVER (PARTITION BY lang)) THEN 'test' ELSE 'train' END AS split FROM documents)"""


@query("stratified_split", s.ctes(_SPLIT) + "SELECT * FROM split")
def stratified_split(t):
    return ranking.stratified_split(t("documents").select("doc_id", "lang"), "lang", 0.2, 42, "doc_id")


@query("split_exact_total", """
WITH sizes AS (SELECT lang, count(*) AS n, sum(count(*)) OVER () AS total FROM documents GROUP BY lang),
quota AS (SELECT *, round(0.2::DOUBLE * total)::BIGINT AS want FROM sizes),
floors AS (SELECT lang, want, (want * n) // total AS base, (want * n) % total AS rest FROM quota),
dealt AS (SELECT lang, base + (row_number() OVER (ORDER BY rest DESC, lang) <= want - sum(base) OVER ())::INTEGER AS k FROM floors)
SELECT doc_id, d.lang, CASE WHEN row_number() OVER (PARTITION BY d.lang ORDER BY md5('42|' || doc_id)) <= k THEN 'test' ELSE 'train' END AS split
FROM documents d JOIN dealt ON d.lang = dealt.lang""")
def split_exact_total(t):
    """A fifth of all documents, the rounding shared out to the languages."""
    return ranking.split_exact_total(t("documents").select("doc_id", "lang"), "lang", 0.2, 42, "doc_id")


# The documents' source stands in for the cluster, the labelled documents for the golden set.
@query("training_sample", """
WITH free AS (SELECT doc_id, source AS cluster FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
picked AS (SELECT * FROM free QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY md5('42|' || doc_id)) <= 50)
SELECT doc_id, cluster, row_number() OVER (ORDER BY md5('43|' || doc_id)) AS shuffle_pos,
       NULL::VARCHAR AS intent, NULL::VARCHAR AS notes FROM picked""")
def training_sample(t):
    clustered = t("documents").select("doc_id", F.col("source").alias("cluster"))
    return corpus.labelling_sample(clustered, t("labels"), "doc_id")


@query("combined_training", s.ctes(s.REVIEWED, """
ver AS (SELECT doc_id::VARCHAR AS message_id, text AS customer_message, lang AS intent, 'HIGH' AS confidence,
               'reviewed' AS reason, doc_id AS pos, 0 AS priority FROM reviewed WHERE quality = 1),
sel AS (SELECT doc_id::VARCHAR, text, source, 'MEDIUM', 'selected', doc_id, 1 FROM documents),
gold AS (SELECT doc_id::VARCHAR AS message_id FROM labels WHERE toxic = 1),
merged AS (SELECT * FROM ver UNION ALL SELECT * FROM sel),
free AS (SELECT * FROM merged WHERE message_id NOT IN (SELECT message_id FROM gold)),
by_id AS (SELECT * FROM free QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY priority, pos) = 1)""") + """
SELECT message_id, customer_message, intent, confidence, reason FROM by_id
QUALIFY row_number() OVER (PARTITION BY customer_message ORDER BY priority, pos) = 1""")
def combined_training(t):
    def rows(df, intent, confidence, reason):
        return df.select(
            F.col("doc_id").cast("string").alias("message_id"), F.col("text").alias("customer_message"),
            intent, F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason"), F.col("doc_id").alias("pos"),
        )

    verified = rows(reviewed(t).where("quality = 1"), F.col("lang").alias("corrected_intent"), "HIGH", "reviewed")
    selected = rows(t("documents"), F.col("source").alias("intent"), "MEDIUM", "selected")
    golden = t("labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("message_id"))
    return corpus.combined_training(verified, selected, golden, "pos").select(*corpus.TRAINING)


HISTORY = (_DOC_PAIRS, f"""cleaned AS (
  SELECT message_id, pos, {s.clean('customer_message', 'runtime')} AS customer_message,
         {s.clean('agent_response', 'runtime')} AS agent_response FROM pairs)""", """
bounded AS (SELECT * FROM cleaned WHERE customer_message <> '' AND agent_response <> ''
  AND message_id NOT IN (SELECT doc_id::VARCHAR FROM labels))""", """
history AS (SELECT * FROM bounded QUALIFY row_number() OVER (PARTITION BY customer_message ORDER BY pos) = 1)""")


@query("history_table", s.ctes(*HISTORY) + "SELECT message_id, customer_message, agent_response FROM history")
def history_table(t):
    golden = t("labels").select(F.col("doc_id").cast("string").alias("message_id"))
    return corpus.retrieval_history(doc_pairs(t), golden, RUNTIME, "pos").select("message_id", *corpus.PAIR)


@query("history_table_batch", s.ctes(s.REVIEWED, _DOC_PAIRS, f"""bounded AS (
  SELECT message_id, pos, {s.strip('customer_message')} AS customer_message,
         {s.strip('agent_response')} AS agent_response FROM pairs),
firsts AS (SELECT * FROM bounded QUALIFY row_number() OVER (PARTITION BY customer_message ORDER BY pos) = 1)""") + f"""
SELECT message_id, customer_message, agent_response FROM firsts
WHERE customer_message NOT IN (SELECT {s.strip('text')} FROM reviewed)""")
def history_table_batch(t):
    golden = reviewed(t).select(F.col("text").alias("customer_message"))
    return corpus.retrieval_history(doc_pairs(t), golden, BATCH, "pos").select("message_id", *corpus.PAIR)


@query("cluster_report", """
SELECT source AS cluster, doc_id, text, count(*) OVER (PARTITION BY source) AS cluster_size FROM documents
QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 10""")
def cluster_report(t):
    clustered = t("documents").select(F.col("source").alias("cluster"), "doc_id", "text")
    return corpus.cluster_report(clustered, "doc_id", "text")


# --- human review --------------------------------------------------------------------------


@query("review_sheet", s.ctes(s.PAIRS) + f"""
SELECT message_id, customer_message, 'none' AS predicted_intent, agent_response AS generated_response,
       {', '.join(f'NULL::VARCHAR AS {c}' for c in (*review.SCORES, review.NOTES))}
FROM pairs ORDER BY md5('42|' || message_id) LIMIT 50""")
def review_sheet(t):
    answered = pairs(t).select(
        "message_id", "customer_message", F.lit("none").alias("predicted_intent"),
        F.col("agent_response").alias("generated_response"),
    )
    return review.review_sheet(answered, "message_id")


# Scores derived from the labels; a toxic row carries one score outside 1-5.
_RAW_SCORES = """raw AS (SELECT doc_id, (4 + quality) || '.0' AS human_relevance,
  (2 + toxic)::VARCHAR AS human_actionability, CASE WHEN toxic = 1 THEN '6' ELSE '5' END AS human_safety,
  CASE WHEN quality = 1 THEN '4' ELSE 'x' END AS human_grounding, (2 + 2 * quality)::VARCHAR AS human_overall
  FROM labels)"""


def raw_scores(t):
    c = F.col
    return t("labels").select(
        "doc_id",
        F.concat((4 + c("quality")).cast("string"), F.lit(".0")).alias("human_relevance"),
        (2 + c("toxic")).cast("string").alias("human_actionability"),
        F.when(c("toxic") == 1, "6").otherwise("5").alias("human_safety"),
        F.when(c("quality") == 1, "4").otherwise("x").alias("human_grounding"),
        (2 + 2 * c("quality")).cast("string").alias("human_overall"),
    )


_INTS = ", ".join(f"TRY_CAST(TRY_CAST({c} AS DOUBLE) AS INTEGER) AS {c}" for c in review.SCORES)
_VALID = " AND ".join(f"coalesce(TRY_CAST({c} AS DOUBLE) IN (1, 2, 3, 4, 5), false)" for c in review.SCORES)
_CHECKED = f"checked AS (SELECT doc_id, {_INTS}, {_VALID} AS valid FROM raw)"


@query("review_intake", s.ctes(_RAW_SCORES, _CHECKED) + "SELECT * FROM checked")
def review_intake(t):
    return review.check_scores(raw_scores(t))


@query("review_upsert", s.ctes(_RAW_SCORES, _CHECKED) + """
SELECT doc_id, human_overall FROM checked WHERE valid
UNION ALL SELECT doc_id, NULL FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM checked WHERE valid)""")
def review_upsert(t):
    current = t("documents").select("doc_id", F.lit(None).cast("int").alias("human_overall"))
    updates = review.check_scores(raw_scores(t)).where("valid").select("doc_id", "human_overall")
    return review.upsert(current, updates, "doc_id")


@query("review_summary", s.ctes(_RAW_SCORES, _CHECKED) + f"""
SELECT count(*) AS n_reviewed, {', '.join(f'round(avg({c}), 6) AS avg_{c}' for c in review.SCORES)},
       count(*) FILTER (human_overall >= 4) AS n_good,
       round(100 * avg((human_overall >= 4)::INTEGER), 6) AS good_pct
FROM checked WHERE valid""")
def review_summary(t):
    done = review.review_summary(review.check_scores(raw_scores(t)).where("valid"))
    rounded = [f"avg_{c}" for c in review.SCORES] + ["good_pct"]
    return done.withColumns({c: F.round(c, 6) for c in rounded})


# --- frequencies ---------------------------------------------------------------------------


@query("freq_desc", s.ctes(_OPTIONAL) + "SELECT note, count(*) AS count FROM raw WHERE note IS NOT NULL GROUP BY note")
def freq_desc(t):
    return metrics.frequency(optional_notes(t), "note")


@query("freq_by_key", "SELECT lang, count(*) AS count FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def freq_by_key(t):
    return metrics.frequency(t("documents"), "lang", by="key")


@query("distinct_labels", "SELECT count(DISTINCT source) AS n_distinct FROM documents")
def distinct_labels(t):
    return metrics.distinct_count(t("documents"), "source")
