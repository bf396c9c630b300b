"""Near-identical cases of the retrieval history."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskwise.catalog import sql as s
from deskwise.catalog.corpus import HISTORY, doc_pairs
from deskwise.catalog.registry import query
from deskwise.config import RUNTIME
from deskwise.operators import similarity
from deskwise.plans import corpus

PERCENT, SIZE = 80, 5

# Every pair of cases that share a shingle, with the number of shared ones; then the closure of the links.
NEAR = f"""words AS (
  SELECT pos, message_id, regexp_extract_all(lower(customer_message), '[{s.W}]{{2,}}') AS w FROM history),
shingles AS (
  SELECT DISTINCT pos, array_to_string(w[i : i + {SIZE - 1}], ' ') AS g
  FROM words, unnest(generate_series(1, greatest(len(w) - {SIZE - 1}, 1))) AS x(i) WHERE len(w) > 0),
sizes AS (SELECT pos, count(*) AS n FROM shingles GROUP BY pos),
shared AS (
  SELECT a.pos AS a, b.pos AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.pos < b.pos GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.pos = a JOIN sizes y ON y.pos = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT pos AS node, pos AS root FROM words UNION SELECT ends.b, reach.root FROM reach JOIN ends ON ends.a = reach.node),
near AS (
  SELECT message_id, pos, coalesce(n, 0) AS n_shingles, (SELECT count(*) FROM ends WHERE a = words.pos) AS n_similar,
         (SELECT min(root) FROM reach WHERE node = words.pos) AS group_id
  FROM words LEFT JOIN sizes USING (pos))"""
_SQL = s.ctes(*HISTORY, NEAR).replace("WITH", "WITH RECURSIVE", 1)


def history(t):
    golden = t("labels").select(F.col("doc_id").cast("string").alias("message_id"))
    return corpus.retrieval_history(doc_pairs(t), golden, RUNTIME, "pos")


@query("history_near_dups", _SQL + "SELECT pos, n_shingles, n_similar, group_id FROM near")
def history_near_dups(t):
    """Links of every case of the history and the group that they make, five-word shingles, 80 percent."""
    return similarity.near_identical(history(t), "pos", "customer_message", PERCENT, SIZE)


@query("history_distinct", _SQL + "SELECT message_id, customer_message FROM near JOIN history USING (message_id) WHERE near.pos = group_id")
def history_distinct(t):
    """The history with one case of every group of near-identical ones."""
    return similarity.drop_near_identical(history(t), "pos", "customer_message", PERCENT, SIZE).select("message_id", "customer_message")
