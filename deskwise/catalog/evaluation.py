"""Classification and escalation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskwise.catalog import sql as s
from deskwise.catalog.corpus import ABUSE, reviewed
from deskwise.catalog.registry import query
from deskwise.catalog.retrieval import predicted
from deskwise.functions import lexicon as lx
from deskwise.functions.text import contains_any
from deskwise.operators import decisions, failures, metrics, models, ranking

PAIRS = "pc AS (SELECT true_intent AS actual, predicted_intent AS predicted, count(*) AS n FROM pred GROUP BY ALL)"
LABELS = """lab AS (
  SELECT label, sum(s)::BIGINT AS support, sum(p)::BIGINT AS n_predicted, sum(tp)::BIGINT AS tp
  FROM (SELECT actual AS label, n AS s, 0 AS p, CASE WHEN actual = predicted THEN n ELSE 0 END AS tp FROM pc
        UNION ALL SELECT predicted, 0, n, 0 FROM pc) GROUP BY label),
met AS (
  SELECT label, support, tp, coalesce(tp::DOUBLE / nullif(n_predicted, 0), 0) AS precision,
         coalesce(tp::DOUBLE / nullif(support, 0), 0) AS recall,
         coalesce(2 * tp::DOUBLE / nullif(n_predicted + support, 0), 0) AS f1 FROM lab)"""
PAIRS_SQL = s.ctes(*s.CLASSIFY, PAIRS)
LABELS_SQL = s.ctes(*s.CLASSIFY, PAIRS, LABELS)
PRF = ("precision", "recall", "f1")


def counted(t):
    return metrics.pair_counts(predicted(t), "true_intent", "predicted_intent")


def rounded(df, *columns, places: int = 6):
    return df.withColumns({c: F.round(c, places) for c in columns})


@query("label_domain", PAIRS_SQL + "SELECT actual AS label FROM pc UNION SELECT predicted FROM pc")
def label_domain(t):
    return metrics.label_domain(counted(t))


@query("confusion_pairs", PAIRS_SQL + "SELECT actual, predicted, n AS count FROM pc WHERE actual <> predicted")
def confusion_pairs(t):
    return metrics.confusion_pairs(counted(t))


@query("confusion_matrix", PAIRS_SQL + "SELECT actual, " + ", ".join(
    f"coalesce(sum(n) FILTER (predicted = {s.lit(i)}), 0)::BIGINT AS \"{i}\"" for i in lx.INTENTS
) + " FROM pc GROUP BY actual UNION ALL SELECT DISTINCT predicted, " + ", ".join("0" for _ in lx.INTENTS)
  + " FROM pc WHERE predicted NOT IN (SELECT actual FROM pc)")
def confusion_matrix(t):
    return metrics.confusion_matrix(counted(t), lx.INTENTS)


@query("label_metrics", LABELS_SQL + "SELECT label, support, tp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM met")
def label_metrics(t):
    return rounded(metrics.label_metrics(counted(t)), *PRF)


@query("accuracy", PAIRS_SQL + """SELECT sum(n)::BIGINT AS n_rows,
round(sum(n) FILTER (actual = predicted) / sum(n)::DOUBLE, 6) AS accuracy FROM pc""")
def accuracy(t):
    return rounded(metrics.accuracy(counted(t)), "accuracy")


_MACRO = ", ".join(f"round(avg({m}), 6) AS {m}" for m in PRF)
_WEIGHTED = ", ".join(f"round(sum({m} * support) / sum(support), 6) AS {m}" for m in PRF)


@query("macro_weighted", LABELS_SQL + f"SELECT 'macro' AS average, {_MACRO} FROM met UNION ALL SELECT 'weighted', {_WEIGHTED} FROM met")
def macro_weighted(t):
    return rounded(metrics.macro_weighted(counted(t)), *PRF)


_TOTAL = "sum(support)::BIGINT AS support"
_ACC = "round(sum(tp) / sum(support)::DOUBLE, 6)"


@query("class_report", LABELS_SQL + f"""
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM met
UNION ALL SELECT 'accuracy', {_ACC}, {_ACC}, {_ACC}, {_TOTAL} FROM met
UNION ALL SELECT 'macro avg', {_MACRO}, {_TOTAL} FROM met
UNION ALL SELECT 'weighted avg', {_WEIGHTED}, {_TOTAL} FROM met""")
def class_report(t):
    return rounded(metrics.class_report(counted(t)), *PRF)


@query("correct_flag", s.ctes(*s.CLASSIFY) + "SELECT vec_id, true_intent = predicted_intent AS correct FROM pred")
def correct_flag(t):
    return metrics.with_correct(predicted(t), "true_intent", "predicted_intent").select("vec_id", "correct")


# --- escalation: truth is the toxicity label, the system's decision a phrase rule ------------

DECIDED = f"""decided AS (
  SELECT doc_id, CASE WHEN {s.contains_any('text', ABUSE)} THEN 'ESCALATE' ELSE 'AUTO_HANDLE' END AS system_decision,
         CASE WHEN toxic = 1 THEN 'ESCALATE' ELSE 'AUTO_HANDLE' END AS expected_decision, text FROM reviewed)"""
DECIDED_SQL = s.ctes(s.REVIEWED, DECIDED)


def decided(t):
    """Reviewed messages with both decisions; written loosely, as people type them."""
    said = F.when(contains_any("text", ABUSE), " Escalate").otherwise("auto_handle ")
    want = F.when(F.col("toxic") == 1, "ESCALATE").otherwise("AUTO_HANDLE")
    raw = reviewed(t).select("doc_id", said.alias("system_decision"), want.alias("expected_decision"), "text")
    both = ("system_decision", "expected_decision")
    return raw.withColumns({c: decisions.normalise_decision(c) for c in both})


@query("normalise_decision", DECIDED_SQL + "SELECT doc_id, system_decision, expected_decision FROM decided")
def normalise_decision(t):
    return decided(t).drop("text")


_2X2 = """SELECT count(*) FILTER (e AND g) AS tp, count(*) FILTER (NOT e AND g) AS fp,
  count(*) FILTER (e AND NOT g) AS fn, count(*) FILTER (NOT e AND NOT g) AS tn
  FROM (SELECT expected_decision = 'ESCALATE' AS e, system_decision = 'ESCALATE' AS g FROM decided)"""


@query("binary_prf", s.ctes(s.REVIEWED, DECIDED, f"c AS ({_2X2})") + """
SELECT tp, fp, fn, tn, round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 6) AS accuracy,
  round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision,
  round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""")
def binary_prf(t):
    pairs = metrics.pair_counts(decided(t), "expected_decision", "system_decision")
    return rounded(metrics.binary_prf(pairs, "ESCALATE"), "accuracy", *PRF)


_DPAIRS = "pc AS (SELECT expected_decision AS actual, system_decision AS predicted, count(*) AS n FROM decided GROUP BY ALL)"


@query("esc_evaluation", s.ctes(s.REVIEWED, DECIDED, _DPAIRS, LABELS) + f"""
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM met
UNION ALL SELECT 'accuracy', {_ACC}, {_ACC}, {_ACC}, {_TOTAL} FROM met
UNION ALL SELECT 'macro avg', {_MACRO}, {_TOTAL} FROM met
UNION ALL SELECT 'weighted avg', {_WEIGHTED}, {_TOTAL} FROM met""")
def esc_evaluation(t):
    pairs = metrics.pair_counts(decided(t), "expected_decision", "system_decision")
    return rounded(metrics.class_report(pairs), *PRF)


@query("esc_wrong", DECIDED_SQL + """SELECT doc_id, expected_decision, system_decision FROM decided
WHERE expected_decision <> system_decision ORDER BY doc_id LIMIT 20""")
def esc_wrong(t):
    wrong = metrics.with_correct(decided(t), "expected_decision", "system_decision").where(~F.col("correct"))
    return wrong.orderBy("doc_id").limit(20).select("doc_id", "expected_decision", "system_decision")


@query("false_missed", DECIDED_SQL + """
SELECT doc_id, 'false' AS kind FROM decided WHERE system_decision = 'ESCALATE' AND expected_decision = 'AUTO_HANDLE'
UNION ALL SELECT doc_id, 'missed' FROM decided WHERE system_decision = 'AUTO_HANDLE' AND expected_decision = 'ESCALATE'""")
def false_missed(t):
    rows = decided(t)
    false = failures.false_escalations(rows).select("doc_id", F.lit("false").alias("kind"))
    missed = failures.missed_escalations(rows).select("doc_id", F.lit("missed").alias("kind"))
    return false.unionByName(missed)


@query("conditional_counts", DECIDED_SQL + """SELECT count(*) AS n_rows, count(*) FILTER (system_decision = 'ESCALATE') AS n_escalated,
count(*) FILTER (system_decision = expected_decision) AS n_correct FROM decided""")
def conditional_counts(t):
    flags = {
        "n_escalated": F.col("system_decision") == "ESCALATE",
        "n_correct": F.col("system_decision") == F.col("expected_decision"),
    }
    return metrics.conditional_counts(decided(t), flags)


@query("percent_true", DECIDED_SQL + """SELECT round(100 * avg((system_decision = 'ESCALATE')::INTEGER), 6) AS escalated_pct,
round(100 * avg((system_decision = expected_decision)::INTEGER), 6) AS correct_pct FROM decided""")
def percent_true(t):
    flags = {
        "escalated_pct": F.col("system_decision") == "ESCALATE",
        "correct_pct": F.col("system_decision") == F.col("expected_decision"),
    }
    return rounded(metrics.percent_true(decided(t), flags), *flags)


# --- baselines -----------------------------------------------------------------------------

_SPLIT = """split AS (SELECT vec_id, true_intent, CASE WHEN row_number() OVER (PARTITION BY true_intent ORDER BY md5('42|' || vec_id))
  <= round(0.2::DOUBLE * count(*) OVER (PARTITION BY true_intent)) THEN 'test' ELSE 'train' END AS split FROM v)"""
_MAJORITY = """maj AS (SELECT true_intent AS label FROM split WHERE split = 'train' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"""


def split_intents(t):
    return ranking.stratified_split(predicted(t), "true_intent", 0.2, 42, "vec_id")


@query("majority_baseline", s.ctes(s.VECTORS, _SPLIT, _MAJORITY) + """
SELECT (SELECT label FROM maj) AS majority_label, count(*) AS n_rows,
round(avg((true_intent = (SELECT label FROM maj))::INTEGER), 6) AS accuracy FROM split WHERE split = 'test'""")
def majority_baseline(t):
    rows = split_intents(t)
    out = metrics.majority_baseline(rows.where("split = 'train'"), rows.where("split = 'test'"), "true_intent")
    return rounded(out, "accuracy")


@query("method_lift", s.ctes(*s.CLASSIFY, _SPLIT, _MAJORITY, """acc AS (
  SELECT 'majority' AS method, avg((true_intent = (SELECT label FROM maj))::INTEGER) AS accuracy FROM split WHERE split = 'test'
  UNION ALL SELECT 'centroid', avg((p.true_intent = p.predicted_intent)::INTEGER)
  FROM split x JOIN pred p ON x.vec_id = p.vec_id WHERE split = 'test')""") + """
SELECT method, round(accuracy, 6) AS accuracy,
round(((SELECT accuracy FROM acc WHERE method = 'centroid') - accuracy) * 100, 6) AS lift_pp FROM acc""")
def method_lift(t):
    rows = split_intents(t)
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    base = metrics.majority_baseline(train, test, "true_intent")
    scored = metrics.accuracy(metrics.pair_counts(test, "true_intent", "predicted_intent"))
    results = base.select(F.lit("majority").alias("method"), "accuracy").unionByName(
        scored.select(F.lit("centroid").alias("method"), "accuracy")
    )
    return rounded(metrics.method_lift(results, "centroid"), "accuracy", "lift_pp")


@query("class_weights", s.ctes(s.VECTORS) + """
SELECT true_intent, count(*) AS support,
round((SELECT count(*) FROM v)::DOUBLE / ((SELECT count(DISTINCT true_intent) FROM v) * count(*)), 6) AS weight
FROM v GROUP BY true_intent""")
def class_weights(t):
    return rounded(models.class_weights(predicted(t), "true_intent"), "weight")


@query("label_tiers", s.ctes(*s.CLASSIFY) + """SELECT vec_id, predicted_intent, confidence,
CASE WHEN confidence >= 0.5 THEN 'HIGH' WHEN confidence >= 0.2 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM pred""")
def label_tiers(t):
    return models.label_tiers(predicted(t), 0.5, 0.2).select("vec_id", "predicted_intent", "confidence", "tier")
