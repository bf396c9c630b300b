"""Decisions, responses, response screening and failure mining."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskwise import session
from deskwise.catalog import sql as s
from deskwise.catalog.corpus import ABUSE, URGENT, docs
from deskwise.catalog.evaluation import rounded
from deskwise.catalog.registry import query
from deskwise.config import BATCH, RUNTIME, TriageConfig
from deskwise.functions import lexicon as lx
from deskwise.functions import text as tx
from deskwise.functions.columns import compute_once
from deskwise.operators import decisions, failures, features, metrics, models, quality
from deskwise.plans import triage as plan
from deskwise.session import broadcast_if_small, materialize

# The phrase lists use words that occur in the test prose; the flow keeps its own defaults besides.
# Centroid confidences lie lower, and similarities of word counts higher, than those of trained models, hence the thresholds.
CONF = {
    "runtime": RUNTIME.with_(
        min_confidence=0.28, min_similarity=0.80, security_terms=(*RUNTIME.security_terms, *ABUSE),
        human_terms=(*RUNTIME.human_terms, *URGENT), complaint_intent="Payment / Billing",
        excluded_intent="Return / Refund",
    ),
    "batch": BATCH.with_(
        min_confidence=0.28, min_similarity=0.80, security_terms=(*BATCH.security_terms, *ABUSE),
        human_terms=(*BATCH.human_terms, *URGENT), complaint_intent="Payment / Billing",
        excluded_intent="Return / Refund",
    ),
}


DIMS = 64


def messages(rows, t):
    """Documents as messages: those with text, its vector and the intent their source and label stand for."""
    c = F.col
    names = F.array(*[F.lit(i) for i in lx.INTENTS])
    at = (F.length("source") + F.coalesce("quality", F.lit(0)) * 4).cast("int")
    # The texts stay where they are while the labels can be sent.
    labels = broadcast_if_small(t("labels").select("doc_id", "quality"), session.NARROW)
    known = rows.join(labels, "doc_id", "left").select(
        c("doc_id").alias("query_id"), c("text").alias("customer_message"), "source", F.element_at(names, at).alias("true_intent")
    )
    cleaned = compute_once(known, {"__clean": tx.clean_text("customer_message", "runtime")}).where("__clean <> ''")
    words = compute_once(cleaned, {"__words": F.concat_ws(" ", tx.tokens("__clean"))}).drop("__clean")
    return features.encode_with(words, "__words", features.word_counter(DIMS)).drop("__words")


def predict(rows, classes):
    """Intent and confidence of every message; a row of known intent is left out of its own class."""
    return models.centroid_predict(models.centroid_scores(rows, classes, own_label="true_intent"))


def as_history(scored):
    return scored.select(
        F.col("query_id").alias("history_id"), "customer_message", F.concat_ws(" ", F.lit("answer from"), "source").alias("agent_response"),
        "embedding", F.col("predicted_intent").alias("intent"), F.col("confidence").alias("intent_confidence"),
    )


def queries_with_text(t):
    """(queries, history): every document with text in both roles. Texts are cleaned and encoded once."""
    rows = materialize(messages(docs(t), t), "messages")
    scored = predict(rows, models.centroids(rows, "true_intent"))
    return scored.drop("source"), as_history(scored)


def triaged(t, cfg: TriageConfig, stored: bool = False):
    queries, history = queries_with_text(t)
    found = plan.retrieve_cases(queries, history, cfg, True, ("intent_confidence",), stored)
    return plan.triage(queries, found, cfg, keep=("true_intent",)), found, history


# --- the same in SQL -----------------------------------------------------------------------

# Places of a message's words, their counts, and the counts at unit length.
ENCODED = [
    f"""words AS (SELECT d.doc_id AS vec_id, ({s.str_list(lx.INTENTS)})[length(d.source) + coalesce(l.quality, 0) * 4] AS true_intent,
         list_transform(regexp_extract_all(lower({s.clean('d.text', 'runtime')}), '[{s.W}]{{2,}}'),
                        lambda w: ('0x' || substr(md5(w), 1, 7))::INTEGER % {DIMS}) AS places
         FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE {s.clean('d.text', 'runtime')} <> '')""",
    f"""counts AS (SELECT vec_id, true_intent,
         list_transform(range({DIMS}), lambda i: len(list_filter(places, lambda p: p = i))::DOUBLE) AS c FROM words)""",
    """v AS (SELECT vec_id, true_intent,
         list_transform(c, lambda x: (x / sqrt(greatest(list_dot_product(c, c), 1)))::FLOAT::DOUBLE) AS e FROM counts)""",
]


def round4(c: str) -> str:
    """Half-up on the six decimals a value has, as Spark rounds doubles."""
    return f"round({c}::DECIMAL(18, 6), 4)::DOUBLE"


def decide_sql(cfg: TriageConfig, text: str) -> tuple[str, str]:
    """(reason expression or null, decision expression) over predicted_intent, confidence, best."""
    r = lx.REASONS[cfg.profile]

    def reason(rule: str, value: str) -> str:
        return f"format({s.lit(r[rule].replace('%.2f', '{:.2f}'))}, round({value}::DECIMAL(18, 6), 2)::DOUBLE)" if "%" in r[rule] else s.lit(r[rule])

    checks = [
        (f"confidence < {cfg.min_confidence}", reason("confidence", "confidence")),
        (f"best < {cfg.min_similarity}", reason("similarity", "best")),
        (s.contains_any(text, cfg.security_terms), reason("security", "")),
        (s.contains_any(text, cfg.human_terms), reason("human", "")),
        (f"predicted_intent = {s.lit(cfg.complaint_intent)}", reason("complaint", "")),
        (f"predicted_intent = {s.lit(cfg.excluded_intent)}", reason("excluded", "")),
    ]
    if cfg.profile == "batch":
        whole = "CASE " + " ".join(f"WHEN {c} THEN {x}" for c, x in checks) + " END"
    else:
        whole = "nullif(concat_ws('; ', " + ", ".join(f"CASE WHEN {c} THEN {x} END" for c, x in checks) + "), '')"
    return whole, f"coalesce(reason, {s.lit(r['none'])})"


def template_sql(profile: str, intent: str = "predicted_intent") -> str:
    whens = " ".join(f"WHEN {s.lit(i)} THEN {s.lit(x)}" for i, x in lx.TEMPLATES[profile].items())
    return f"CASE {intent} {whens} ELSE {s.lit(lx.FALLBACK[profile])} END"


def triage_ctes(cfg: TriageConfig) -> list[str]:
    text = s.clean("d.text", "runtime") if cfg.profile == "runtime" else s.strip("d.text")
    best = "max(similarity)" if cfg.profile == "batch" else "max(similarity) FILTER (rank = 1)"
    reason, final = decide_sql(cfg, "clean_message")
    r4 = round4 if cfg.profile == "runtime" else (lambda c: c)
    return [
        *ENCODED, s.CENTROIDS, s.PREDICTED, s.CANDIDATES, s.CASES,
        f"best AS (SELECT query_id, {best} AS best FROM cases GROUP BY query_id)",
        f"""base AS (SELECT p.vec_id AS query_id, d.text AS customer_message, {text} AS clean_message, p.true_intent,
             p.predicted_intent, p.confidence, coalesce(b.best, 0) AS best
             FROM pred p JOIN documents d ON d.doc_id = p.vec_id LEFT JOIN best b ON b.query_id = p.vec_id)""",
        f"ruled AS (SELECT *, {reason} AS reason FROM base)",
        f"""tri AS (SELECT query_id, customer_message, true_intent, predicted_intent, {r4('confidence')} AS confidence,
             CASE WHEN reason IS NULL THEN 'AUTO_HANDLE' ELSE 'ESCALATE' END AS decision, {final} AS escalation_reason,
             {r4('best')} AS best_similarity,
             CASE WHEN reason IS NULL THEN {template_sql(cfg.profile)} ELSE {s.lit(lx.HANDOVER[cfg.profile])} END
             AS generated_response FROM ruled)""",
    ]


# --- decision rules and templates on the documents ------------------------------------------


def rule_inputs(t):
    """Documents with an intent, a confidence and a similarity taken from their labels and length."""
    c = F.col
    names = F.array(*[F.lit(i) for i in lx.INTENTS])
    return docs(t).join(t("labels"), "doc_id", "left").select(
        "doc_id",
        c("text").alias("customer_message"),
        F.element_at(names, (F.length("source") + F.coalesce("quality", F.lit(0)) * 4).cast("int")).alias("predicted_intent"),
        F.when(c("toxic") == 1, 0.4999).when(c("toxic") == 0, 0.5).otherwise(0.9).alias("confidence"),
        F.when(c("lang") == "fr", 0.4499).when(c("lang") == "de", 0.45).otherwise(0.8).alias("best_similarity"),
    )


_RULE_INPUT = f"""base AS (SELECT d.doc_id, d.text AS customer_message,
  ({s.str_list(lx.INTENTS)})[length(d.source) + coalesce(l.quality, 0) * 4] AS predicted_intent,
  CASE l.toxic WHEN 1 THEN 0.4999::DOUBLE WHEN 0 THEN 0.5 ELSE 0.9 END AS confidence,
  CASE d.lang WHEN 'fr' THEN 0.4499::DOUBLE WHEN 'de' THEN 0.45 ELSE 0.8 END AS best
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def _rules(profile: str):
    base = {"runtime": RUNTIME, "batch": BATCH}[profile]
    return base.with_(
        security_terms=(*base.security_terms, *ABUSE), human_terms=(*base.human_terms, *URGENT),
        complaint_intent="Return / Refund", excluded_intent="Product / App / Website Issue",
    )


for _name, _profile in (("escalate_all_reasons", "runtime"), ("escalate_first_match", "batch")):
    _reason, _final = decide_sql(_rules(_profile), "customer_message")

    @query(_name, s.ctes(_RULE_INPUT, f"ruled AS (SELECT *, {_reason} AS reason FROM base)") + f"""
SELECT doc_id, predicted_intent, CASE WHEN reason IS NULL THEN 'AUTO_HANDLE' ELSE 'ESCALATE' END AS decision,
       {_final} AS escalation_reason FROM ruled""")
    def escalate(t, profile=_profile):
        return decisions.decide(rule_inputs(t), _rules(profile)).select(
            "doc_id", "predicted_intent", "decision", "escalation_reason"
        )


for _profile in ("runtime", "batch"):
    _cond = f"confidence < 0.5 OR best < 0.45"

    @query(f"response_{_profile}", s.ctes(_RULE_INPUT) + f"""
SELECT doc_id, predicted_intent, CASE WHEN {_cond} THEN {s.lit(lx.HANDOVER[_profile])}
       ELSE {template_sql(_profile)} END AS generated_response FROM base""")
    def response(t, profile=_profile):
        rows = rule_inputs(t).withColumn(
            "decision",
            F.when((F.col("confidence") < 0.5) | (F.col("best_similarity") < 0.45), "ESCALATE").otherwise("AUTO_HANDLE"),
        )
        return decisions.respond(rows, profile).select("doc_id", "predicted_intent", "generated_response")


# --- end to end ----------------------------------------------------------------------------

_OUT = (
    "query_id", "customer_message", "true_intent", "predicted_intent", "confidence", "decision",
    "escalation_reason", "best_similarity", "generated_response",
)

for _profile in ("runtime", "batch"):

    @query(f"triage_{_profile}", s.ctes(*triage_ctes(CONF[_profile])) + f"SELECT {', '.join(_OUT)} FROM tri")
    def triage_flow(t, profile=_profile):
        return triaged(t, CONF[profile])[0].select(*_OUT)


_FIELDS = {
    "runtime": ("customer", "response", "intent", "similarity", "score"),
    "batch": plan.CASE_FIELDS,
}
for _profile in ("runtime", "batch"):
    _r4 = _profile == "runtime"
    _text = """texts AS (SELECT c.query_id, c.rank, d.text AS customer, 'answer from ' || d.source AS response, c.intent,
      c.intent_confidence, {} AS similarity, {} AS score, c.intent_match
      FROM cases c JOIN documents d ON d.doc_id = c.history_id)""".format(
        *((round4("c.similarity"), round4("c.score")) if _r4 else ("c.similarity", "c.score"))
    )
    _wide = ", ".join(
        f"max({f}) FILTER (rank = {r}) AS retrieved_{r}_{f}" for r in range(1, 6) for f in _FIELDS[_profile]
    )

    @query(f"triage_wide_{_profile}", s.ctes(
        *triage_ctes(CONF[_profile]), _text, f"w AS (SELECT query_id, {_wide} FROM texts GROUP BY query_id)",
    ) + "SELECT tri.* , w.* EXCLUDE (query_id) FROM tri LEFT JOIN w ON w.query_id = tri.query_id")
    def triage_wide(t, profile=_profile):
        rows, found, history = triaged(t, CONF[profile], stored=True)
        return plan.triage_wide(rows, found, history, CONF[profile])


TRI = s.ctes(*triage_ctes(CONF["batch"]))


@query("run_summary", TRI + """SELECT count(*) AS n_messages, count(*) FILTER (decision = 'AUTO_HANDLE') AS n_auto,
count(*) FILTER (decision = 'ESCALATE') AS n_escalated, count(DISTINCT predicted_intent) AS n_intents,
round(avg(best_similarity), 6) AS mean_best_similarity FROM tri""")
def run_summary(t):
    return rounded(plan.run_summary(triaged(t, CONF["batch"])[0]), "mean_best_similarity")


@query("decision_mix", TRI + "SELECT decision, count(*) AS count FROM tri GROUP BY decision")
def decision_mix(t):
    return metrics.frequency(triaged(t, CONF["batch"])[0], "decision")


@query("reason_mix", s.ctes(*triage_ctes(CONF["runtime"])) + """
SELECT reason, count(*) AS count FROM (
  SELECT unnest(string_split(escalation_reason, '; ')) AS reason FROM tri WHERE decision = 'ESCALATE') GROUP BY reason""")
def reason_mix(t):
    return metrics.reason_mix(triaged(t, CONF["runtime"])[0].where("decision = 'ESCALATE'"), "escalation_reason")


# --- response screening --------------------------------------------------------------------


def screen_sql(response: str, intent: str = "predicted_intent") -> str:
    relevant = " ".join(
        f"WHEN {s.lit(i)} THEN {s.contains_any(response, words)}" for i, words in lx.INTENT_KEYWORDS.items()
    )
    return f"""length({s.strip(response)}) >= 20 AS response_present, {s.contains_any(response, lx.ACTION_TERMS)} AS actionable,
      NOT {s.contains_any(response, lx.SENSITIVE_TERMS)} AS safe, CASE lower({intent}) {relevant} ELSE true END AS intent_relevant"""


_SCORE = "response_present::INTEGER + actionable::INTEGER + safe::INTEGER + intent_relevant::INTEGER"


def screened_ctes(source: str, response: str = "generated_response", intent: str = "predicted_intent") -> list[str]:
    return [
        f"flags AS (SELECT *, {screen_sql(response, intent)} FROM {source})",
        f"""scr AS (SELECT *, {_SCORE} AS quality_score, CASE WHEN {_SCORE} = 4 THEN 'GOOD'
             WHEN {_SCORE} >= 2 THEN 'PARTIAL' ELSE 'POOR' END AS quality FROM flags)""",
    ]


# Responses of very different kinds over the whole documents table: templates of the true or a
# neighbouring intent, short texts, and the documents' own prose.
_ANSWERS = f"""answers AS (SELECT doc_id, predicted_intent, CASE
    WHEN confidence = 0.5 THEN {template_sql('runtime')}
    WHEN confidence < 0.5 THEN '  otp ' || doc_id || '  '
    WHEN best = 0.45 THEN {s.lit(lx.HANDOVER['batch'])} ELSE customer_message END AS generated_response FROM base)"""


def answers(t):
    rows = decisions.with_template(rule_inputs(t), "runtime")
    text = (
        F.when(F.col("confidence") == 0.5, F.col("template"))
        .when(F.col("confidence") < 0.5, F.concat(F.lit("  otp "), F.col("doc_id").cast("string"), F.lit("  ")))
        .when(F.col("best_similarity") == 0.45, lx.HANDOVER["batch"])
        .otherwise(F.col("customer_message"))
    )
    return rows.select("doc_id", "predicted_intent", text.alias("generated_response"))


SCREENED = s.ctes(_RULE_INPUT, _ANSWERS, *screened_ctes("answers"))

for _name, _flag in (
    ("resp_present", "response_present"), ("resp_actionable", "actionable"), ("resp_safe", "safe"),
    ("resp_relevant", "intent_relevant"),
):
    @query(_name, SCREENED + f"SELECT doc_id, {_flag} FROM scr")
    def flag(t, column=_flag):
        return quality.screen(answers(t)).select("doc_id", column)


@query("resp_quality", SCREENED + "SELECT doc_id, predicted_intent, quality_score, quality FROM scr")
def resp_quality(t):
    return quality.screen(answers(t)).select("doc_id", "predicted_intent", "quality_score", "quality")


def _summary_sql() -> str:
    parts = [
        ("Response Present %", "response_present"), ("Actionable %", "actionable"), ("Safe %", "safe"),
        ("Intent Relevant %", "intent_relevant"), ("GOOD %", "quality = 'GOOD'"),
        ("PARTIAL %", "quality = 'PARTIAL'"), ("POOR %", "quality = 'POOR'"),
    ]
    rows = ["SELECT 'Total Responses' AS metric, count(*)::DOUBLE AS value FROM scr"]
    rows += [f"SELECT {s.lit(k)}, round(100 * avg(({c})::INTEGER), 2) FROM scr" for k, c in parts]
    return " UNION ALL ".join(rows)


@query("resp_summary", SCREENED + _summary_sql())
def resp_summary(t):
    return quality.summary(quality.screen(answers(t)))


@query("resp_poor", SCREENED + """SELECT doc_id, predicted_intent, generated_response FROM scr
WHERE quality = 'POOR' ORDER BY doc_id LIMIT 10""")
def resp_poor(t):
    out = quality.poor_examples(quality.screen(answers(t)), "doc_id")
    return out.select("doc_id", "predicted_intent", "generated_response")


@query("triage_quality", s.ctes(*triage_ctes(CONF["batch"]), *screened_ctes("tri")) + _summary_sql())
def triage_quality(t):
    """Screening of the flow's own responses."""
    return quality.summary(quality.screen(triaged(t, CONF["batch"])[0]))


# --- failure mining ------------------------------------------------------------------------

_TABLES = [
    *triage_ctes(CONF["batch"]),
    "cls AS (SELECT query_id, customer_message, true_intent, predicted_intent FROM tri)",
    """ret AS (SELECT t.query_id, t.customer_message, t.true_intent AS corrected_intent, c.intent AS retrieved_1_intent
         FROM tri t LEFT JOIN cases c ON c.query_id = t.query_id AND c.rank = 1)""",
    """esc AS (SELECT t.query_id, t.customer_message, t.decision AS system_decision, t.escalation_reason AS system_reason,
         CASE WHEN l.toxic = 1 THEN 'ESCALATE' ELSE 'AUTO_HANDLE' END AS expected_decision
         FROM tri t JOIN labels l ON l.doc_id = t.query_id)""",
    *screened_ctes("tri"),
    """conf AS (SELECT true_intent, predicted_intent, count(*) AS n FROM cls WHERE true_intent <> predicted_intent
         GROUP BY ALL ORDER BY n DESC, 1, 2 LIMIT 1)""",
    "wrong AS (SELECT * FROM ret WHERE corrected_intent <> coalesce(retrieved_1_intent, ''))",
    "over AS (SELECT * FROM esc WHERE system_decision = 'ESCALATE' AND expected_decision = 'AUTO_HANDLE')",
    "missed AS (SELECT * FROM esc WHERE system_decision = 'AUTO_HANDLE' AND expected_decision = 'ESCALATE')",
]


def evaluation_tables(t):
    """(classified, retrieved, escalated, screened) of one batch run."""
    # The evaluators are separate steps over one stored run, as they would be in production.
    rows, found, _ = triaged(t, CONF["batch"], stored=True)
    rows = materialize(rows, "triaged")
    first = found.where(F.col("rank") == 1).select("query_id", F.col("intent").alias("retrieved_1_intent"))
    first = broadcast_if_small(first, session.NARROW)
    retrieved = rows.select(
        "query_id", "customer_message", F.col("true_intent").alias("corrected_intent")
    ).join(first, "query_id", "left")
    truth = t("labels").select(
        F.col("doc_id").alias("query_id"),
        F.when(F.col("toxic") == 1, "ESCALATE").otherwise("AUTO_HANDLE").alias("expected_decision"),
    )
    truth = broadcast_if_small(truth, session.NARROW)
    escalated = rows.select(
        "query_id", "customer_message", F.col("decision").alias("system_decision"),
        F.col("escalation_reason").alias("system_reason"),
    ).join(truth, "query_id")
    return rows, retrieved, escalated, quality.screen(rows)


def _mode_sql(rank: int, evidence: str, source: str) -> str:
    _, mode, hypothesis = lx.FAILURE_MODES[rank - 1]
    return (
        f"SELECT {rank} AS rank, {s.lit(mode)} AS failure_mode, {evidence} AS evidence, "
        f"{s.lit(hypothesis)} AS hypothesis FROM {source}"
    )


@query("failure_modes", s.ctes(*_TABLES) + " UNION ALL ".join([
    _mode_sql(1, "format('{} was predicted as {} {} times.', true_intent, predicted_intent, n)", "conf"),
    _mode_sql(2, "format('{} of {} Golden queries had a top-1 retrieval whose predicted intent did not match the expected intent.', count(*), (SELECT count(*) FROM ret))", "wrong"),
    _mode_sql(3, "format('{} routine cases were escalated although the expected decision was AUTO_HANDLE.', count(*))", "over"),
    _mode_sql(4, "format('{} cases required human handling but the system selected AUTO_HANDLE.', count(*))", "missed"),
    _mode_sql(5, "format('{} of {} responses were rated PARTIAL; intent relevance was only {:.2f}% in the automated response evaluation.', count(*) FILTER (quality = 'PARTIAL'), count(*), 100 * avg(intent_relevant::INTEGER))", "scr"),
]))
def failure_modes(t):
    return failures.failure_modes(*evaluation_tables(t))


def _example_sql(rank: int, source: str, actual: str, system: str, reason: str) -> str:
    return (
        f"(SELECT {rank} AS failure_rank, {s.lit(lx.EXAMPLE_MODES[rank - 1][1])} AS failure_mode, customer_message, "
        f"{actual} AS actual, {system} AS system_result, {reason} AS reason FROM {source} ORDER BY query_id LIMIT 2)"
    )


@query("failure_examples", s.ctes(*_TABLES) + " UNION ALL ".join([
    _example_sql(1, "(SELECT cls.* FROM cls JOIN conf USING (true_intent, predicted_intent))", "true_intent", "predicted_intent",
                 "format('This is an example of the most common classification confusion: {} → {}.', true_intent, predicted_intent)"),
    _example_sql(2, "wrong", "corrected_intent", "retrieved_1_intent", s.lit(lx.RETRIEVAL_EXAMPLE_REASON)),
    _example_sql(3, "over", "expected_decision", "system_decision", "system_reason"),
    _example_sql(4, "missed", "expected_decision", "system_decision", "system_reason"),
    _example_sql(5, "scr WHERE quality = 'PARTIAL'", "predicted_intent", "generated_response", s.lit(lx.RESPONSE_EXAMPLE_REASON)),
]))
def failure_examples(t):
    return failures.failure_examples(*evaluation_tables(t))
