import pytest
from frames import rows
from pyspark.sql import functions as F

from deskwise import session
from deskwise.catalog import triage as tri
from deskwise.config import BATCH, RUNTIME
from deskwise.functions import lexicon as lx
from deskwise.operators import decisions as dc
from deskwise.plans import triage as plan
from deskwise.session import tables

CLAIM = "Return / Refund"


def decide(spark, cfg, *cases):
    df = spark.createDataFrame(
        [(i, *c) for i, c in enumerate(cases)],
        "i int, predicted_intent string, confidence double, best_similarity double, customer_message string",
    )
    return [r[1:] for r in rows(dc.decide(df, cfg).select("i", "decision", "escalation_reason"), "i")]


def test_thresholds_are_strict(spark):
    calm = lx.REASONS["runtime"]["none"]
    assert decide(
        spark, RUNTIME, (CLAIM, 0.5, 0.45, "x"), (CLAIM, 0.4999, 0.45, "x"), (CLAIM, 0.5, 0.4499, "x")
    ) == [
        ("AUTO_HANDLE", calm),
        ("ESCALATE", "low classification confidence (0.50)"),
        ("ESCALATE", "weak historical similarity (0.45)"),
    ]


def test_all_reasons_against_first_reason(spark):
    case = ("Customer Support / Complaint", 0.1763, 0.2, "My PASSWORD was hacked, get me an agent")
    assert decide(spark, RUNTIME, case) == [(
        "ESCALATE",
        "low classification confidence (0.18); weak historical similarity (0.20); "
        "account/security issue requires human review; customer requests or indicates need for human support; "
        "support complaint should be handled by a human",
    )]
    assert decide(spark, BATCH, case) == [("ESCALATE", "Low classification confidence")]
    sure = (*case[:1], 0.9, 0.9, *case[3:])
    assert decide(spark, BATCH, sure) == [("ESCALATE", "Account/security issue")]


@pytest.mark.parametrize("cfg", [RUNTIME, BATCH])
def test_every_phrase_escalates(spark, cfg):
    phrases = [*cfg.security_terms, *cfg.human_terms]
    got = decide(spark, cfg, *[(CLAIM, 0.9, 0.9, f"..{p.upper()}..") for p in phrases])
    assert {d for d, _ in got} == {"ESCALATE"}


def test_profiles_list_different_phrases(spark):
    only_runtime = (CLAIM, 0.9, 0.9, "this is fraud")
    only_batch = (CLAIM, 0.9, 0.9, "someone help me")
    assert decide(spark, RUNTIME, only_runtime, only_batch)[0][0] == "ESCALATE"
    assert [d for d, _ in decide(spark, BATCH, only_runtime, only_batch)] == ["AUTO_HANDLE", "ESCALATE"]
    assert [d for d, _ in decide(spark, RUNTIME, only_batch)] == ["AUTO_HANDLE"]


def test_intent_rules(spark):
    got = decide(spark, RUNTIME, (lx.COMPLAINT, 0.9, 0.9, "x"), (lx.NON_ACTIONABLE, 0.9, 0.9, "x"))
    assert [r for _, r in got] == ["support complaint should be handled by a human", "message is non-actionable"]


@pytest.mark.parametrize("profile", ["runtime", "batch"])
def test_templates(spark, profile):
    data = [(i, d) for i in (*lx.INTENTS, "unknown", None) for d in ("AUTO_HANDLE", "ESCALATE")]
    df = spark.createDataFrame(data, "predicted_intent string, decision string")
    for r in dc.respond(df, profile).collect():
        texts = lx.TEMPLATES[profile]
        auto = texts.get(r["predicted_intent"], lx.FALLBACK[profile])
        assert r["generated_response"] == (auto if r["decision"] == "AUTO_HANDLE" else lx.HANDOVER[profile])
    assert len(lx.RUNTIME_TEMPLATES) == 12 and len(lx.BATCH_TEMPLATES) == 11


def test_query_without_cases_is_escalated(spark):
    queries = spark.createDataFrame(
        [(1, "where is it", CLAIM, 0.9), (2, "no case", CLAIM, 0.9)],
        "query_id long, customer_message string, predicted_intent string, confidence double",
    )
    cases = spark.createDataFrame([(1, 1, 0.70124), (1, 2, 0.9)], "query_id long, rank int, similarity double")
    got = rows(plan.triage(queries, cases, RUNTIME).select("query_id", "decision", "best_similarity"), "query_id")
    assert got == [(1, "AUTO_HANDLE", 0.7012), (2, "ESCALATE", 0.0)]
    assert plan.triage(queries, cases, BATCH).where("query_id = 1").first()["best_similarity"] == 0.9
    summary = plan.run_summary(plan.triage(queries, cases, RUNTIME)).first()
    assert summary[:4] == (2, 1, 1, 1)


def test_demo_messages(spark):
    """"cannot log into" holds the phrase "cannot log in"; "customer service" is a phrase."""
    df = spark.createDataFrame(
        [(i, CLAIM, 0.9, 0.9, m) for i, m in enumerate(lx.DEMO_MESSAGES)],
        "i int, predicted_intent string, confidence double, best_similarity double, customer_message string",
    )
    got = rows(dc.decide(df, RUNTIME).select("i", "decision"), "i")
    assert [i for i, d in got if d == "ESCALATE"] == [4, 5]


def test_blank_messages_are_set_apart(spark):
    df = spark.createDataFrame([("ok then",), ("  ",), (None,), ("@you https://x.y",)], "customer_message string")
    good, bad = plan.split_valid(df)
    assert good.count() == 1 and bad.count() == 3


def test_decision_normaliser(spark):
    df = spark.createDataFrame([(" escalate \n",)], "d string")
    assert df.select(dc.normalise_decision(F.col("d"))).first()[0] == "ESCALATE"


def test_every_document_with_text_is_a_message(spark):
    from deskwise.catalog.triage import messages

    rows = [(1, "Where is my parcel? Where?", "web"), (2, "  ", "web"), (3, None, "forum"), (4, "?!", "news")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality long")
    got = {r["query_id"]: r for r in messages(docs, lambda name: labels).collect()}
    assert sorted(got) == [1, 4]
    assert abs(sum(x * x for x in got[1]["embedding"]) - 1) < 1e-6
    assert sorted(set(got[1]["embedding"]))[-1] == max(got[1]["embedding"]) and sum(got[4]["embedding"]) == 0
    assert got[1]["true_intent"] != got[4]["true_intent"]


def test_texts_are_not_shuffled_while_the_other_side_can_be_sent(spark, monkeypatch):
    """Labels and best similarities are sent to the texts, whatever the optimizer thinks of their size; too many are shuffled, with the same rows."""
    t = tables(spark, "/root/testdata/sf0.001")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sent, _, _ = tri.triaged(t, tri.CONF["batch"])
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (tri.messages(tri.docs(t), t), sent)]
        assert not any("SortMergeJoin" in p for p in plans)
        monkeypatch.setattr(session, "NARROW", 3)
        shuffled, _, _ = tri.triaged(t, tri.CONF["batch"])
        assert "SortMergeJoin" in shuffled._jdf.queryExecution().executedPlan().toString()
        assert rows(shuffled, "query_id") == rows(sent, "query_id") and sent.count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
