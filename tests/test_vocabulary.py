import math
from collections import Counter

import pytest
from frames import rows
from pyspark.sql import functions as F

from deskwise import session
from deskwise.operators import features as ft
from deskwise.operators import joins

DOCS = [(1, ["b", "a", "b", "c"]), (2, ["a", "é"]), (3, []), (4, None), (5, ["a"] * 40 + ["b"]), (5, ["b", "c"]), (None, ["c", "a"])]


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame(DOCS, "id long, terms array<string>").repartition(3)


def brute(min_df, sublinear=False):
    df = Counter(t for _, ts in DOCS for t in set(ts or []))
    out = []
    for i, ts in DOCS:
        tf = {t: n for t, n in Counter(ts or []).items() if df[t] >= min_df}
        w = {t: ((1 + math.log(n)) if sublinear else n) * (math.log((1 + len(DOCS)) / (1 + df[t])) + 1) for t, n in tf.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out += [(i, t, round(x / norm, 9)) for t, x in w.items()]
    return sorted(out, key=repr)


def test_counted(docs):
    got = docs.select("id", ft.counted(F.col("terms")).alias("e")).collect()
    assert sorted((r.id, [tuple(e) for e in r.e]) for r in got if r.id) == sorted((i, sorted(Counter(ts or []).items())) for i, ts in DOCS if i)


@pytest.mark.parametrize("sublinear", [False, True])
@pytest.mark.parametrize("limits", [(200_000, 1_000_000), (0, 2)])
def test_every_term_has_a_weight(docs, monkeypatch, limits, sublinear):
    """With the lookup broadcast, and with the hot term's rows dealt to several tasks."""
    monkeypatch.setattr(session, "MAX_BROADCAST_ROWS", limits[0])
    monkeypatch.setattr(joins, "ROWS_PER_TASK", limits[1])
    for min_df in (1, 2, 3):
        found = ft.tfidf_long(docs, "id", min_df=min_df, max_features=None, sublinear=sublinear)
        assert sorted(((r.id, r.term, round(r.tfidf, 9)) for r in found.collect()), key=repr) == brute(min_df, sublinear)


def test_a_limit_beyond_the_vocabulary_changes_nothing(docs):
    a, b = (ft.tfidf_long(docs.where("id < 5"), "id", min_df=1, max_features=n).withColumn("tfidf", F.round("tfidf", 9)) for n in (100, None))
    assert rows(a, "id", "term") == rows(b, "id", "term")
    assert ft.vocabulary(docs, min_df=2, max_features=None).count() == 3
    assert ft.tfidf_long(docs, "id", min_df=9, max_features=None).count() == 0
    assert ft.tfidf_long(docs.limit(0), "id", max_features=None).count() == 0


def test_ids_are_gapless(spark):
    terms = spark.range(5000).select(F.concat(F.lit("t"), "id").alias("term"), F.col("id").alias("df"))
    found = ft.term_ids(terms).collect()
    assert sorted(r.term_id for r in found) == list(range(5000)) and len({r.term for r in found}) == 5000
