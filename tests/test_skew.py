"""Plans that hold when one key has a third of the rows, and both sides of every switch by size."""

import pytest
from frames import rows

from deskwise import session
from deskwise.operators import curation as cu
from deskwise.operators import joins
from deskwise.operators import ranking as rk


@pytest.mark.parametrize("stretch", [1, 2, 4, 1 << 16])
def test_pairs_over_gaps_and_stretches(spark, monkeypatch, stretch):
    monkeypatch.setattr(cu, "STRETCH", stretch)
    turns = [
        (1, 0, "user", "q0"), (1, 3, "assistant", "a3"), (1, 4, "user", "q4"), (1, 5, "user", "q5"),
        (1, 90, "assistant", "a90"), (1, 91, "assistant", "a91"), (1, 92, "user", "q92"),
        (2, 1, "assistant", "a1"), (2, 2, "user", "q2"), (2, 3, "system", "s3"), (2, 4, "assistant", "a4"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    got = rows(cu.pair_turns(df).select("message_id", "response_id", "customer_message", "agent_response"), "message_id")
    assert got == [("1-0", "1-3", "q0", "a3"), ("1-5", "1-90", "q5", "a90")]
    assert cu.pair_turns(df.limit(0)).count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_anti", "left_semi"])
@pytest.mark.parametrize("sizes", [(200_000, 1_000_000), (3, 50), (3, 10), (0, 10)])
def test_lookup_join_is_the_same_on_both_sides_of_the_switch(spark, monkeypatch, how, sizes):
    """A hot key (a third of 300 rows, equal rows among them), null keys, keys without a partner."""
    data = [("hot", i // 40) for i in range(100)] + [(None, i) for i in range(60)]
    data += [(f"k{i % 20}", i) for i in range(140)]
    df = spark.createDataFrame(data, "k string, v int").repartition(5)
    lookup = spark.createDataFrame([("hot",)] + [(f"k{i}",) for i in range(0, 30, 2)], "__key string")
    want = rows(df.join(lookup, df.k == lookup["__key"], how), "k", "v")
    monkeypatch.setattr(session, "MAX_BROADCAST_ROWS", sizes[0])
    monkeypatch.setattr(joins, "ROWS_PER_TASK", sizes[1])
    assert rows(joins.lookup_join(df, "k", lookup, "__key", how), "k", "v") == want


def test_cutoff_search_sorts_few_positions(spark, monkeypatch):
    monkeypatch.setattr(rk, "FEW", 5)
    monkeypatch.setattr(rk, "PARTS", 7)
    df = spark.range(3000).selectExpr("id * id * 1000003 - 500 AS pos")
    for n in (1, 2, 17, 1500, 2999):
        assert rk.cutoff(df, "pos", n) == (n - 1) ** 2 * 1000003 - 500
    assert rk.cutoff(df, "pos", 3000) is None
    assert rk.cutoff(df.limit(0), "pos", 3) is None


def test_rows_go_through_the_filter_once(spark):
    df = spark.range(40_000).withColumnRenamed("id", "pos")
    seen = spark.sparkContext.accumulator(0)

    def keep(part):
        seen.add(part.count())
        return part.where("pos % 10000 = 7")

    assert [r[0] for r in rows(rk.first_n_kept(df, "pos", 3, keep), "pos")] == [7, 10007, 20007]
    assert seen.value <= 40_000


def test_a_lookup_of_texts_is_measured_before_its_rows_are_moved(spark, monkeypatch):
    """A limit gathers its rows in one task, texts and all; sizes are added up without that."""
    df = spark.createDataFrame([(i, "x" * 100, [i]) for i in range(50)], "k int, text string, l array<int>").repartition(4)
    limited, limit = [], type(df).limit
    monkeypatch.setattr(type(df), "limit", lambda self, n: limited.append(n) or limit(self, n))
    assert session.small_table(df, max_rows=49) is None and session.small_table(df, max_bytes=5000) is None
    assert set(limited) <= {1}  # the sums themselves
    assert rows(session.small_table(df, max_rows=50), "k") == rows(df, "k") and session.small_table(df.select("k"), max_rows=49) is None
