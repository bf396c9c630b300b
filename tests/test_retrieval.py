import tracemalloc

import numpy as np
import pytest
from frames import rows
from pyspark.sql import functions as F

from deskwise.operators import retrieval as rt


def frame(spark, ids, vectors, kind="long", name="history_id", extra=None):
    data = [(i, [float(x) for x in v], *( [extra[n]] if extra else [])) for n, (i, v) in enumerate(zip(ids, vectors))]
    schema = f"{name} {kind}, embedding array<float>" + (", intent string" if extra else "")
    return spark.createDataFrame(data, schema).repartition(5)


def unit(matrix):
    return (matrix / np.linalg.norm(matrix, axis=1, keepdims=True)).astype(np.float32)


def brute(qids, queries, hids, history, k, exclude_self=False):
    sims = np.rint(queries.astype(np.float64) @ history.astype(np.float64).T * 1e6) / 1e6
    out = set()
    for i, q in enumerate(qids):
        order = sorted(
            (j for j in range(len(hids)) if not (exclude_self and hids[j] == q)),
            key=lambda j: (-sims[i, j], hids[j]),
        )[:k]
        out |= {(q, hids[j], float(sims[i, j]), r) for r, j in enumerate(order, 1)}
    return out


def found(df):
    cols = ("query_id", "history_id", "similarity", "semantic_rank")
    return {tuple(r[c] for c in cols) for r in df.collect()}


@pytest.fixture(scope="module")
def crowded():
    """A third of the history in one tight spot with many exact copies, the rest spread out."""
    rng = np.random.default_rng(3)
    spot = np.repeat(unit(rng.normal(size=(20, 8))[:1] + 0.01 * rng.normal(size=(20, 8))), 10, axis=0)
    return unit(rng.normal(size=(30, 8))), np.vstack([spot, unit(rng.normal(size=(400, 8)))])


@pytest.mark.parametrize(
    "options", [{"strategy": "broadcast"}, {"strategy": "grid", "block_rows": 16}, {"strategy": "grid", "n_pivots": 1}]
)
def test_strategies_equal_brute_force(spark, crowded, options):
    queries, history = crowded
    queries = np.vstack([queries, history[:5]])
    qids, hids = list(range(len(queries))), list(range(1000, 1000 + len(history)))
    got = rt.semantic_candidates(
        frame(spark, qids, queries, name="query_id"), frame(spark, hids, history), k=12, **options
    )
    assert found(got) == brute(qids, queries, hids, history, 12)


@pytest.mark.parametrize("strategy", ["broadcast", "grid"])
def test_own_row_is_left_out_and_small_history_is_returned_whole(spark, crowded, strategy):
    vectors = crowded[0][:7]
    ids = [f"m{i}" for i in range(7)]
    got = rt.semantic_candidates(
        frame(spark, ids, vectors, "string", "query_id"), frame(spark, ids, vectors, "string"),
        k=50, exclude_self=True, strategy=strategy,
    )
    assert found(got) == brute(ids, vectors, ids, vectors, 50, True)
    assert got.count() == 42


def test_size_decides_the_strategy(spark, crowded, monkeypatch):
    queries, history = crowded
    q, h = frame(spark, range(30), queries, name="query_id"), frame(spark, range(600), history)
    used = []
    grid = rt._grid_search
    monkeypatch.setattr(rt, "_grid_search", lambda *a: used.append("grid") or grid(*a))
    rt.semantic_candidates(q, h, k=3, max_broadcast_bytes=30 * 8 * 8)
    assert used == []
    rt.semantic_candidates(q, h, k=3, max_broadcast_bytes=30 * 8 * 8 - 1)
    assert used == ["grid"]


def test_rows_without_vector_and_empty_queries(spark, crowded):
    q = spark.createDataFrame([(1, None), (2, [1.0, 0.0])], "query_id long, embedding array<float>")
    h = spark.createDataFrame([(5, [0.6, 0.8]), (6, None)], "history_id long, embedding array<float>")
    for strategy in ("broadcast", "grid"):
        assert found(rt.semantic_candidates(q, h, strategy=strategy)) == {(2, 5, 0.6, 1)}
        assert rt.semantic_candidates(q, h.where("false"), strategy=strategy).count() == 0
        assert rt.semantic_candidates(q.where("false"), h, strategy=strategy).count() == 0


def candidates(spark, similarities, intents):
    data = [(1, i, s, i, intent) for i, (s, intent) in enumerate(zip(similarities, intents), 1)]
    return spark.createDataFrame(data, "query_id long, history_id long, similarity double, semantic_rank int, intent string")


def test_rerank_prefers_the_matching_intent(spark):
    query = spark.createDataFrame([(1, "A")], "query_id long, predicted_intent string")
    got = rt.rerank(candidates(spark, [0.8305, 0.7058, 0.6497], ["B", "B", "A"]), query)
    assert rows(got.select("rank", "history_id", "score"), "rank") == [
        (1, 3, 0.71976), (2, 1, 0.6644), (3, 2, 0.56464),
    ]
    match = rt.rerank(candidates(spark, [0.8305], ["A"]), query).first()
    assert round(match["score"], 4) == 0.8644 and match["intent_match"] == 1
    best = {p: rt.best_similarity(got, p).first()["best_similarity"] for p in ("runtime", "batch")}
    assert best == {"runtime": 0.6497, "batch": 0.8305}


def test_ties_keep_semantic_order_and_late_match_cannot_enter(spark):
    query = spark.createDataFrame([(1, "A")], "query_id long, predicted_intent string")
    tied = rt.rerank(candidates(spark, [0.5] * 8, ["B"] * 8), query)
    assert [r["history_id"] for r in tied.orderBy("rank").collect()] == [1, 2, 3, 4, 5]
    pool = [0.9 - i / 1000 for i in range(51)]
    pairs = candidates(spark, pool, ["B"] * 50 + ["A"]).drop("semantic_rank")
    got = rt.rerank(rt.top_candidates(pairs, 50), query)
    assert 51 not in {r["history_id"] for r in got.collect()}


def test_shapes(spark):
    query = spark.createDataFrame([(1, "A")], "query_id long, predicted_intent string")
    cases = rt.rerank(candidates(spark, [0.9, 0.8], ["A", "B"]), query)
    wide = rt.wide_cases(cases, ["history_id", "similarity"], 3).first().asDict()
    assert wide["retrieved_1_history_id"] == 1 and wide["retrieved_2_similarity"] == 0.8
    assert wide["retrieved_3_history_id"] is None
    nested = rt.nested_cases(cases, ["history_id", "intent"]).first()["retrieved"]
    assert [(c["rank"], c["intent"]) for c in nested] == [(1, "A"), (2, "B")]


def test_two_windows_share_one_shuffle(spark, crowded):
    queries, history = crowded
    intents = ["A", "B"] * 300
    q = frame(spark, range(30), queries, name="query_id").withColumn("predicted_intent", F.lit("A"))
    found_rows = rt.semantic_candidates(q, frame(spark, range(600), history, extra=intents), 10, ("intent",))
    plan = rt.rerank(found_rows, q)._jdf.queryExecution().executedPlan().toString()
    # One exchange for the candidates, at most one for the intents joined to them.
    assert 1 <= plan.count("Exchange hashpartitioning(query_id") <= 2 and "CartesianProduct" not in plan


def test_ragged_vectors_are_refused(spark):
    q = spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<float>")
    h = spark.createDataFrame([(5, [0.6]), (6, [1.0, 0.0, 0.0])], "history_id long, embedding array<float>").coalesce(1)
    with pytest.raises(Exception, match="differ in length"):
        rt.semantic_candidates(q, h).count()


def test_stored_index_serves_many_batches(spark, crowded, tmp_path):
    queries, history = crowded
    hids = list(range(600))
    made = rt.index_history(frame(spark, hids, history), path=str(tmp_path / "index"))
    assert made.sizes.sum() == 600
    index = rt.load_index(spark, str(tmp_path / "index"))
    for part in (range(0, 10), range(10, 30)):
        got = rt.semantic_candidates(
            frame(spark, part, queries[list(part)], name="query_id"), None, k=7, strategy="grid", index=index
        )
        assert found(got) == brute(list(part), queries[list(part)], hids, history, 7)


def test_far_cells_are_not_visited(spark):
    """Tight, distant groups: the second round has nothing left to visit."""
    rng = np.random.default_rng(5)
    centres = np.eye(6)
    history = unit(np.repeat(centres, 100, axis=0) + 0.01 * rng.normal(size=(600, 6)))
    index = rt.index_history(frame(spark, range(600), history))
    queries = frame(spark, range(6), unit(centres), name="query_id")
    q = rt.vectors_of(queries, "query_id")
    near = rt._nearest_cells(q, index.pivots, index.sizes, 5)
    visited = rt._reachable_cells(near.withColumn("bound", F.lit(0.99)), index.pivots, index.radii, index.sizes)
    left = {r["query_id"]: len(r["cells"]) for r in visited.collect()}
    assert max(left.values()) < (index.sizes > 0).sum() / 2
    assert found(rt.semantic_candidates(queries, None, k=5, strategy="grid", index=index)) == brute(
        list(range(6)), unit(centres), list(range(600)), history, 5
    )


def test_grid_search_emits_few_rows(spark, monkeypatch):
    """Before the last ranking there are at most three times the wanted rows, not nearly all pairs."""
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    queries = vectors.select(F.col("vec_id").alias("query_id"), "embedding")
    history = vectors.select(F.col("vec_id").alias("history_id"), "embedding")
    ranked, emitted = rt.top_candidates, []

    def counted(pairs, k):
        emitted.append(pairs.count())
        return ranked(pairs, k)

    want = found(rt.semantic_candidates(queries, history, exclude_self=True, strategy="broadcast"))
    monkeypatch.setattr(rt, "top_candidates", counted)
    assert found(rt.semantic_candidates(queries, history, exclude_self=True, strategy="grid", block_rows=256)) == want
    assert sum(emitted) <= 3 * 50 * queries.count()


def peak_mb(run):
    tracemalloc.start()
    try:
        out = run()
        return out, tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()


def test_running_best_equals_brute_force_in_little_memory():
    rng = np.random.default_rng(7)
    vectors = unit(rng.normal(size=(6000, 16)))
    vectors[1000:1600] = vectors[1000]  # copies: the lowest ids win
    ids, asked = rng.permutation(6000) + 100, np.arange(0, 6000, 3)
    best = rt.Best(ids[asked], vectors[asked].astype(float), 20, True)

    def run():
        for i in range(0, 6000, 4000):
            best.add(rt.Items(ids[i : i + 4000], vectors[i : i + 4000].astype(float), [ids[i : i + 4000] * 2]))
        return best.columns()

    (qids, hids, sims, twice), peak = peak_mb(run)
    got = sorted(zip(qids.tolist(), (-sims).tolist(), hids.tolist()))
    want = brute(ids[asked].tolist(), vectors[asked], ids.tolist(), vectors, 20, True)
    assert got == sorted((q, -s, h) for q, h, s, _ in want) and (twice == 2 * hids).all()
    assert peak < 100  # all pairs of a block were in memory several times: 360 MB


def test_what_tasks_keep_decides_the_strategy_too(spark, crowded, monkeypatch):
    q, h = frame(spark, range(30), crowded[0], name="query_id"), frame(spark, range(600), crowded[1])
    used, grid = [], rt._grid_search
    monkeypatch.setattr(rt, "_grid_search", lambda *a: used.append("grid") or grid(*a))
    monkeypatch.setattr(rt, "MAX_KEPT", 90, raising=False)
    want = found(rt.semantic_candidates(q, h, k=3))
    assert used == []
    monkeypatch.setattr(rt, "MAX_KEPT", 89, raising=False)
    assert found(rt.semantic_candidates(q, h, k=3)) == want and used == ["grid"]


def test_a_cell_is_searched_only_where_its_angles_can_reach_the_bound():
    rng = np.random.default_rng(11)
    history = unit(np.array([4, 1, 1, 1, 1, 1]) * rng.normal(size=(3000, 6))).astype(np.float64)
    queries, pivot, ids = history[:40], history[7], np.arange(3000)
    sims = np.rint(queries @ history.T * rt.SCALE) / rt.SCALE
    bound = np.sort(sims, axis=1)[:, -10]
    best, pairs = rt.Best(ids[:40], queries, 10, False, bound), []
    add = best._add
    best._add = lambda rows, items, allowed: pairs.append(len(rows) * len(items.ids)) or add(rows, items, allowed)
    rt.Shells(pivot, ids, history, [ids % 7], 64).visit(best, np.arange(40))
    qids, hids, found_sims, carried = best.columns()
    got = {(int(q), int(h), float(x), int(c)) for q, h, x, c in zip(qids, hids, found_sims, carried)}
    want = {(i, int(j), float(sims[i, j]), int(j % 7)) for i in range(40) for j in sorted(range(3000), key=lambda j: (-sims[i, j], j))[:10]}
    assert got == want
    assert sum(pairs) < 40 * 3000 / 2


def test_without_a_bound_or_with_rows_that_are_no_numbers_a_cell_is_searched_whole():
    rng = np.random.default_rng(12)
    history = unit(rng.normal(size=(200, 6))).astype(np.float64)
    history[3], history[50] = np.nan, 0.0
    queries, ids = np.vstack([np.zeros(6), history[60:64]]), np.arange(200)
    best = rt.Best(np.arange(5), queries, 5, False)
    rt.Shells(history[9], ids, history, [], 16).visit(best, np.arange(5))
    sims = np.rint(queries @ np.nan_to_num(history).T * rt.SCALE) / rt.SCALE
    known = [j for j in range(200) if j != 3]
    want = {(i, j, float(sims[i, j])) for i in range(5) for j in sorted(known, key=lambda j: (-sims[i, j], j))[:5]}
    assert {(int(q), int(h), float(x)) for q, h, x in zip(*best.columns())} == want


def test_small_angles_do_not_suffer_from_lengths_that_are_rounded():
    rows = unit(np.random.default_rng(13).normal(size=(500, 64))).astype(np.float64)
    assert np.diag(rt._angles(rows, rows)).max() < 1e-7


def test_a_part_of_the_history_gives_bounds_that_few_further_rows_reach(spark, monkeypatch):
    """Vectors like word counts: what the second round emits is less than what is wanted."""
    rng = np.random.default_rng(17)
    vectors = unit(rng.gamma(0.4, size=(12000, 1)) * rng.dirichlet(np.full(12, 0.5), 12000) + 0.02)
    asked = list(range(0, 12000, 60))
    queries, history = frame(spark, asked, vectors[asked], name="query_id"), frame(spark, range(12000), vectors)
    ranked, ranks = rt.top_candidates, []
    monkeypatch.setattr(rt, "top_candidates", lambda pairs, k: ranks.append(pairs.count()) or ranked(pairs, k))
    got = found(rt.semantic_candidates(queries, history, 5, strategy="grid", block_rows=64))
    assert got == brute(asked, vectors[asked], list(range(12000)), vectors, 5)
    assert ranks[-1] <= 2 * 5 * len(asked)


@pytest.mark.parametrize("block_rows", [16, 4096])
def test_history_that_is_sent_and_history_that_is_shuffled_give_the_same(spark, crowded, monkeypatch, block_rows):
    """A row that is no number, strings as ids and carried columns; chunks smaller than the crowded cell."""
    queries, history = crowded
    history = np.vstack([history, np.full((1, 8), np.nan)])
    ids = [f"h{i:03d}" for i in range(len(history))]
    h = frame(spark, ids, history, "string", extra=["A", None, "B"] * 300)
    q = frame(spark, [*range(30), *range(30, 40)], np.vstack([queries, history[:10]]), name="query_id")
    monkeypatch.setattr(rt, "CHUNK_NUMBERS", 8 * 50)
    got = []
    for most in (4 << 30, 0):
        monkeypatch.setattr(rt, "MAX_SHIPPED", most)
        df = rt.semantic_candidates(q, h, 9, ["intent"], strategy="grid", block_rows=block_rows)
        got.append(rows(df.select("query_id", "semantic_rank", "history_id", "similarity", "intent"), "query_id", "semantic_rank"))
    assert got[0] == got[1] and len(got[0]) == 40 * 9
    whole = rt.semantic_candidates(q, h, 9, strategy="broadcast")
    assert [r[:4] for r in got[0]] == rows(whole.select("query_id", "semantic_rank", "history_id", "similarity"), "query_id", "semantic_rank")


def test_history_is_not_repeated_in_the_shuffle(spark, monkeypatch):
    """Queries are dealt out once and go through the history that was sent; vectors were shuffled once for each of 16 shares and 16 stretches."""
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    queries = vectors.select(F.col("vec_id").alias("query_id"), "embedding")
    index = rt.index_history(vectors.select(F.col("vec_id").alias("history_id"), "embedding"))
    df = rt.semantic_candidates(queries, None, 5, strategy="grid", index=index)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" not in text and "MapInArrow search" in text
    sent = index.chunks
    again = rt.semantic_candidates(queries, None, 5, strategy="grid", index=index)
    assert index.chunks is sent and found(again) == found(df)
