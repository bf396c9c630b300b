import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from deskwise.operators import quantised as qz
from deskwise.operators import retrieval as rt


def unit(n, dims, seed, spread=1.0, centres=8):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(centres, dims))[rng.integers(0, centres, n)] * spread + rng.normal(size=(n, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, vectors, name="history_id"):
    rows = [(k, v.tolist(), f"intent {k % 3}") for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"{name} long, embedding array<float>, intent string")


def test_similarities_are_exact_and_the_work_is_bounded(spark):
    history, queries = frame(spark, unit(600, 24, 0)), frame(spark, unit(40, 24, 1), "query_id").drop("intent")
    index = qz.index_quantised(history, ["intent"], subspaces=8, codewords=64)
    found = qz.quantised_candidates(queries, index, k=10, carry=["intent"], rescore=60)
    assert found.groupBy("query_id").count().where("count <> 10").count() == 0
    exact = rt.semantic_candidates(queries, history, k=600, carry=["intent"]).drop("semantic_rank")
    both = found.join(exact.withColumnRenamed("similarity", "truth"), ["query_id", "history_id", "intent"])
    assert both.count() == 400 and both.where("abs(similarity - truth) > 1.5e-6").count() == 0
    share = qz.recall(found, rt.semantic_candidates(queries, history, k=10)).first()
    assert (share.n_queries, share.n_true) == (40, 400) and share.recall >= 0.95


def test_blocks_of_any_size_and_probing_all_cells_agree(spark):
    history, queries = frame(spark, unit(300, 16, 2)), frame(spark, unit(30, 16, 3), "query_id")
    index = qz.index_quantised(history, subspaces=4, codewords=64)
    asked = queries.select("query_id", F.col("embedding").alias("vector"))

    def best(**sizes):
        rows = rt.top_candidates(qz.approximate(asked, index, 20, **sizes), 20)
        return sorted((r.query_id, r.history_id, round(r.similarity, 9)) for r in rows.collect())

    assert best() == best(query_rows=7, code_rows=50) == best(probe_share=1.0, code_rows=13)
    codes = index.codes.toArrow()
    rows = qz.decoded(np.frombuffer(b"".join(codes["code"].to_pylist()), np.uint8).reshape(-1, 4), codes["cell"].to_numpy(), index.books, index.filed.pivots)
    vectors = {r.history_id: r.vector for r in index.filed.rows.collect()}
    error = [np.linalg.norm(v - vectors[i]) for i, v in zip(codes["history_id"].to_pylist(), rows, strict=True)]
    assert np.mean(error) < 0.5


def test_nearest_cells_suffice_where_vectors_form_groups(spark):
    history, queries = frame(spark, unit(800, 16, 4, 4.0)), frame(spark, unit(50, 16, 4, 4.0), "query_id")
    index = qz.index_quantised(history, subspaces=8)
    truth = rt.semantic_candidates(queries, history, k=10)
    assert qz.recall(qz.quantised_candidates(queries, index, k=10, probe_share=0.4), truth).first().recall >= 0.95


def test_an_index_is_loaded_again_and_odd_inputs(spark, tmp_path):
    history = frame(spark, unit(50, 7, 5)).unionByName(frame(spark, unit(1, 7, 6)).select(F.lit(99).cast("long").alias("history_id"), F.lit(None).cast("array<float>").alias("embedding"), "intent"))
    built = qz.index_quantised(history, ["intent"], subspaces=3, path=str(tmp_path / "index"))
    again = qz.load_quantised(spark, str(tmp_path / "index"))
    queries = frame(spark, unit(5, 7, 7), "query_id")
    a, b = (sorted(map(tuple, qz.quantised_candidates(queries, i, k=60).collect())) for i in (built, again))
    assert a == b and len(a) == 5 * 50
    assert qz.quantised_candidates(queries.where("false"), again).count() == 0
    with pytest.raises(ValueError):
        qz.index_quantised(history, codewords=300)


def test_an_empty_history(spark):
    index = qz.index_quantised(frame(spark, unit(3, 8, 8)).where("false"))
    assert qz.quantised_candidates(frame(spark, unit(3, 8, 9), "query_id"), index).count() == 0


def test_decoded_scores_need_little_memory():
    history, queries = unit(4 * qz.CODES_AT_ONCE, 16, 8), unit(512, 16, 9)
    best = rt.Best(np.arange(512), queries, 150, False, scale=None)
    tracemalloc.start()
    for at in range(0, len(history), qz.CODES_AT_ONCE):
        best.add(rt.Items(np.arange(at, at + qz.CODES_AT_ONCE), history[at : at + qz.CODES_AT_ONCE]))
    row, ids, scores = best.columns()
    peak = tracemalloc.get_traced_memory()[1] / 2**20
    tracemalloc.stop()
    truth = queries @ history.T
    assert np.allclose(scores, truth[row, ids]) and np.bincount(row).tolist() == [150] * 512
    assert {(r, i) for r, i in zip(row.tolist(), ids.tolist())} == {(r, i) for r, c in enumerate(np.argsort(-truth, axis=1)[:, :150]) for i in c.tolist()}
    assert peak < 60  # scores of all pairs, their negatives and their places took three times 64 MB
