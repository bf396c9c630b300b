import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import types as T

from deskwise.llm import clusters, whitening
from deskwise.llm.queries import op12_centroids, op13_whitening

SCHEMA = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))]
    + [T.StructField(n, T.StringType()) for n in ("x", "e", "cluster", "distance", "component", "n", "dim", "total")]
)


def table(spark, rows):
    return spark.createDataFrame([(i, v, *("y",) * 8) for i, v in rows], SCHEMA)


def hostile_rows(dims=64, n=60):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=dims).tolist()) for i in range(n)]
    odd = [(100, None), (101, []), (102, [0.5] * (dims - 1)), (103, [None] + [0.1] * (dims - 1)), (104, [math.nan] * dims), (105, [math.inf] + [0.0] * (dims - 1))]
    return rows + odd + [(None, rows[0][1]), (3, rows[3][1]), (3, rows[3][1]), (3, rows[4][1]), (106, [0.0] * dims), (107, [-0.0] * dims)]


def floors(v, scale=1024):
    return [math.floor(scale * float(np.float32(c))) for c in v]


def usable(v, dims=None):
    return v is not None and (dims is None or len(v) == dims) and all(c is not None and math.isfinite(c) for c in v)


# -- clustering -----------------------------------------------------------------------------------


def brute_clusters(rows, dims=64, k=8, rounds=10):
    kept = [(i, floors(v)) for i, v in rows if usable(v, dims)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    marks = [x for _, x in order[:k]]

    def near(x):
        d = [sum((a - b) ** 2 for a, b in zip(x, m, strict=True)) for m in marks]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        found = [near(x)[0] for _, x in kept]
        for c in range(len(marks)):
            mine = [x for (_, x), f in zip(kept, found, strict=True) if f == c]
            if mine:
                marks[c] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    rows = [(i, *near(x)) for i, x in kept]
    inertia = [sum(d for _, f, d in rows if f == c) for c in range(len(marks))]
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in marks]
    return [(i, c, d, inertia[c], sum(inertia), digest[c]) for i, c, d in rows]


@pytest.mark.parametrize("size", [1, 2, 8, 64])
def test_transform_is_exact_and_coarse_to_fine(size):
    waves = clusters.transform(np.eye(size, dtype=np.int64)).T
    assert (waves @ waves.T == size * np.eye(size)).all()
    assert [(np.diff(w) != 0).sum() for w in waves] == list(range(size))


def test_nearest_with_ties_and_large_numbers():
    rng = np.random.default_rng(0)
    for top, dims in ((3, 64), (1 << 20, 64), (1 << 40, 64), (5, 7)):
        x, marks = rng.integers(-top, top, (200, dims)), rng.integers(-top, top, (8, dims))
        marks[5] = marks[2]
        best, distance = clusters.nearest(x, marks)
        apart = ((x.astype(object)[:, None] - marks.astype(object)[None]) ** 2).sum(axis=2)
        assert best.tolist() == [r.index(min(r)) for r in apart.tolist()]
        assert distance.tolist() == apart.min(axis=1).tolist()


def test_clusters_of_odd_vectors(spark):
    rows = hostile_rows()
    found = clusters.cluster(table(spark, rows).repartition(5))
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, brute_clusters(rows)))


def test_clusters_of_few_equal_or_no_vectors(spark):
    for rows in ([], hostile_rows()[:3], [(i, [1.0] * 64) for i in range(20)]):
        found = clusters.cluster(table(spark, rows))
        assert sorted(map(tuple, found.collect())) == sorted(brute_clusters(rows))


def test_clusters_beyond_a_long(spark):
    rows = [(1, [1e30] * 64), (2, [-1e30] * 64), (3, [1.0] * 64)]
    found = {r.vec_id: r for r in clusters.cluster(table(spark, rows), k=1, rounds=1).collect()}
    assert found[1].distance is found[2].distance is None and found[3].distance == 64 * (1024 - 341) ** 2
    assert {r.inertia for r in found.values()} == {None}


def test_op12_is_brute_force(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in sf("embeddings").collect()]
    found = op12_centroids(spark, "/root/testdata/sf0.001")
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, found.collect())) == sorted(brute_clusters(rows))


# -- whitening ------------------------------------------------------------------------------------


def check_whitening(found, rows, k=8):
    kept = [(i, [c + 100_000 for c in floors(v)]) for i, v in rows]
    n, x = len(kept), np.array([v for _, v in kept], float)
    sums = [sum(col) for col in zip(*[v for _, v in kept], strict=True)]
    centred = x - x.mean(axis=0)
    e, vectors = np.linalg.eigh(centred.T @ centred / n)
    e, vectors = e[::-1], vectors[:, ::-1]
    rank = min(k, int((e > 1e-12 * e[0]).sum()))
    found = sorted(map(tuple, found.collect()), key=lambda r: (r[1], repr(r[0]), r[3], r[4]))
    assert len(found) == n * rank
    expect = [(i, c + 1, n, sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)), abs(row @ vectors[:, c]) / math.sqrt(e[c])) for (i, v), row in zip(kept, centred, strict=True) for c in range(rank)]
    key = lambda r: (r[1], repr(r[0]), r[3], round(abs(r[4]), 6))
    for f, x in zip(sorted(found, key=key), sorted(expect, key=key), strict=True):
        assert f[:4] == x[:4]
        assert abs(f[4]) == pytest.approx(x[4], abs=1e-7)
        assert f[5] == pytest.approx(e[f[1] - 1] / e.sum(), rel=1e-9)
        assert f[6] < 1e-9


def test_op13_is_an_eigenvalue_decomposition(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in sf("embeddings").collect()]
    check_whitening(op13_whitening(spark, "/root/testdata/sf0.001"), rows)


def test_whitening_of_odd_vectors(spark):
    rows = hostile_rows(dims=12)
    found = whitening.whiten(table(spark, rows).repartition(4))
    check_whitening(found, [(i, v) for i, v in rows if usable(v, 12)])


def test_whitening_without_variance(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [0.5] * 4)] * 5, [(1, None), (2, [])]):
        assert whitening.whiten(table(spark, rows)).count() == 0


def test_whitening_of_few_directions_and_repeated_values(spark):
    rng = np.random.default_rng(2)
    flat = rng.normal(size=(50, 3)) @ rng.normal(size=(3, 10))
    found = whitening.whiten(table(spark, [(i, v) for i, v in enumerate(flat.tolist())]), scale=1)
    assert found.select("component").distinct().count() <= 8 and found.first().identity_error < 1e-9
    corners = [(2 * d + s, [float((2 * s - 1) * (k == d)) for k in range(6)]) for d in range(6) for s in (0, 1)]
    rows = whitening.whiten(table(spark, corners)).collect()
    assert len(rows) == 12 * 6 and rows[0].identity_error < 1e-9
    assert {round(r.explained, 9) for r in rows} == {round(1 / 6, 9)}


def test_early_end_agrees_with_all_steps():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 40)) * 0.7 ** np.arange(40)
    passes = []

    def product(q, left):
        passes.append(1)
        u = x @ q
        return x.T @ u, (x @ left).T @ u, float(u @ u)

    s, v = whitening.bidiagonalise(product, 40, 4, 39)
    _, exact, vt = np.linalg.svd(x)
    assert len(passes) < 40
    assert np.allclose(s[:4], exact[:4], rtol=1e-13) and np.allclose(np.abs(vt[:4] @ v[:, :4]), np.eye(4), atol=1e-12)


def test_exact_deviations_and_moments():
    found = whitening.Moments(3, [10, 1], [60, 1])
    assert found.trace() == Fraction(60, 3) - Fraction(10, 3) ** 2 + Fraction(1, 3) - Fraction(1, 9)
    assert whitening.deviations(np.array([[4, 0], [1 << 40, 0]]), found) == [(12 - 10) ** 2 + 1, None]
