"""Centroid clustering of integer vectors: nearest centroids by a progressive search over Walsh-Hadamard coefficients."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskwise.session import materialize

LONG = 1 << 63
EXACT = pa.decimal128(38, 0)


def sequency(size: int) -> np.ndarray:
    """Places of a naturally ordered transform by rising number of sign changes: coarse waves before fine ones."""
    bits = size.bit_length() - 1
    gray = [k ^ (k >> 1) for k in range(size)]
    return np.array([int(f"{g:0{bits}b}"[::-1], 2) if bits else 0 for g in gray])


def transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of every row (a power of two long), unscaled and exact, coarse to fine.

    Squared distances between transformed rows are those between the rows times their length.
    """
    n, size = x.shape
    width = 1
    while width < size:
        x = x.reshape(n, -1, 2, width)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2)
        width *= 2
    return x.reshape(n, size)[:, sequency(size)]


def padded(x: np.ndarray) -> np.ndarray:
    """Zeros up to the next power of two, which leave every distance as it is."""
    size = 1 << max(0, x.shape[1] - 1).bit_length()
    return np.pad(x, ((0, 0), (0, size - x.shape[1]))) if size > x.shape[1] else x


def fitting(*parts: np.ndarray) -> tuple[np.ndarray, ...]:
    """The arrays as 64-bit integers where every intermediate value fits, else as Python's integers."""
    size = 2 * parts[0].shape[1]
    top = max((max(abs(int(p.max())), abs(int(p.min()))) for p in parts if p.size), default=0)
    kind = np.int64 if 4 * size * size * top * top < LONG else object
    return tuple(p.astype(kind) for p in parts)


def nearest(x: np.ndarray, centroids: np.ndarray, first: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of every row; of equally near ones the smallest number.

    Coefficient differences are added up coarse to fine: the first ``first`` of them for every centroid, then twice
    as many, and so on. What has been added is never more than the whole distance, so a centroid whose part
    exceeds another's whole distance is strictly worse and drops out. Those left get all coefficients.
    """
    x, centroids = fitting(padded(x), padded(centroids))
    rows, marks = transform(x), transform(centroids)
    n, size = rows.shape
    total = np.zeros((n, len(marks)), rows.dtype)
    alive = np.ones(total.shape, bool)
    done, stop, bound = 0, min(first, size), None
    while done < size:
        for k, mark in enumerate(marks):
            at = np.flatnonzero(alive[:, k])
            apart = rows[at, done:stop] - mark[done:stop]
            total[at, k] += (apart * apart).sum(axis=1)
        if bound is None:  # the whole distance to the centroid that looks best so far
            lead = total.argmin(axis=1)
            apart = rows[:, stop:] - marks[lead, stop:]
            bound = total[np.arange(n), lead] + (apart * apart).sum(axis=1)
        alive &= (total <= bound[:, None]).astype(bool)
        done, stop = stop, min(2 * stop, size)
    total[~alive] = total.max() + 1 if total.size else 0
    best = total.argmin(axis=1)
    return best, total[np.arange(n), best] // size


# -- distributed rounds ---------------------------------------------------------------------------


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, x): floor(scale * component) of every vector with ``dims`` components, all of them finite numbers."""
    finite = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("e"))
    rows = rows.where((F.size("e") == dims) & finite)
    return rows.select("vec_id", F.transform("e", lambda c: F.floor(c * float(scale))).alias("x"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def assign(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(vec_id, cluster, distance) of every vector; a distance that no long can hold is null."""
    marks = np.array(centroids, dtype=object)
    dims = marks.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, distance = nearest(matrix(batch.column("x"), dims), marks)
            distance = pa.array([d if d < LONG else None for d in distance.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(best.astype(np.int32)), distance], ["vec_id", "cluster", "distance"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Every centroid at the floor of its vectors' exact mean; one without vectors stays.

    A task hands on one sum per centroid and dimension, and those sums are added up by Spark, so the driver gets
    as many rows as there are centroids times dimensions, whatever the input.
    """
    marks = np.array(centroids, dtype=object)
    k, dims = marks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dims), object), np.zeros(k, np.int64)
        for batch in batches:
            x = matrix(batch.column("x"), dims)
            best, _ = nearest(x, marks)
            (x,) = fitting(x)
            for c in np.unique(best):
                mine = x[best == c]
                sums[c] += mine.sum(axis=0).astype(object)
                counts[c] += len(mine)
        places = [(c, d) for c in np.flatnonzero(counts) for d in range(dims)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([c for c, _ in places], pa.int32()),
                pa.array([d for _, d in places], pa.int32()),
                pa.array([Decimal(int(sums[p])) for p in places], EXACT),
                pa.array([int(counts[c]) for c, _ in places], pa.int64()),
            ],
            ["cluster", "dim", "total", "rows"],
        )

    parts = vectors.mapInArrow(run, "cluster int, dim int, total decimal(38,0), rows long")
    out = [list(c) for c in centroids]
    for r in parts.groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("rows").alias("rows")).collect():
        out[r["cluster"]][r["dim"]] = int(r["total"]) // r["rows"]
    return out


def cluster(
    df: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    dims: int = 64,
    k: int = 8,
    rounds: int = 10,
    salt: str = "3:",
    scale: int = 1024,
) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors become integers and everything after is exact. The first centroids are the ``k`` vectors whose id has the
    smallest sha256 behind ``salt`` (a null id counts as empty text; equal ids by their vectors). Each round
    assigns all vectors (nearest, ties to the smaller number) and moves every centroid that has vectors to the floor of
    their mean; at the end all are assigned once more.

    Vectors that are null, of another length, or hold nulls, NaN or infinities are left out. With fewer than ``k``
    vectors there are that many centroids; an empty table gives no rows. Repeated rows are repeated. A component beyond
    the range of a long counts as its end; distances and inertias that no long can hold are null. Other columns
    are ignored. The vectors are stored once and read in every round, so a lost executor loses one task's work.
    """
    vectors = materialize(integer_vectors(df, id_col, vec_col, dims, scale), "integer-vectors")
    draw = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    centroids = [list(r["x"]) for r in vectors.orderBy(draw, "x").limit(k).collect()]
    if not centroids:
        kind = vectors.schema["vec_id"].dataType.simpleString()
        return df.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    rows = materialize(assign(vectors, centroids), "assigned")
    spread = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count_if(F.col("distance").isNull()).alias("lost"))
    spread = spread.collect()  # a row per centroid
    exact = {r["cluster"]: None if r["lost"] or r["s"] >= LONG else int(r["s"]) for r in spread}
    whole = None if None in exact.values() or sum(exact.values()) >= LONG else sum(exact.values())
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    named = [(c, exact[c], whole, digest[c]) for c in exact]
    names = df.sparkSession.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(names), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
