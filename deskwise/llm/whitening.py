"""Embedding whitening: principal directions by Golub-Kahan-Lanczos bidiagonalisation of the centred rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskwise.llm.clusters import EXACT, LONG, matrix
from deskwise.session import materialize

SAFE = 1 << 24  # squares of smaller entries add up in 64 bits over any Arrow batch
END = float(1 << 62)


def shifted(df: DataFrame, id_col: str, vec_col: str, scale: int, shift: int) -> DataFrame:
    """(vec_id, x): floor(scale * entry) + shift of every vector that is there and holds finite numbers only."""
    finite = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("e")).where(F.col("e").isNotNull() & finite)
    inside = lambda c: F.greatest(F.lit(-END), F.least(F.lit(END), F.floor(c * float(scale)).cast("double")))
    exact = lambda c: F.when(F.abs(c * float(scale)) < END, F.floor(c * float(scale))).otherwise(inside(c).cast("long"))
    return rows.select("vec_id", F.transform("e", lambda c: exact(c) + shift).alias("x"))


@dataclass(frozen=True)
class Moments:
    """Exact count, sums and sums of squares by dimension."""

    n: int
    sums: list[int]
    squares: list[int]

    def centre(self) -> Callable[[np.ndarray], np.ndarray]:
        """Rows minus the mean: a whole number is taken off exactly, then the rest, less than one."""
        whole = [s // self.n for s in self.sums]
        rest = np.array([float(Fraction(s, self.n) - w) for s, w in zip(self.sums, whole, strict=True)])
        base = np.array(whole, np.int64)
        return lambda x: (x - base).astype(float) - rest

    def trace(self) -> Fraction:
        return sum((Fraction(q, self.n) - Fraction(s, self.n) ** 2 for s, q in zip(self.sums, self.squares, strict=True)), Fraction(0))


def moments(vectors: DataFrame, dims: int) -> Moments:
    """One pass; tasks hand on a row per dimension, and Spark adds them up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, np.zeros(dims, object), np.zeros(dims, object)
        for batch in batches:
            x = matrix(batch.column("x"), dims)
            if len(x):
                small = max(abs(int(x.max())), abs(int(x.min()))) < SAFE and len(x) < 1 << 14
                x = x if small else x.astype(object)
                n, sums, squares = n + len(x), sums + x.sum(axis=0).astype(object), squares + (x * x).sum(axis=0).astype(object)
        if n:
            exact = lambda values: pa.array([Decimal(int(v)) for v in values], EXACT)
            yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), exact(sums), exact(squares), pa.array([n] * dims, pa.int64())], ["dim", "s", "q", "n"])

    parts = vectors.mapInArrow(run, "dim int, s decimal(38,0), q decimal(38,0), n long")
    rows = parts.groupBy("dim").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n")).orderBy("dim").collect()
    return Moments(rows[0]["n"] if rows else 0, [int(r["s"]) for r in rows], [int(r["q"]) for r in rows])


def summed(vectors: DataFrame, dims: int, of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all batches of ``of(rows)``, a vector of ``size`` doubles, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += of(matrix(batch.column("x"), dims))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["k", "v"])

    out = np.zeros(size)
    for r in vectors.mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[r["k"]] = r["v"]
    return out


# -- bidiagonalisation ----------------------------------------------------------------------------


def bidiagonalise(product: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, float]], dims: int, wanted: int, steps: int, tiny: float = 1e-13) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right singular vectors as columns) of the rows X behind ``product``, largest first.

    ``product(q, W)`` goes through the rows once: u = Xq for each row, then Xᵀu, with the dot products of u and the earlier
    left vectors U = XW and of u with itself. A left vector has an entry for every row of the table, so it
    is never stored: it lies in the range of X and is kept as the short vector w with u = Xw.

    Every new left vector is made orthogonal to all earlier ones by those dot products, every new right vector twice.
    Where a direction is used up the process starts again at right angles to all found so far, so that repeated
    and zero singular values are found too. It ends after ``steps`` steps, or, with fewer steps than dimensions, when
    the residuals of the ``wanted`` largest triplets are at rounding level.
    """
    rng = np.random.default_rng(0)
    right, left, back = np.zeros((dims, 0)), np.zeros((dims, 0)), np.zeros((dims, 0))
    alphas, betas = [], []

    def fresh() -> np.ndarray:
        v = rng.standard_normal(dims)
        for _ in range(3):
            v = v - right @ (right.T @ v)
            v /= np.linalg.norm(v)
        return v

    def small() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.linalg.svd(np.diag(alphas) + np.diag(betas[: len(alphas) - 1], 1))

    v = fresh()
    while True:
        q = v - (betas[-1] * left[:, -1] if betas else 0)
        z, h, square = product(q, left)
        scale = max([np.sqrt(square), *alphas])
        alpha = np.sqrt(max(0.0, square - h @ h))
        right = np.column_stack((right, v))
        if alpha <= tiny * scale or not scale:
            alpha, w, u_back = 0.0, np.zeros(dims), np.zeros(dims)
        else:
            w, u_back = (q - left @ h) / alpha, (z - back @ h) / alpha
        alphas.append(alpha)
        left, back = np.column_stack((left, w)), np.column_stack((back, u_back))
        if len(alphas) == steps or right.shape[1] == dims:
            break
        r = u_back - alpha * v
        for _ in range(2):
            r = r - right @ (right.T @ r)
        beta = float(np.linalg.norm(r))
        if beta <= tiny * max(alphas) or not beta:
            beta, v = 0.0, fresh()
        else:
            v = r / beta
        betas.append(beta)
        if steps < dims and len(alphas) > wanted:
            u, s, _ = small()
            if (beta * np.abs(u[-1, :wanted]) <= 1e-15 * s[0]).all():
                break
    _, s, vt = small()
    return s, right @ vt.T


# -- whitening ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Whitening:
    moments: Moments
    components: np.ndarray  # columns, by falling eigenvalue
    eigenvalues: np.ndarray
    explained: np.ndarray


def width(vectors: DataFrame) -> int:
    """The length that most vectors have (of equally frequent ones the greater)."""
    found = vectors.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found["d"] if found else 0


def fit(vectors: DataFrame, dims: int, components: int = 8, steps: int | None = None) -> Whitening:
    """Mean, components and eigenvalues of the covariance (divisor n) of all ``vectors`` (x of ``dims`` entries).

    ``steps`` bounds the passes over the table; None takes one for each dimension, which is exact whatever the
    spectrum. Components without variance (an eigenvalue under 1e-12 of the largest) can't be whitened and are left out.
    """
    found = moments(vectors, dims)
    trace = found.trace() if found.n else Fraction(0)
    if not trace:
        return Whitening(found, np.zeros((dims, 0)), np.zeros(0), np.zeros(0))
    centre = found.centre()

    def product(q: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        def of(x: np.ndarray) -> np.ndarray:
            rows = centre(x)
            u = rows @ q
            return np.concatenate((rows.T @ u, (rows @ left).T @ u, [u @ u]))

        total = summed(vectors, dims, of, dims + left.shape[1] + 1)
        return total[:dims], total[dims:-1], float(total[-1])

    values, vectors_ = bidiagonalise(product, dims, components, min(dims, steps or dims))
    kept = min(components, int((values**2 > 1e-12 * values[0] ** 2).sum()))
    e = values[:kept] ** 2 / found.n
    return Whitening(found, vectors_[:, :kept], e, e / float(trace))


def identity_error(vectors: DataFrame, dims: int, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, over all rows."""
    k, centre = len(model.eigenvalues), model.moments.centre()
    scaled = model.components / np.sqrt(model.eigenvalues)

    def of(x: np.ndarray) -> np.ndarray:
        white = centre(x) @ scaled
        return np.concatenate((white.sum(axis=0), (white.T @ white).ravel()))

    total = summed(vectors, dims, of, k + k * k) / model.moments.n
    mean, square = total[:k], total[k:].reshape(k, k)
    return float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max())


def deviations(x: np.ndarray, found: Moments) -> list[int | None]:
    """Exact sum over dimensions of (n * x - S)^2 of every row; None where no long can hold it."""
    top = max(abs(int(x.max())), abs(int(x.min()))) * found.n + max(map(abs, found.sums)) if x.size else 0
    kind = np.int64 if top * top * max(1, x.shape[1]) < LONG else object
    apart = x.astype(kind) * found.n - np.array(found.sums, dtype=kind)
    return [d if d < LONG else None for d in (apart * apart).sum(axis=1).tolist()]


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 8, scale: int = 1024, shift: int = 100_000, steps: int | None = None) -> DataFrame:
    """One row per remaining vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null or hold nulls, NaN or infinities are dropped, and so are those that lack entries which
    most vectors have, or have more. Fewer components come out where the vectors have fewer directions with variance,
    none where all are equal. Repeated rows are repeated and count in the fit as often; an empty table gives no rows.
    Entries beyond 2^62 count as 2^62; a deviation that no long can hold is null. Equal eigenvalues share a plane,
    of which some basis is taken, the same for all rows. Other columns are ignored.

    The integers are stored once and read in every pass; a lost executor costs its tasks of the pass that runs.
    """
    stored = materialize(shifted(df, id_col, vec_col, scale, shift), "shifted-vectors")
    dims = width(stored)
    vectors = stored.where(F.size("x") == dims)
    kind = stored.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(vectors, dims, components, steps) if dims else None
    if model is None or not len(model.eigenvalues):
        return df.sparkSession.createDataFrame([], schema)
    error, k = identity_error(vectors, dims, model), len(model.eigenvalues)
    centre, scaled = model.moments.centre(), model.components / np.sqrt(model.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), dims)
            rows = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(rows)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(rows), model.moments.n)),
                    pa.array(deviations(x, model.moments), pa.int64()).take(pa.array(rows)),
                    pa.array((centre(x) @ scaled).ravel()),
                    pa.array(np.tile(model.explained, len(x))),
                    pa.array(np.full(len(rows), error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.mapInArrow(run, schema)
