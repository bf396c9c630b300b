"""Exact top-k vector retrieval and intent-aware re-ranking.

Vectors are unit length, so the dot product is the cosine. Similarities are compared at six
decimals (what float32 vectors carry) and ties go to the lowest history id, so every
strategy below returns the same rows.

``broadcast``  Few queries: their matrix is shipped to the tasks (only below a checked size of the matrix
               and of what a task keeps for all queries) and the history is scanned once, without a shuffle, each task keeping its
               best k per query.
``grid``       Many queries: history vectors are filed under their nearest pivot. Queries first
               look into their nearest cells, some hundredth of the history, which gives a lower bound for their
               k-th best similarity; after that only cells whose best possible similarity reaches the
               bound are visited. Cells are cut into blocks of bounded size on both sides, so
               a crowded cell becomes many small matrix products and no pair is ever a row.
               Up to a checked size the history is sent to every executor once, in chunks, and each task goes through them
               with its own queries: only what is found is shuffled. A larger one is shuffled for every share of queries.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskwise.operators.joins import lookup_join
from deskwise.session import _bytes_of, broadcast_if_small, materialize, shared_dir

DECIMALS = 6
SCALE = 10**DECIMALS
SLACK = 1e-5  # covers rounding of vectors, angles and similarities in the pruning bound
LEAST = np.finfo(np.float32).min  # what is left out has less
STRETCH = 16  # blocks of history that one task of the grid search goes through, or more where blocks are small, see below
TASK_ROWS = 1 << 16  # rows of history that are worth a task; half as many queries
BLOCK_ROWS = 4096
SHELL_ROWS = 256  # rows of a cell, at like angles to its pivot, that are visited or left out together
PRODUCT = 1 << 20  # pairs of one product
NEAR = 64  # one in so many rows of history gives a query its bound
PAIRS_AT_ONCE = 1 << 14
MAX_SHIPPED = 4 << 30  # bytes of history that every executor may hold on its disk
CHUNK_NUMBERS = 1 << 21  # of its vectors that a task holds at once
ASKED_ROWS = 1 << 13  # queries that one task of that search takes, or twice as many where partitions come out uneven
MAX_KEPT = 1_000_000  # rows that a task of the broadcast strategy may keep for all queries together; each task emits so many


def matrix_of(column) -> np.ndarray:
    """List column to an (n, d) double matrix without Python objects."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().unique()
    if len(lengths) > 1:
        raise ValueError(f"vectors differ in length: {lengths.to_pylist()}")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


def _array(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.to_numpy(zero_copy_only=False)


class Items:
    """A block of history as arrays, by ascending id; rows with an entry that is no finite number have no similarity and are left out."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, carried: Sequence[np.ndarray] = ()):
        order = np.argsort(ids, kind="stable")
        order = order[np.isfinite(vectors[order]).all(axis=1)]
        self.ids, self.vectors, self.carried = ids[order], vectors[order], [c[order] for c in carried]
        self.order, self.single = order, self.vectors.astype(np.float32)
        self.length = np.sqrt((self.vectors * self.vectors).sum(axis=1).max(initial=0.0))


class Best:
    """Running best ``k`` rows for every query of a fixed block: highest similarity first, then lowest id.

    Products in single precision tell which pairs can still be among the best, by a bound of their error; only those are
    computed in double precision and kept. ``scale`` rounds similarities to its fractions (None: no rounding).
    ``bound``: of a query only what reaches it is wanted.
    """

    def __init__(self, qids: np.ndarray, queries: np.ndarray, k: int, exclude_self: bool, bound: np.ndarray | None = None, scale: int | None = SCALE):
        self.qids, self.queries, self.k, self.exclude_self, self.scale = qids, queries, k, exclude_self, scale
        self.single = queries.astype(np.float32)
        self.error = (queries.shape[1] + 8) * 2.0**-24 * np.sqrt((queries * queries).sum(axis=1))
        low = np.full(len(qids), -np.inf) if bound is None else bound
        self.low = low if scale is None else np.rint(low * scale)  # of every query the least similarity that is wanted
        self.edge = None  # where k rows are known ("full"), the id of the last of them
        self.full = np.zeros(len(qids), bool)
        self.kept: list[list[np.ndarray]] = []
        self.pending, self.settled = 0, 0

    def add(self, items: Items, rows: np.ndarray | None = None, allowed: np.ndarray | None = None) -> None:
        """Take ``items`` in, for the queries at ``rows`` only and for the pairs that are ``allowed`` (queries, items)."""
        rows = np.arange(len(self.qids)) if rows is None else rows
        if len(items.ids):
            step = max(1, PRODUCT // len(items.ids))
            for at in range(0, len(rows), step):
                self._add(rows[at : at + step], items, allowed)

    def _add(self, rows: np.ndarray, items: Items, allowed: np.ndarray | None) -> None:
        n, unit = len(items.ids), self.scale or 1
        scores = self.single[rows] @ items.single.T
        if allowed is not None:
            scores[~allowed[rows]] = -np.inf
        if self.exclude_self:
            first, last = (np.searchsorted(items.ids, self.qids[rows], side) for side in ("left", "right"))
            for i in np.flatnonzero(first < last):
                scores[i, first[i] : last[i]] = -np.inf
        error = self.error[rows] * items.length + (0 if self.scale is None else 0.51 / unit)
        low = self.low[rows] / unit - error
        unknown = np.flatnonzero(~np.isfinite(low))
        if len(unknown) and self.k < n:
            low[unknown] = np.partition(scores[unknown], n - self.k, axis=1)[:, n - self.k] - 2 * error[unknown]
        low = np.maximum(low, LEAST).astype(np.float32)
        low = np.nextafter(low, np.float32(-np.inf), where=low > LEAST, out=low)
        row, col = np.divmod(np.flatnonzero(scores >= low[:, None]), n)
        if 8 * len(row) > scores.size:
            exact = (self.queries[rows] @ items.vectors.T)[row, col]
        else:
            parts = [slice(i, i + PAIRS_AT_ONCE) for i in range(0, len(row), PAIRS_AT_ONCE)]
            exact = [np.einsum("ij,ij->i", self.queries[rows[row[p]]], items.vectors[col[p]]) for p in parts]
            exact = np.concatenate([np.zeros(0), *exact])
        sims, row = exact if self.scale is None else np.rint(exact * unit), rows[row]
        wanted = sims >= self.low[row]
        if self.edge is not None:
            tied = np.flatnonzero((sims == self.low[row]) & self.full[row])
            wanted[tied[items.ids[col[tied]] > self.edge[row[tied]]]] = False
        row, col, sims = row[wanted], col[wanted], sims[wanted]
        self.kept.append([row, sims, items.ids[col], *(c[col] for c in items.carried)])
        self.pending += len(row)
        if self.pending > max(self.k * len(rows), self.settled):
            self._settle()

    def _settle(self) -> None:
        """Keep the best ``k`` rows of every query; their last is the least that a further row has to reach."""
        columns = [np.concatenate(c) for c in zip(*self.kept)]
        row, sims, ids = columns[:3]
        n, size = len(self.qids), np.bincount(row, minlength=len(self.qids))
        width = max(self.k, size.max(initial=0))
        if n * width > 8 * (len(row) + n * self.k):  # a few queries have most of the rows
            order = np.lexsort((sims, row))
            start = np.cumsum(size) - size
            least = np.where(size >= self.k, np.append(sims[order], 0)[start + np.maximum(size - self.k, 0)], -np.inf)
        else:
            order = np.argsort(row.astype(np.uint16) if n < 1 << 16 else row, kind="stable")
            table = np.full((n, width), -np.inf)
            table[row[order], np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = sims[order]
            table.partition(width - self.k, axis=1)
            least = table[:, width - self.k]
        keep = sims > least[row]
        tied = np.flatnonzero(sims == least[row])  # the lowest ids of these, as many as there is room for
        rank = np.unique(ids[tied], return_inverse=True)[1] if ids.dtype == object else ids[tied]
        tied = tied[np.lexsort((rank, row[tied]))]
        place = np.arange(len(tied)) - np.searchsorted(row[tied], row[tied])
        room = self.k - np.bincount(row[keep], minlength=n)[row[tied]]
        keep[tied[place < room]] = True
        last = tied[place == room - 1]
        if self.edge is None:
            self.edge = np.resize(ids, n) if len(ids) else None
        if len(last):
            self.low[row[last]], self.edge[row[last]], self.full[row[last]] = sims[last], ids[last], True
        self.kept = [[c[keep] for c in columns]]
        self.pending, self.settled = 0, len(self.kept[0][0])

    def tighten(self) -> None:
        """Settle, so that bounds are as tight as what was seen allows."""
        if self.pending:
            self._settle()

    def columns(self) -> list[np.ndarray] | None:
        """Query ids, history ids, similarities and carried columns of what was found."""
        if not self.kept:
            return None
        self._settle()
        row, sims, ids, *carried = self.kept[0]
        return [self.qids[row], ids, sims if self.scale is None else sims / self.scale, *carried]


def _batch(columns: list[np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    arrays = [
        pa.array(c.tolist() if c.dtype == object else c, type=f.type, from_pandas=True)
        for c, f in zip(columns, schema)
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _result_schema(history: DataFrame, history_id: str, carry: Sequence[str], query_type) -> T.StructType:
    fields = [T.StructField("query_id", query_type), T.StructField("history_id", history.schema[history_id].dataType)]
    fields.append(T.StructField("similarity", T.DoubleType()))
    return T.StructType(fields + [history.schema[c] for c in carry])


def _broadcast_scan(queries, history, k, carry, exclude_self, qid_type):
    spark = queries.sparkSession
    schema = _result_schema(history, "history_id", carry, qid_type)
    table = queries.toArrow()
    if table.num_rows == 0:
        return spark.createDataFrame([], schema)
    shipped = spark.sparkContext.broadcast((_array(table["query_id"]), matrix_of(table["vector"])))
    arrow = _arrow_schema(schema)
    ncarry = len(carry)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, matrix = shipped.value
        blocks = [Best(qids[i : i + 1024], matrix[i : i + 1024], k, exclude_self) for i in range(0, len(qids), 1024)]
        for batch in _slices(batches, BLOCK_ROWS):
            items = Items(_array(batch.column(0)), matrix_of(batch.column(1)), [_array(batch.column(2 + i)) for i in range(ncarry)])
            for block in blocks:
                block.add(items)
        for block in blocks:
            columns = block.columns()
            if columns is not None:
                yield _batch(columns, arrow)

    return history.select("history_id", "vector", *carry).mapInArrow(scan, schema)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _directions(vectors: np.ndarray) -> np.ndarray:
    """Rows at unit length in double precision: what is off by rounding shows most in small angles. A zero row stays."""
    lengths = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return vectors / np.where(lengths > 0, lengths, 1.0)


def _angles(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_directions(vectors) @ _directions(pivots).T, -1.0, 1.0))


class Shells:
    """A cell's rows by their angle to its pivot, in blocks of neighbouring angles.

    An angle between two vectors is no less than the difference of their angles to a third, so a query needs the
    blocks only whose angles lie near its own.
    """

    def __init__(self, pivot: np.ndarray, ids: np.ndarray, vectors: np.ndarray, carried: Sequence[np.ndarray], rows: int):
        self.pivot, self.blocks, lows, highs = pivot[None, :], [], [], []
        angles = _angles(vectors, self.pivot)[:, 0]
        order = np.argsort(angles, kind="stable")  # what is no number comes last
        for at in range(0, len(order), rows):
            part = order[at : at + rows]
            items = Items(ids[part], vectors[part], [c[part] for c in carried])
            if len(items.ids):
                self.blocks.append(items)
                lows.append(angles[part[items.order]].min())
                highs.append(angles[part[items.order]].max())
        self.lows, self.highs = np.array(lows), np.array(highs)

    def visit(self, best: Best, rows: np.ndarray) -> None:
        """Let ``best`` take in what the queries at ``rows`` can still want."""
        angles = _angles(best.queries[rows], self.pivot)[:, 0]
        for items, low, high in zip(self.blocks, self.lows, self.highs):
            least = best.low[rows] / (best.scale or 1)
            reach = np.arccos(np.clip(least - SLACK, -1.0, 1.0)) + SLACK
            asking = rows[np.maximum(low - angles, angles - high) <= reach]
            if len(asking):
                best.add(items, asking)


def _slices(batches: Iterator[pa.RecordBatch], n: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``n`` rows, so that an (n, pivots) matrix stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, n):
            yield batch.slice(start, n)


def _assign(history: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds ``cell`` (nearest pivot) and ``angle`` to it."""
    shipped = history.sparkSession.sparkContext.broadcast(pivots)
    schema = T.StructType(
        history.schema.fields + [T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())]
    )

    def assign(batches):
        for batch in _slices(batches):
            angles = _angles(matrix_of(batch.column("vector")), shipped.value)
            cell = angles.argmin(axis=1)
            best = angles[np.arange(len(cell)), cell]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(best)],
                names=[*batch.schema.names, "cell", "angle"],
            )

    return history.mapInArrow(assign, schema)


def _side_by_side(pivots: np.ndarray, sizes: np.ndarray, span: int) -> np.ndarray:
    """The cells in an order in which near ones lie side by side: halved across their widest direction until a part has ``span`` rows at most.

    A query's nearest cells are then in few stretches, and what they emit for it is not repeated in many.
    """
    at = np.nan_to_num(_directions(pivots), posinf=0.0, neginf=0.0)
    parts, done = [np.arange(len(pivots))], []
    while parts:
        part = parts.pop()
        reached = np.cumsum(sizes[part])
        if len(part) < 2 or reached[-1] <= span:
            done.append(part)
            continue
        centred = at[part] - at[part].mean(axis=0)
        part = part[np.argsort(centred @ np.linalg.eigh(centred.T @ centred)[1][:, -1], kind="stable")]
        half = int(np.clip(np.searchsorted(np.cumsum(sizes[part]), reached[-1] / 2), 1, len(part) - 1))
        parts += [part[half:], part[:half]]
    return np.concatenate(done)


def _nearest_cells(queries: DataFrame, pivots, sizes, k: int) -> DataFrame:
    """Explode each query over its nearest cells until they hold at least ``k`` vectors."""
    sc = queries.sparkSession.sparkContext
    shipped = sc.broadcast((pivots, sizes))
    schema = T.StructType(queries.schema.fields + [T.StructField("cells", T.ArrayType(T.IntegerType()))])

    def probe(batches):
        for batch in _slices(batches):
            pv, counts = shipped.value
            angles = _angles(matrix_of(batch.column("vector")), pv)
            order = np.argsort(angles, axis=1, kind="stable")
            reached = np.cumsum(counts[order], axis=1) >= k
            upto = np.where(reached.any(axis=1), reached.argmax(axis=1) + 1, order.shape[1])
            cells = [order[i, : upto[i]].astype(np.int32) for i in range(len(upto))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cells, pa.list_(pa.int32()))],
                names=[*batch.schema.names, "cells"],
            )

    return queries.mapInArrow(probe, schema)


def _reachable_cells(probed: DataFrame, pivots, radii, sizes) -> DataFrame:
    """Cells not visited yet whose best possible similarity reaches the query's bound, which stays with the row."""
    sc = probed.sparkSession.sparkContext
    shipped = sc.broadcast((pivots, radii, sizes))
    schema = T.StructType(
        [f for f in probed.schema.fields if f.name != "cells"]
        + [T.StructField("cells", T.ArrayType(T.IntegerType()))]
    )

    def prune(batches):
        for batch in _slices(batches):
            pv, rad, counts = shipped.value
            angles = _angles(matrix_of(batch.column("vector")), pv)
            possible = np.cos(np.maximum(angles - rad - SLACK, 0.0)) + SLACK
            bound = _array(batch.column("bound"))
            visit = (possible >= bound[:, None]) & (counts > 0)
            done = batch.column("cells").to_pylist()
            cells = []
            for i, seen in enumerate(done):
                visit[i, seen] = False
                cells.append(np.flatnonzero(visit[i]).astype(np.int32))
            keep = [c for n, c in zip(batch.schema.names, batch.columns) if n != "cells"]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(cells, pa.list_(pa.int32()))],
                names=[f.name for f in schema.fields],
            )

    return probed.mapInArrow(prune, schema)


def _block_join(probes, filed, stretches, pivots, k, carry, exclude_self, block_rows, schema) -> DataFrame:
    """Top k per query and stretch of cells, of what reaches the query's bound.

    ``probes`` = (query_id, vector, bound, stretch, cells), one row per query and stretch it visits;
    ``stretches`` = (cell, stretch, hcuts): neighbouring small cells form one stretch, a large cell is cut. Both sides are replicated only over the cuts of the other side of
    the same stretch. A task takes some thousand queries after another, each cell by cell, in blocks that its bound reaches, and emits at most ``k``
    rows of a query. Its share of queries does not shrink with ``block_rows``: the history is repeated for every share.
    """
    arrow = _arrow_schema(schema)
    shipped = probes.sparkSession.sparkContext.broadcast(pivots)
    n = F.count(F.lit(1))
    share = F.greatest(F.lit(block_rows), F.least(F.lit(TASK_ROWS // 2), n / STRETCH))
    load = probes.groupBy("stretch").agg(F.ceil(n / share).cast("int").alias("qcuts"))
    cuts = stretches.select("stretch", "hcuts").distinct().join(load, "stretch")  # at most one row per pivot
    q = probes.join(F.broadcast(cuts), "stretch").select(
        "stretch",
        F.pmod(F.xxhash64("query_id"), F.col("qcuts")).cast("int").alias("qcut"),
        F.explode(F.sequence(F.lit(0), F.col("hcuts") - 1)).alias("hcut"),
        "cells", "query_id", "vector", "bound",
    )
    h = filed.join(F.broadcast(stretches.join(load, "stretch")), "cell").select(
        F.col("stretch").alias("stretch"),
        F.explode(F.sequence(F.lit(0), F.col("qcuts") - 1)).alias("qcut"),
        F.pmod(F.xxhash64("history_id"), F.col("hcuts")).cast("int").alias("hcut"),
        "cell", "history_id", "vector", *carry,
    )

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return arrow.empty_table()
        blocks = _shells(right, shipped.value, carry, min(block_rows, SHELL_ROWS))
        left = left.take(pc.sort_indices(pc.list_element(left["cells"], 0)))  # a block's queries visit the same cells
        done = []
        for at in range(0, left.num_rows, BLOCK_ROWS):
            part = left.slice(at, BLOCK_ROWS)
            best = Best(_array(part["query_id"]), matrix_of(part["vector"]), k, exclude_self, _array(part["bound"]))
            visits = part["cells"].combine_chunks()
            asked, asking = _array(visits.flatten()), np.repeat(np.arange(len(visits)), _array(visits.value_lengths()))
            order = np.argsort(asked, kind="stable")
            found, first = np.unique(asked[order], return_index=True)
            for cell, rows in zip(found.tolist(), np.split(asking[order], first[1:])):
                if cell in blocks:
                    blocks[cell].visit(best, rows)
            columns = best.columns()
            if columns is not None:
                done.append(_batch(columns, arrow))
        return pa.Table.from_batches(done, arrow)

    keys = ["stretch", "qcut", "hcut"]
    return q.groupBy(*keys).cogroup(h.groupBy(*keys)).applyInArrow(product, schema)


def _pivots(history: DataFrame, total: int, n: int) -> np.ndarray:
    """Some ``n`` history vectors, chosen by id hash; which ones only matters for speed.

    Only rows below a hash bound that some ``2n`` rows pass are sorted for the choice.
    """
    key = F.xxhash64("history_id")
    share = min(1.0, 2.0 * n / max(total, 1))
    bound = int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1
    rows = history.select(key.alias("k"), "vector")
    chosen = rows.where(F.col("k") <= bound).orderBy("k").limit(n).toArrow()
    if chosen.num_rows == 0:
        chosen = rows.limit(1).toArrow()
    return matrix_of(chosen["vector"])


@dataclass(frozen=True)
class HistoryIndex:
    """History filed under its nearest pivot, with size and radius of every cell.

    ``rows``: history_id, vector, cell and carried columns; the arrays have one entry per pivot.
    """

    rows: DataFrame
    pivots: np.ndarray
    sizes: np.ndarray
    radii: np.ndarray
    chunks: dict | None = None  # what was sent to the executors already, see _ship


CELLS = "cell int, pivot array<double>, n bigint, r double"


def file_rows(rows: DataFrame, pivots: np.ndarray, path: str, keep_pivots: bool = False, overwrite: bool = False) -> None:
    """Write ``rows`` (history_id, vector, carried columns) with their cells, and size and radius of every cell."""
    spark = rows.sparkSession
    mode = "overwrite" if overwrite else "error"
    _assign(rows, pivots).write.mode(mode).parquet(f"{path}/rows")
    stats = spark.read.parquet(f"{path}/rows").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("r"))
    measured = {r["cell"]: (r["n"], r["r"]) for r in stats.collect()}  # one row per pivot
    cells = [(c, v.tolist() if keep_pivots else None, *measured.get(c, (0, 0.0))) for c, v in enumerate(pivots)]
    spark.createDataFrame(cells, CELLS).coalesce(1).write.mode(mode).parquet(f"{path}/cells")


def index_history(
    history: DataFrame, carry: Sequence[str] = (), n_pivots: int = 4096, path: str | None = None, overwrite: bool = False
) -> HistoryIndex:
    """File ``history`` (history_id, embedding, carried columns) once for many query batches.

    Written below ``path`` (by default a new shared folder): ``rows`` and the small ``cells`` table.
    """
    path = path or shared_dir(history.sparkSession, "index")
    h = vectors_of(history, "history_id", carry)
    total = h.count()
    pivots = _pivots(h, total, min(n_pivots, max(1, int(total**0.5)))) if total else np.zeros((1, 1))
    file_rows(h, pivots, path, True, overwrite)
    return load_index(history.sparkSession, path)


def load_index(spark: SparkSession, path: str) -> HistoryIndex:
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").toArrow()
    return HistoryIndex(
        spark.read.parquet(f"{path}/rows").drop("angle"),
        matrix_of(cells["pivot"]), _array(cells["n"]), _array(cells["r"]),
    )


def vectors_of(df: DataFrame, key: str, carry: Sequence[str] = ()) -> DataFrame:
    return df.where(F.col("embedding").isNotNull()).select(key, F.col("embedding").alias("vector"), *carry)


def _shells(rows: pa.Table, pivots: np.ndarray, carry: Sequence[str], size: int) -> dict[int, Shells]:
    """History rows (cell, history_id, vector, carried columns) by cell."""
    found, rows = {}, rows.sort_by("cell")
    cells, starts = np.unique(_array(rows["cell"]), return_index=True)
    for cell, start, end in zip(cells.tolist(), starts, [*starts[1:], rows.num_rows]):
        part = rows.slice(start, end - start)
        columns = _array(part["history_id"]), matrix_of(part["vector"]), [_array(part[c]) for c in carry]
        found[cell] = Shells(pivots[cell], *columns, size)
    return found


def _in_stretches(index: HistoryIndex, span: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Order of the cells, stretch of every cell, and (cell, stretch, cuts) of those that hold rows; a stretch is cut as its largest cell asks for."""
    order = _side_by_side(index.pivots, index.sizes, span)
    stretch = np.empty(len(order), np.int64)
    stretch[order] = (np.cumsum(index.sizes[order]) - index.sizes[order]) // span
    placed = [(c, int(stretch[c]), int(-(-n // span))) for c, n in enumerate(index.sizes.tolist()) if n]
    cuts = {}
    for _, where, hcuts in placed:
        cuts[where] = max(cuts.get(where, 1), hcuts)
    return order, stretch, [(c, w, cuts[w]) for c, w, _ in placed]


def _ship(filed: DataFrame, placed: Sequence[tuple[int, int, int]]) -> list:
    """(stretch, broadcast) for all pieces of the history, each a compressed Arrow stream. The driver holds a few at a time, and none when done."""
    spark = filed.sparkSession
    stretches = spark.createDataFrame(list(placed), "cell int, stretch int, hcuts int")
    piece = F.pmod(F.xxhash64("history_id"), F.col("hcuts")).cast("int").alias("piece")
    rows = filed.join(F.broadcast(stretches), "cell").select("stretch", piece, *filed.columns)

    def pack(part: pa.Table) -> pa.Table:
        sink, kept = pa.BufferOutputStream(), part.drop_columns(["stretch", "piece"])
        with pa.ipc.new_stream(sink, kept.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
            out.write_table(kept)
        packed = pa.array([sink.getvalue().to_pybytes()], pa.binary())
        return pa.table({"stretch": part["stretch"].combine_chunks().slice(0, 1), "packed": packed})

    packed = rows.groupBy("stretch", "piece").applyInArrow(pack, "stretch int, packed binary")
    return [(r["stretch"], spark.sparkContext.broadcast(bytes(r["packed"]))) for r in packed.toLocalIterator(prefetchPartitions=True)]


def sent(shipped):
    """The value of a broadcast, which the worker doesn't keep (but what came to it decrypted can't be read again)."""
    path = getattr(shipped, "_path", None)
    return shipped.load_from_path(path) if path else shipped.value


def _opened(shipped) -> pa.Table:
    """A piece of :func:`_ship`."""
    return pa.ipc.open_stream(sent(shipped)).read_all()


def _gathered(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.Table]:
    """Tables of ``n`` rows, the last one of fewer."""
    held, count = [], 0
    for batch in batches:
        held, count = [*held, batch], count + batch.num_rows
        while count >= n:
            table = pa.Table.from_batches(held)
            yield table.slice(0, n)
            held, count = table.slice(n).to_batches(), count - n
    if count:
        yield pa.Table.from_batches(held)


def _shipped_search(queries, index: HistoryIndex, k, carry, exclude_self, block_rows, schema) -> DataFrame:
    """Each task takes neighbouring queries through the whole history: their nearest cells first, then all that their bound reaches.

    A task emits ``k`` rows a query at most. It holds one chunk of history and some ten thousand queries with their best rows.
    """
    spark, arrow = queries.sparkSession, _arrow_schema(schema)
    total, dims = int(index.sizes.sum()), index.pivots.shape[1]
    span = max(block_rows, min(TASK_ROWS, CHUNK_NUMBERS // max(dims, 1)))
    order, stretch, placed = _in_stretches(index, span)
    if index.chunks is None:
        object.__setattr__(index, "chunks", {})
    if (key := (span, *carry)) not in index.chunks:  # of many batches that ask one index, the first sends it
        index.chunks[key] = _ship(index.rows.select("history_id", "vector", "cell", *carry), placed)
    chunks = index.chunks[key]
    wanted = max(k + int(exclude_self), total // NEAR)
    places = np.argsort(order)
    radii = np.where(np.isfinite(index.radii), index.radii, np.pi)  # a row that is no number has no angle
    shipped = spark.sparkContext.broadcast((index.pivots, radii, index.sizes, stretch, places))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, _, _, _, places = shipped.value
        sides = _directions(pivots).T
        for batch in _slices(batches):
            nearest = places[(_directions(matrix_of(batch.column("vector"))) @ sides).argmax(axis=1)] if batch.num_rows else places[:0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest, pa.int64())], names=[*batch.schema.names, "place"])

    asked = T.StructType([*queries.schema.fields, T.StructField("place", T.LongType())])
    asked = materialize(queries.mapInArrow(place, asked), "asked")
    number = asked.count()
    share = max(min(number, BLOCK_ROWS // 4), min(ASKED_ROWS, number // STRETCH))
    asked = asked.repartitionByRange(max(1, -(-number // max(share, 1))), "place", F.xxhash64("query_id")).drop("place")

    def nearest_cells(vectors: np.ndarray, pivots: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        near = np.zeros((len(vectors), len(pivots)), bool)
        for at in range(0, len(vectors), 1024):
            by_angle = np.argsort(_angles(vectors[at : at + 1024], pivots), axis=1, kind="stable")
            held = sizes[by_angle]
            np.put_along_axis(near[at : at + 1024], by_angle, np.cumsum(held, axis=1) - held < wanted, axis=1)
        return near & (sizes > 0)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, radii, sizes, stretch, _ = shipped.value
        for table in _gathered(batches, 2 * ASKED_ROWS):
            blocks = []
            for at in range(0, table.num_rows, BLOCK_ROWS):
                part = table.slice(at, BLOCK_ROWS)
                vectors = matrix_of(part["vector"])
                best = Best(_array(part["query_id"]), vectors, k, exclude_self)
                blocks.append((best, nearest_cells(vectors, pivots, sizes)))
            for first in (True, False):
                for where, chunk in chunks:
                    cells = np.flatnonzero((stretch == where) & (sizes > 0))
                    visits = []
                    for best, near in blocks:
                        visit = near[:, cells]
                        if not first:
                            angles = _angles(best.queries, pivots[cells])
                            possible = np.cos(np.maximum(angles - radii[cells] - SLACK, 0.0)) + SLACK
                            visit = ~visit & (possible >= (best.low / SCALE)[:, None])
                        visits.append(visit)
                    if not any(v.any() for v in visits):
                        continue
                    filed = _shells(_opened(chunk), pivots, carry, min(block_rows, SHELL_ROWS))
                    for (best, _), visit in zip(blocks, visits):
                        for c in np.flatnonzero(visit.any(axis=0)):
                            if int(cells[c]) in filed:
                                filed[int(cells[c])].visit(best, np.flatnonzero(visit[:, c]))
                        best.tighten()
            for best, _ in blocks:
                columns = best.columns()
                if columns is not None:
                    yield _batch(columns, arrow)

    return asked.mapInArrow(search, schema)


def _bytes_shipped(index: HistoryIndex, carry: Sequence[str]) -> int:
    """Upper estimate of what :func:`_ship` sends to an executor."""
    numbers = index.pivots.shape[1] * (4 if index.rows.schema["vector"].dataType == T.ArrayType(T.FloatType()) else 8)
    return int(index.sizes.sum()) * (numbers + 32 + 8 * len(carry)) + _bytes_of(index.rows.select("history_id", *carry))


def _grid_search(queries, index: HistoryIndex, k, carry, exclude_self, qid_type, block_rows):
    schema = _result_schema(index.rows, "history_id", carry, qid_type)
    if not index.sizes.any():
        return queries.sparkSession.createDataFrame([], schema)
    if _bytes_shipped(index, carry) <= MAX_SHIPPED:
        return _shipped_search(queries, index, k, carry, exclude_self, block_rows, schema)
    return _shuffled_search(queries, index, k, carry, exclude_self, block_rows, schema)


def _shuffled_search(queries, index: HistoryIndex, k, carry, exclude_self, block_rows, schema):
    filed = index.rows.select("history_id", "vector", "cell", *carry)
    total = int(index.sizes.sum())
    _, stretch, placed = _in_stretches(index, max(STRETCH * block_rows, min(TASK_ROWS, total // STRETCH)))
    stretches = queries.sparkSession.createDataFrame(placed, "cell int, stretch int, hcuts int")

    def probe(visits: DataFrame) -> DataFrame:
        at = F.transform("cells", lambda c: F.element_at(F.lit(stretch.tolist()), c + 1))
        opened = visits.withColumn("at", at).withColumn("stretch", F.explode(F.array_distinct("at")))
        mine = F.filter("cells", lambda c: F.element_at(F.lit(stretch.tolist()), c + 1) == F.col("stretch"))
        opened = opened.select("query_id", "vector", "bound", F.col("stretch").cast("int").alias("stretch"), mine.alias("cells"))
        return _block_join(opened, filed, stretches, index.pivots, k, carry, exclude_self, block_rows, schema)

    wanted = max(k + int(exclude_self), total // NEAR)
    near = materialize(_nearest_cells(queries, index.pivots, index.sizes, wanted), "near")
    first = materialize(top_candidates(probe(near.withColumn("bound", F.lit(-np.inf))), k), "first")
    bounds = first.groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("similarity")).alias("bound")
    )
    bounded = near.join(bounds, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(-np.inf)))
    rest = materialize(_reachable_cells(bounded, index.pivots, index.radii, index.sizes), "rest")
    second = probe(rest)
    return first.select(*second.columns).unionByName(second)


def top_candidates(pairs: DataFrame, k: int) -> DataFrame:
    """Rank per query by similarity, then id; keeps ``k``. Limited per task before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.asc("history_id"))
    return pairs.withColumn("semantic_rank", F.row_number().over(order)).where(
        F.col("semantic_rank") <= k
    )


def semantic_candidates(
    queries: DataFrame,
    history: DataFrame | None,
    k: int = 50,
    carry: Sequence[str] = (),
    exclude_self: bool = False,
    strategy: str = "auto",
    max_broadcast_bytes: int = 64 << 20,
    n_pivots: int = 4096,
    block_rows: int = 4096,
    index: HistoryIndex | None = None,
) -> DataFrame:
    """The ``min(k, n)`` most similar history rows per query.

    ``queries``: query_id, embedding; ``history``: history_id, embedding and the ``carry`` columns
    that shall travel with a candidate. ``exclude_self`` leaves out the row with the query's own id.
    Rows without a vector take no part. ``index`` is a prepared index of the same history; it may stand in for ``history``.
    """
    q = vectors_of(queries, "query_id")
    qid_type = q.schema["query_id"].dataType
    if strategy == "auto":
        numbers, asked = q.agg(F.coalesce(F.sum(F.size("vector")), F.lit(0)), F.count(F.lit(1))).first()
        strategy = "broadcast" if numbers * 8 <= max_broadcast_bytes and asked * k <= MAX_KEPT else "grid"
    if strategy == "broadcast":
        h = index.rows if history is None else vectors_of(history, "history_id", carry)
        pairs = _broadcast_scan(q, h, k, list(carry), exclude_self, qid_type)
    else:
        index = index or index_history(history, carry, n_pivots)
        pairs = _grid_search(q, index, k, list(carry), exclude_self, qid_type, block_rows)
    return top_candidates(pairs, k)


def rerank(
    candidates: DataFrame,
    intents: DataFrame,
    top_k: int = 5,
    semantic_weight: float = 0.80,
    intent_weight: float = 0.20,
) -> DataFrame:
    """Best ``top_k`` candidates by weighted similarity and intent agreement.

    ``candidates`` carry the history ``intent``; ``intents``: query_id, predicted_intent. A match
    outside the semantic candidates can never enter. Ties keep the semantic order. Both
    windows partition by query, so re-ranking adds no shuffle to the semantic ranking.
    """
    match = F.col("intent").eqNullSafe(F.col("predicted_intent")).cast("int")
    scored = candidates.join(intents.select("query_id", "predicted_intent"), "query_id").withColumn(
        "intent_match", match
    )
    score = F.lit(semantic_weight) * F.col("similarity") + F.lit(intent_weight) * F.col("intent_match")
    scored = scored.withColumn("score", F.round(score, DECIMALS))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("semantic_rank"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def gather_cases(cases: DataFrame, history: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fetch wide history columns for the few winning rows only; a case without a history row keeps nulls.

    A case that is everybody's neighbour is dealt to as many tasks as its count asks for. Only rows that some case
    names are looked at.
    """
    wanted = cases.select(F.col("history_id").alias("__wanted")).distinct()
    rows = history.select(F.col("history_id").alias("__id"), *columns).join(broadcast_if_small(wanted), F.col("__id") == F.col("__wanted"), "left_semi")
    return lookup_join(cases, "history_id", rows, "__id", "left").drop("__id")


def best_similarity(cases: DataFrame, profile: str) -> DataFrame:
    """Runtime: similarity of the first re-ranked case. Batch: the maximum over the cases."""
    value = (
        F.max("similarity")
        if profile == "batch"
        else F.max(F.when(F.col("rank") == 1, F.col("similarity")))
    )
    return cases.groupBy("query_id").agg(value.alias("best_similarity"))


def wide_cases(cases: DataFrame, fields: Sequence[str], k: int = 5) -> DataFrame:
    """One row per query with ``retrieved_{rank}_{field}`` columns."""
    aggs = [
        F.max(F.when(F.col("rank") == r, F.col(f))).alias(f"retrieved_{r}_{f}")
        for r in range(1, k + 1)
        for f in fields
    ]
    return cases.groupBy("query_id").agg(*aggs)


def nested_cases(cases: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row per query with the cases as an array of structs in rank order (at most top_k)."""
    entry = F.struct("rank", *fields)
    return cases.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("retrieved"))
