"""Approximate top-k retrieval: an inverted file of product-quantised residuals, and exact scores for a bounded rest.

History vectors are filed under their nearest pivot. What is left of a vector after its pivot is cut into
``subspaces`` pieces, and each piece becomes the number of its nearest codeword, one byte. A search reads bytes
instead of vectors: an eighth of the volume at 64 float dimensions and 32 pieces. The best ``rescore`` rows of a query by
these approximate scores, a number that does not grow with the history, are scored exactly.

The exact strategies of :mod:`deskwise.operators.retrieval` stay the default. How many of the true best rows are found
depends on the vectors; :func:`recall` measures it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from deskwise.functions import vectors as vx
from deskwise.operators.joins import lookup_join
from deskwise.operators.retrieval import DECIMALS, Best, HistoryIndex, Items, index_history, load_index, matrix_of, top_candidates
from deskwise.session import materialize, shared_dir

CODES_AT_ONCE = 4096


@dataclass(frozen=True)
class QuantisedIndex:
    """``filed``: the history by pivots; ``codes``: history_id, cell, code (bytes); ``books``: (subspaces, codewords, dims of a piece)."""

    filed: HistoryIndex
    codes: DataFrame
    books: np.ndarray

    def decode(self, code: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """The vectors that rows of codes stand for."""
        return decoded(code, cell, self.books, self.filed.pivots)


def pieces(vectors: np.ndarray, n: int) -> np.ndarray:
    """(n, rows, dims of a piece): vectors cut into ``n`` pieces, the last ones filled up with zeros."""
    width = -(-vectors.shape[1] // n)
    padded = np.pad(vectors, ((0, 0), (0, n * width - vectors.shape[1])))
    return padded.reshape(len(vectors), n, width).transpose(1, 0, 2)


def decoded(code: np.ndarray, cell: np.ndarray, books: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    rest = np.concatenate([book[c] for book, c in zip(books, code.T, strict=True)], axis=1)
    return pivots[cell] + rest[:, : pivots.shape[1]]


def nearest_codes(parts: np.ndarray, books: np.ndarray) -> np.ndarray:
    """(rows, pieces) numbers of the nearest codewords."""
    found = [(p @ b.T - 0.5 * (b * b).sum(axis=1)).argmax(axis=1) for p, b in zip(parts, books, strict=True)]
    return np.stack(found, axis=1).astype(np.uint8)


def lloyd(points: np.ndarray, n: int, rounds: int, seed: int) -> np.ndarray:
    """``n`` codewords of a bounded sample; codewords without points stay where they are."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(points, axis=0)
    words = rng.permutation(distinct)[:n]
    words = np.concatenate((words, np.repeat(words[:1], n - len(words), axis=0)))
    for _ in range(rounds):
        near = (points @ words.T - 0.5 * (words * words).sum(axis=1)).argmax(axis=1)
        counts = np.bincount(near, minlength=n)
        sums = np.zeros_like(words)
        np.add.at(sums, near, points)
        words = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], words)
    return words


def _residuals(filed: HistoryIndex, rows: DataFrame, keep: Sequence[str], name: str, of, kind: T.DataType) -> DataFrame:
    """``rows`` with a column computed from residuals: ``of`` turns an (n, d) matrix into a list column."""
    shipped = rows.sparkSession.sparkContext.broadcast(filed.pivots)
    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            rest = matrix_of(batch.column("vector")) - shipped.value[cell]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), of(rest)], [*keep, name])

    return rows.mapInArrow(run, schema)


def train_books(filed: HistoryIndex, subspaces: int, codewords: int, sample_rows: int, rounds: int, seed: int) -> DataFrame:
    """(piece, words): codewords of every piece, trained side by side, each on at most about ``sample_rows`` residuals."""
    total = int(filed.sizes.sum())
    draw = F.shiftrightunsigned(F.xxhash64("history_id", F.lit(seed)), 11) / float(1 << 53)
    sample = filed.rows.select("history_id", "vector", "cell").where(draw < min(1.0, sample_rows / max(1, total)))

    def cut(rest: np.ndarray) -> pa.Array:
        parts = pieces(rest, subspaces).transpose(1, 0, 2).reshape(len(rest) * subspaces, -1)
        inner = pa.FixedSizeListArray.from_arrays(pa.array(parts.ravel()), parts.shape[1]).cast(pa.list_(pa.float64()))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(parts) + 1, subspaces, dtype=np.int32)), inner)

    parts = _residuals(filed, sample, ["history_id"], "parts", cut, T.ArrayType(T.ArrayType(T.DoubleType())))
    points = parts.select("history_id", F.posexplode("parts").alias("piece", "point"))

    def train(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        points = np.stack(rows.sort_values("history_id")["point"].to_numpy())
        words = lloyd(points, codewords, rounds, seed + key[0])
        return pd.DataFrame({"piece": [key[0]], "words": [words.ravel()], "width": [words.shape[1]]})

    return points.groupBy("piece").applyInPandas(train, "piece int, words array<double>, width int")


def index_quantised(
    history: DataFrame, carry: Sequence[str] = (), subspaces: int = 32, codewords: int = 256, n_pivots: int = 4096,
    sample_rows: int = 65_536, rounds: int = 12, seed: int = 5, path: str | None = None,
) -> QuantisedIndex:
    """File ``history`` (history_id, embedding, carried columns) and write codes and codewords below ``path``.

    Codewords are trained on a sample of at most about ``sample_rows`` rows; every row is encoded.
    """
    spark = history.sparkSession
    path = path or shared_dir(spark, "quantised")
    filed = index_history(history, carry, n_pivots, f"{path}/filed")
    if codewords > 256:
        raise ValueError("a codeword's number has one byte")
    train_books(filed, subspaces, codewords, sample_rows, rounds, seed).coalesce(1).write.parquet(f"{path}/books")
    books = _books(spark, path)

    def encode(rest: np.ndarray) -> pa.Array:
        raw = nearest_codes(pieces(rest, len(books)), books).tobytes()
        return pa.array([raw[k : k + len(books)] for k in range(0, len(raw), len(books))], pa.binary())

    codes = _residuals(filed, filed.rows.select("history_id", "vector", "cell"), ["history_id", "cell"], "code", encode, T.BinaryType())
    codes.write.parquet(f"{path}/codes")
    return load_quantised(spark, path)


def _books(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/books").orderBy("piece").collect()  # one row a piece
    return np.stack([np.reshape(r["words"], (-1, r["width"])) for r in rows]) if rows else np.zeros((0, 0, 0))


def load_quantised(spark: SparkSession, path: str) -> QuantisedIndex:
    return QuantisedIndex(load_index(spark, f"{path}/filed"), spark.read.parquet(f"{path}/codes"), _books(spark, path))


def approximate(queries: DataFrame, index: QuantisedIndex, keep: int, probe_share: float = 1.0, query_rows: int = 4096, code_rows: int = 262_144) -> DataFrame:
    """(query_id, history_id, similarity): of every block of codes the best ``keep`` rows of a query by decoded vectors.

    Queries (query_id, vector) and codes are dealt into blocks of bounded size, and each pair of blocks is one group, whatever
    the number of either. A query visits its nearest cells until they hold ``probe_share`` of the history.
    """
    sizes, pivots, books = index.filed.sizes, index.filed.pivots, index.books
    kinds = [queries.schema["query_id"], index.codes.schema["history_id"], T.StructField("similarity", T.DoubleType())]
    schema = T.StructType(kinds)
    total = int(sizes.sum())
    if not total:
        return queries.sparkSession.createDataFrame([], schema)
    shipped = queries.sparkSession.sparkContext.broadcast((sizes, pivots, books))
    query_blocks = -(-max(1, queries.count()) // query_rows)
    code_blocks = -(-total // code_rows)
    q = queries.select("query_id", "vector", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int").alias("qb"))
    q = q.withColumn("hb", F.explode(F.sequence(F.lit(0), F.lit(code_blocks - 1))))
    h = index.codes.withColumn("hb", F.pmod(F.xxhash64("history_id"), F.lit(code_blocks)).cast("int"))
    h = h.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            sizes, pivots, books = shipped.value
            vectors, asked = matrix_of(left["vector"]), np.arange(left.num_rows)
            visits = None
            if probe_share < 1:
                order = np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")
                before = np.cumsum(sizes[order], axis=1) - sizes[order]
                visits = np.zeros(order.shape, bool)
                np.put_along_axis(visits, order, before < probe_share * sizes.sum(), axis=1)
            best = Best(asked, vectors, keep, False, scale=None)
            for at in range(0, right.num_rows, CODES_AT_ONCE):  # decoded vectors are in memory for so many rows only
                part = right.slice(at, CODES_AT_ONCE)
                cell = part["cell"].to_numpy()
                code = np.frombuffer(b"".join(part["code"].to_pylist()), np.uint8).reshape(-1, len(books))
                items = Items(part["history_id"].to_numpy(), decoded(code, cell, books, pivots))
                best.add(items, allowed=None if visits is None else visits[:, cell[items.order]])
            row, ids, scores = best.columns()
            found = [left["query_id"].combine_chunks().take(pa.array(row)), pa.array(ids, arrow_types[1]), pa.array(scores)]
        return pa.table(found or [pa.array([], t) for t in arrow_types], names=schema.names)

    arrow_types = [to_arrow_type(f.dataType) for f in schema]
    keys = ["qb", "hb"]
    return q.groupBy(*keys).cogroup(h.groupBy(*keys)).applyInArrow(scan, schema)


def quantised_candidates(
    queries: DataFrame, index: QuantisedIndex, k: int = 50, carry: Sequence[str] = (), exclude_self: bool = False,
    rescore: int = 150, probe_share: float = 1.0,
) -> DataFrame:
    """As ``semantic_candidates``, approximately: the best ``k`` of the ``rescore`` rows that look best by their codes.

    ``similarity`` is exact. ``rescore`` bounds the exact products and the vectors fetched for a query.
    """
    asked = queries.where(F.col("embedding").isNotNull()).select("query_id", F.col("embedding").alias("vector"))
    asked = materialize(asked, "asked")
    near = approximate(asked, index, rescore + int(exclude_self), probe_share)
    if exclude_self:
        near = near.where(F.col("query_id") != F.col("history_id"))
    near = top_candidates(near, rescore).select("query_id", "history_id")
    rows = index.filed.rows.select(F.col("history_id").alias("__id"), F.col("vector").alias("__vector"), *carry)
    full = lookup_join(materialize(near, "near"), "history_id", rows, "__id", "inner").drop("__id")
    full = full.join(asked, "query_id").withColumn("similarity", F.round(vx.dot("vector", "__vector"), DECIMALS))
    return top_candidates(full.select("query_id", "history_id", "similarity", *carry), k)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: n_queries, n_true and the share of the true (query_id, history_id) that were found."""
    keys = ["query_id", "history_id"]
    both = truth.select(*keys).join(found.select(*keys).withColumn("hit", F.lit(1)), keys, "left")
    per_query = both.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits"))
    return per_query.agg(
        F.count(F.lit(1)).alias("n_queries"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_true"),
        F.try_divide(F.sum("hits"), F.sum("n")).alias("recall"),
    )
