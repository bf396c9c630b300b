"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(app: str = "deskwise", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, the folder every executor can reach.

    Where it is unset, a session whose master is this machine takes a new temporary folder once; on a cluster that is an
    error, because executors would not see the path.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="deskwise-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def tables(spark: SparkSession, sf_dir: str):
    """``t("documents")`` reads one table of a folder of parquet files."""
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 64 << 20
NARROW = 4_000_000  # rows of a key and a number that may be sent where the other side has whole texts


def _size_of(df: DataFrame) -> tuple[int, int]:
    """Rows, and bytes of the columns of varying size; (0, 0) if there are none: fixed-size rows are bounded by their number."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    loose = [c for c, kind in kinds.items() if kind in ("string", "binary", "array", "map", "struct", "variant")]
    if not loose:
        return 0, 0
    texts = {c: F.col(f"`{c}`") if kinds[c] in ("string", "binary") else F.to_json(F.struct(F.col(f"`{c}`"))) for c in loose}
    sizes = (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") for text in texts.values())
    n, total = df.agg(F.count(F.lit(1)), F.sum(sum(sizes, F.lit(0).cast("long")))).first()
    return n, total or 0


def _bytes_of(df: DataFrame) -> int:
    return _size_of(df)[1]


def small_table(df: DataFrame, max_rows: int | None = None, max_bytes: int | None = None) -> DataFrame | None:
    """A lookup table, computed once and marked for broadcast; None above ``max_rows`` rows or ``max_bytes``.

    Texts, lists and the like are measured where they lie before anything is moved or reaches the driver.
    """
    limit = MAX_BROADCAST_ROWS if max_rows is None else max_rows
    most = MAX_BROADCAST_BYTES if max_bytes is None else max_bytes
    n, size = _size_of(df)
    if n > limit or size > most:
        return None
    rows = df.limit(limit + 1).toArrow()
    if rows.num_rows > limit:
        return None
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def broadcast_if_small(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """:func:`small_table`, or the table itself, unmarked, so that the join shuffles."""
    small = small_table(df, max_rows)
    return df if small is None else small


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    Used where several later steps read one expensive result: it is computed once, its lineage
    ends there, and losing an executor does not lose it. The caller owns the folder's retention.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
