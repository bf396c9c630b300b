"""Keyed state with expiry for streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstArrival(StatefulProcessor):
    """Passes the first row of a key on and remembers the key until it expires."""

    def __init__(self, order: Sequence[str], keep_ms: int):
        self.order, self.keep_ms = list(order), keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "here boolean", ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, best = self.seen.exists(), None
        for part in rows:
            if not known and len(part):
                best = (part if best is None else pd.concat((best, part))).sort_values(self.order).head(1)
        if best is not None:
            self.seen.update((True,))
            yield best

    def close(self) -> None:
        pass


def _thin_out(keys: Sequence[str], order: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row per key of every Arrow batch, so that a hot key sends a row per batch to its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.append_column("__at", pa.array(range(batch.num_rows)))
            rows = rows.sort_by([(c, "ascending") for c in (*order, "__at")])
            first = pa.Table.from_batches([rows]).append_column("__row", pa.array(range(rows.num_rows)))
            keep = first.group_by(list(keys)).aggregate([("__row", "min")])["__row_min"]
            yield batch.take(rows.column("__at").take(keep.combine_chunks()))

    return run


def first_arrivals(stream: DataFrame, keys: Sequence[str], order: Sequence[str], keep_ms: int) -> DataFrame:
    """The first row of every key, whatever its event time; of rows that arrive together the first by ``order``.

    A key is forgotten ``keep_ms`` after it was first seen, so the state holds the keys of that stretch of time, not those of
    all time, and neither late events nor a watermark play a part. Null keys are keys like any other. Start the
    query with :func:`on_rocksdb`.
    """
    named = [f"__k{i}" for i in range(len(keys))]  # null-safe grouping keys
    thin = stream.mapInArrow(_thin_out(keys, order), stream.schema)
    keyed = thin.withColumns({n: F.to_json(F.struct(F.col(k).alias("k"))) for n, k in zip(named, keys, strict=True)})
    return keyed.groupBy(*named).transformWithStateInPandas(
        statefulProcessor=FirstArrival(order, keep_ms), outputStructType=stream.schema, outputMode="Append", timeMode="ProcessingTime"
    )


def on_rocksdb(spark: SparkSession, start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """Start a query whose state lives in RocksDB; the session's settings are put back (a query keeps what it began with).

    Batches without rows are off: with processing time they would follow each other without end, and a run over what
    is there (``availableNow``) would never stop. Expired keys leave with the next rows.
    """
    settings = {PROVIDER: ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        return start()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
