"""The ledger kept as a stream's own state: dispositions without a table to join, in the state store that Spark keeps."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

OUT = "row_index long, ledger_key string, fp string, batch string, disposition string"
STATE = "fp string, batch string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Dispositions(StatefulProcessor):
    """What each row of a ledger key comes to, given the fingerprint that the key had last and the batch that gave it that.

    expire_ms: a key whose last row (seen_at) lies so far behind the stream's watermark is forgotten, and counts as new when it
    comes again.
    """

    def __init__(self, expire_ms: int | None = None):
        self.expire_ms = expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fp, batch = self.last.get() if self.last.exists() else (None, None)
        seen = 0
        for r in sorted(rows, key=lambda r: r.row_index):  # the rows of one key in one micro-batch
            kind = "inserted" if batch is None else "updated" if fp != r.fp else "duplicate" if batch == r.batch else "unchanged"
            if kind in ("inserted", "updated"):
                fp, batch = r.fp, r.batch
            if self.expire_ms is not None:
                seen = max(seen, int(r.seen_at.timestamp() * 1000))
            yield Row(row_index=r.row_index, ledger_key=key[0], fp=r.fp, batch=r.batch, disposition=kind)
        self.last.update((fp, batch))
        if self.expire_ms is not None:
            for at in list(self.handle.listTimers()):
                seen = max(seen, at - self.expire_ms)
                self.handle.deleteTimer(at)
            self.handle.registerTimer(seen + self.expire_ms)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.last.update((initialState.fp, initialState.batch))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


def dispositions(rows: DataFrame, known: DataFrame | None = None, expire_ms: int | None = None) -> DataFrame:
    """OUT for a stream of (row_index, ledger_key, fp, batch): inserted, updated, duplicate (the key's last change came from
    this batch) or unchanged, for each row in the order of row_index within its micro-batch.

    known (ledger_key, fp, batch): what a ledger has of each key when the stream starts without state of its own.
    expire_ms needs the time of each row in seen_at. A task sorts the rows that one key has in one micro-batch.
    """
    if expire_ms is not None:
        rows = rows.withWatermark("seen_at", "0 seconds")
    keyed = rows.select("row_index", "ledger_key", "fp", "batch", *(["seen_at"] if expire_ms is not None else [])).groupBy("ledger_key")
    first = known.select("ledger_key", "fp", "batch").groupBy("ledger_key") if known is not None else None
    return keyed.transformWithState(statefulProcessor=Dispositions(expire_ms), outputStructType=OUT, outputMode="append", timeMode="none" if expire_ms is None else "eventTime", initialState=first)


def start(rows: DataFrame, path: str, checkpoint: str, known: DataFrame | None = None, expire_ms: int | None = None) -> StreamingQuery:
    """Start writing dispositions as Parquet until the stream has no more rows. State is in the checkpoint: a restart goes on
    with it, a replayed micro-batch finds it as it was, and another checkpoint begins with `known`."""
    spark = rows.sparkSession
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)  # which this kind of state needs; the query keeps it with its checkpoint
    try:
        return dispositions(rows, known, expire_ms).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path, format="parquet", outputMode="append")
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def ledger(spark: SparkSession, checkpoint: str) -> DataFrame:
    """ledger_key, fp, batch as a stream's state has them after its last micro-batch."""
    state = spark.read.format("statestore").option("stateVarName", "last").load(checkpoint)
    return state.where(F.col("value").isNotNull()).select(F.col("key.ledger_key").alias("ledger_key"), "value.fp", "value.batch")
