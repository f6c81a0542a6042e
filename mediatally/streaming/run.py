"""Running a stream over what its source holds now, with output and checkpoint in the shared scratch folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from mediatally.plans.tables import BASE_TABLES, deps, derived, table
from mediatally.session import scratch_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, or a derived table without aggregates, as a file stream."""
    if name in BASE_TABLES:
        schema = table(spark, sf_dir, name).schema
        return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return derived(spark, name, {dep: stream_table(spark, sf_dir, dep) for dep in deps(name)})


@contextmanager
def _stream_settings(spark: SparkSession) -> Iterator[None]:
    """Settings a stream takes over when it starts: RocksDB state. It has the session's number of partitions."""
    wanted = {_PROVIDER: ROCKSDB}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


LAST_MS = 7_258_118_400_000  # the year 2200; pandas times end in 2262


def closable(stream: DataFrame, **values) -> tuple[DataFrame, Callable[[], None]]:
    """`stream` and a function that ends it: one row far in the future, `values` and else NULL, moves the watermark past
    all other rows, so that a finite table gives all its results. The row itself is never released."""
    spark, schema = stream.sparkSession, stream.schema
    folder = scratch_dir(spark, "closing")
    spark.createDataFrame([], schema).write.parquet(folder)
    closing = spark.readStream.schema(schema).parquet(folder)

    def close() -> None:
        spark.createDataFrame([tuple({"ts_ms": LAST_MS, **values}.get(c) for c in schema.names)], schema).write.mode("append").parquet(folder)

    return stream.unionByName(closing), close


def drain(stream: DataFrame, purpose: str, mode: str = "append", close: Callable[[], None] | None = None) -> DataFrame:
    """Run `stream` until its source is used up and give back what it wrote; with `close` (see `closable`) it then runs to its end.

    Rows go to parquet files, not through the driver. The checkpoint lies beside them, so a run that
    loses executors, or the driver, goes on where it stopped.
    """
    return drain_counted(stream, purpose, mode, *([close] if close else []))[0]


class Batches(NamedTuple):
    """What a stream wrote, and one row per batch and stateful operator: batch_id, operator, rows_late, rows_updated, watermark_ms."""

    rows: DataFrame
    progress: DataFrame


def drain_counted(stream: DataFrame, purpose: str, mode: str = "append", *then: Callable[[], None]) -> Batches:
    """As `drain`, with the numbers of rows that came behind the watermark, batch by batch. After each function of
    `then`, which may bring new files, the stream runs on.

    Spark counts dropped rows after the partial aggregation of a batch, so an aggregate counts late groups, not rows.
    The progress has one small entry per batch.
    """
    spark = stream.sparkSession
    folder = scratch_dir(spark, purpose)
    seen: dict[tuple[int, int], tuple] = {}

    def run() -> None:
        query = (
            stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out")
            .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
        query.awaitTermination()
        for p in query.recentProgress:
            mark = p.eventTime.get("watermark")
            ms = int(datetime.fromisoformat(mark.replace("Z", "+00:00")).timestamp() * 1000) if mark else None
            for i, op in enumerate(p.stateOperators):
                late, updated = seen.get((p.batchId, i), (0, 0, None))[:2]
                seen[p.batchId, i] = (max(late, op.numRowsDroppedByWatermark), max(updated, op.numRowsUpdated), ms)

    with _stream_settings(spark):
        run()
        for step in then:
            step()
            run()
    progress = spark.createDataFrame(
        [(*k, *v) for k, v in sorted(seen.items())], "batch_id bigint, operator int, rows_late bigint, rows_updated bigint, watermark_ms bigint")
    return Batches(spark.read.schema(stream.schema).parquet(f"{folder}/out"), progress)


def feed(stream: DataFrame, purpose: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Run `stream` until its source is used up, each batch handed to `write` with its number."""
    spark = stream.sparkSession
    folder = scratch_dir(spark, purpose)
    with _stream_settings(spark):
        query = stream.writeStream.outputMode(mode).foreachBatch(write).option(
            "checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()


def drain_updates(stream: DataFrame, purpose: str) -> DataFrame:
    """Run an update-mode stream; every batch is written with its number in `batch_id`, later rows replace earlier ones.

    A batch that is run again after a failure overwrites its own folder.
    """
    spark = stream.sparkSession
    folder = scratch_dir(spark, purpose)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch_id={batch_id}")

    with _stream_settings(spark):
        query = stream.writeStream.outputMode("update").foreachBatch(write).option(
            "checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")
