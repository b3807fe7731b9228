"""Starting streams and draining them into the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from copytrail.session import ROCKSDB, scratch_path


#: Batches whose progress a drained query remembers.
PROGRESS = 10_000
#: Whether a state store counts its rows.
COUNTED = "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows"
#: The time of the last tick.
END = "2999-01-01 00:00:00"


class LateRowsError(RuntimeError):
    """A stream dropped rows."""


def start_append(stream: DataFrame, path: str, checkpoint: str, partition_by: tuple[str, ...] = ()) -> StreamingQuery:
    """Continuous append of a stream to a Parquet table with its own checkpoint."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.partitionBy(*partition_by) if partition_by else writer).start()


def start_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Continuous hand-over of micro-batches to an idempotent writer."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def drain(stream: DataFrame, label: str) -> DataFrame:
    """Process everything available now and return what was appended; fails if a row came too late to be counted."""
    root = scratch_path(stream.sparkSession, label)
    _drain(stream, root)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/rows")


def drain_closed(build: Callable[[DataFrame], DataFrame], tick_schema: str, label: str, spark: SparkSession) -> DataFrame:
    """Like ``drain`` for streams whose answers wait for the watermark: when all is read, one last tick moves it past every row.

    ``build`` gets a stream of ticks to unite with its input: nothing at first, then, in a second run from the same
    checkpoint, one row with the end of time in every timestamp column and nulls elsewhere.
    """
    root = scratch_path(spark, label)
    schema = spark.createDataFrame([], tick_schema).schema
    spark.createDataFrame([], schema).coalesce(1).write.parquet(f"{root}/ticks")
    stream = build(spark.readStream.schema(schema).parquet(f"{root}/ticks"))
    _drain(stream, root)
    end = spark.range(1).select(*[
        F.lit(END if f.dataType.typeName() == "timestamp" else None).cast(f.dataType).alias(f.name) for f in schema.fields])
    end.write.mode("append").parquet(f"{root}/ticks")
    _drain(stream, root)
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")


def _drain(stream: DataFrame, root: str) -> None:
    spark = stream.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", str(PROGRESS))
    # Counting the rows of a state looks up each row before it is written, and nobody asks a drained query; a query keeps the
    # settings it was started with.
    counted = spark.conf.get(COUNTED, "true")
    spark.conf.set(COUNTED, "false")
    try:
        query = (stream.writeStream.format("parquet").outputMode("append").option("path", f"{root}/rows")
                 .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    finally:
        spark.conf.set(COUNTED, counted)
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    if lost := dropped_rows(query):
        raise LateRowsError(f"{lost} rows came after the watermark; the delay must cover the disorder of the input")


def dropped_rows(query: StreamingQuery) -> int:
    """Rows a stream dropped because they came after the watermark; nothing else may lose rows.

    Every batch reports its own number; a query with more batches than are remembered cannot tell and is refused.
    """
    progress = query.recentProgress
    if len(progress) >= PROGRESS:
        raise LateRowsError(f"more than {PROGRESS} batches: count dropped rows with a listener")
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in progress for op in p["stateOperators"])
