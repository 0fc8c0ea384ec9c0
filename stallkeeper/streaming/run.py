"""Sources and sinks of streams. Progress and state live in the shared checkpoint folder."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from stallkeeper.session import scratch, settings

#: A moment after all data; a row there closes every window, session and timer before it.
END = datetime(2200, 1, 1)
#: State that grows with the keys: executors hold only the partitions at work and read them from the checkpoint in each batch. Without copies in
#: memory Spark writes no snapshots, so a partition's changes are all read again: for streams that end after some tens of batches.
#: Tables that the step deals alike by a part of their keys are joined as they are.
ON_DISK = {"streaming__maxBatchesToRetainInMemory": "0", "requireAllClusterKeysForCoPartition": "false"}
#: Shuffles of past batches stay on disk until the driver collects its garbage: it does so at least after so many seconds.
COLLECT_SECONDS = 10


def read_files(spark: SparkSession, folder: str, schema: str, pattern: str, files_per_batch: int = 1000) -> DataFrame:
    """Files of a folder as a stream; the number of files per micro-batch bounds what one batch holds."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def event_time(df: DataFrame, column: str, delay: str) -> DataFrame:
    """Watermarks need a timestamp with zone: wall-clock times are taken in the session zone, which should be UTC."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def append_to(df: DataFrame, path: str, checkpoint: str, on_disk: bool = False) -> int:
    """Drain what is available into a Parquet table, each row exactly once; returns how many rows came after the watermark."""
    with settings(df.sparkSession, **(ON_DISK if on_disk else {})):
        query = (
            df.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
            .option("path", path).option("checkpointLocation", checkpoint).option("compression", "zstd").start()
        )
        while not query.awaitTermination(COLLECT_SECONDS):
            df.sparkSession.sparkContext._jvm.System.gc()
    return sum(operator["numRowsDroppedByWatermark"] for batch in query.recentProgress for operator in batch["stateOperators"])


def drain(df: DataFrame, name: str) -> DataFrame:
    """Append-mode drain into a new table, read back."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    append_to(df, path, scratch(spark, f"{name}-progress"))
    return spark.read.schema(df.schema).parquet(path)


def drain_closed(
    source: DataFrame, column: str, step: Callable[[DataFrame], DataFrame], name: str, allow_late: bool = False, on_disk: bool = False
) -> DataFrame:
    """Append-mode drain of a step whose results wait for a watermark on `column`; then the stream is ended.

    Results are written once, when the watermark passes them, and state is freed. The newest ones would wait for ever, so a
    second run of the same query reads an end marker: a row at END whose other columns are NULL. The step sets the watermark
    itself and must let the marker reach it: no filter on other columns, no inner join (Spark moves both below watermarks). Rows later than the watermark are counted; unless `allow_late`,
    they raise an error, so that a result is whole. With `on_disk` the state is kept as ON_DISK says, for keys that do not fit in memory.
    """
    spark, path, progress, ends = source.sparkSession, *(scratch(source.sparkSession, f"{name}{part}") for part in ("", "-progress", "-ends"))
    marker = T.StructType([source.schema[column]])
    spark.createDataFrame([], marker).write.parquet(ends)
    marked = step(source.unionByName(spark.readStream.schema(marker).parquet(ends), allowMissingColumns=True))
    late = append_to(marked, path, progress, on_disk)
    spark.createDataFrame([(END,)], marker).coalesce(1).write.mode("append").parquet(ends)
    late += append_to(marked, path, progress, on_disk)
    if late and not allow_late:
        raise RuntimeError(f"{name}: {late} rows came after the watermark; allow a longer delay")
    return spark.read.schema(marked.schema).parquet(path)


def drain_batches(df: DataFrame, step: Callable[[DataFrame], DataFrame], name: str, schema: str) -> DataFrame:
    """Run a batch operator on every micro-batch. A repeated batch overwrites its own folder, so rows stay exactly once."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = df.writeStream.foreachBatch(write).trigger(availableNow=True).option("checkpointLocation", scratch(spark, f"{name}-progress")).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(path).drop("batch")
