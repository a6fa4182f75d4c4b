"""Incremental work: a stream of planned chunks of which only new ones are spoken."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _has_files(spark: SparkSession, folder: str) -> bool:
    """Whether a table of any batch lies in a folder, on whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return store.exists(path) and any(s.getPath().getName().startswith("batch=") for s in store.listStatus(path))


def speak_new_chunks(
    spark: SparkSession, source: str, schema: str, done: str, checkpoint: str, speak: Callable[[DataFrame], DataFrame], files_per_batch: int = 8
) -> int:
    """Run all chunks that wait under ``source`` through ``speak``, but those whose hash is done; give the batches run.

    Chunks are Parquet files with ``input_hash``. Done chunks are a Parquet table partitioned by batch
    under ``done``: a batch that is run again after a failure overwrites its own partition, so each
    chunk is done once. Sources that are read before are remembered in ``checkpoint``.
    """
    chunks = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def work(batch: DataFrame, n: int) -> None:
        new = batch.dropDuplicates(["input_hash"])
        if _has_files(batch.sparkSession, done):
            before = batch.sparkSession.read.parquet(done).where(F.col("batch") != n)
            new = new.join(before.select("input_hash"), "input_hash", "left_anti")
        speak(new).withColumn("batch", F.lit(n)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(done)

    query = chunks.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len({p["batchId"] for p in query.recentProgress if p["numInputRows"]})


def stage_counts(log: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Reports by window and stage of a stream (or table) of status reports, with a bound for late ones."""
    rows = log.withWatermark("ts", late) if log.isStreaming else log
    return rows.groupBy(F.window("ts", window).alias("w"), "stage").agg(F.count(F.lit(1)).alias("reports")).select(F.col("w.start").alias("start"), "stage", "reports")
