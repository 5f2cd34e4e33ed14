"""Incremental work over files that keep arriving: an availableNow file stream, watermarked dedupe and windows, one table per run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import shared_folder


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events by window and type, each event id once, on a stream or a table."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])
    return once.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def run_once(stream: DataFrame, checkpoint: str, out: str) -> None:
    """All that has arrived, in micro-batches; each batch's rows go to a folder of their own, so a repeated batch overwrites itself."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def counts_of_stream(spark: SparkSession, path: str) -> DataFrame:
    """start, event_type, n after a run over all files of path: of each window the last update."""
    schema = spark.read.parquet(path).schema
    # a pattern, as path may be a single file
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{path}*").withColumn("ts", F.col("ts").cast("timestamp"))
    base = shared_folder(spark, "stream")
    run_once(windowed_counts(stream), f"{base}/checkpoint", f"{base}/out")
    rows = spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out")
    return rows.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"))
