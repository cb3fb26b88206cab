"""Live results as Structured Streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.schemas import LIVE_EVENT


def stream_results(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Frame events as they are written: JSON lines with a ``type`` tag."""
    return spark.readStream.schema(LIVE_EVENT).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def with_event_ids(events: DataFrame) -> DataFrame:
    """Live events with an ``event_id`` (long) made of what tells events apart; an event that is sent twice gets the same one. For text operators, which name results by it."""
    return events.withColumn("event_id", F.xxhash64("type", "source", "original_name", "filename", "event_time", "message"))


def stream_batch_summary(events: DataFrame) -> DataFrame:
    """Running defect counts by class and severity of processed frames."""
    done = events.where(F.col("type") == "update")
    flat = done.select(F.explode("defects").alias("d"))
    return flat.groupBy(F.col("d.class").alias("class"), F.col("d.severity").alias("severity")).agg(F.count(F.lit(1)).alias("defects"))


def stream_dedupe(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """First result of a frame within the watermark; use latest_results to replace instead."""
    return events.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["filename"])


def latest_results(events: DataFrame) -> DataFrame:
    """The latest result per frame: a reprocessed frame replaces the earlier one. Works on both kinds of input."""
    rest = [c for c in events.columns if c != "filename"]
    return events.groupBy("filename").agg(F.max_by(F.struct(*rest), F.col("event_time")).alias("_r")).select("filename", "_r.*")


def stream_progress(events: DataFrame, total: int) -> DataFrame:
    """Done and left frames with the time left at the mean pace so far."""
    sec = F.unix_micros("event_time") / 1e6
    agg = events.where(F.col("type").isin("update", "item_error")).agg(
        F.count(F.lit(1)).alias("done"), (F.max(sec) - F.min(sec)).alias("elapsed_sec")
    )
    left = F.lit(total) - F.col("done")
    eta = F.when(F.col("done") > 0, F.ceil(left * (F.col("elapsed_sec") / F.col("done"))))
    return agg.select("done", left.alias("left"), "elapsed_sec", eta.cast("long").alias("eta_sec"))


def run_available(sdf: DataFrame, folder: str, mode: str) -> DataFrame:
    """Process all available input and return the result table, written under ``folder``."""
    spark, folder = sdf.sparkSession, folder.rstrip("/")
    writer = sdf.writeStream.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{folder}/out").outputMode("append").start()
    else:
        keep = lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/out")
        query = writer.foreachBatch(keep).outputMode(mode).start()
    query.awaitTermination()
    return spark.read.schema(sdf.schema).parquet(f"{folder}/out")
