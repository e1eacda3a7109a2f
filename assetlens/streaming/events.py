"""Structured Streaming: calls by host and window, sessions, first-seen keys, and a versioned cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New Parquet files of a folder, a hundred at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(folder)


def call_windows(events: DataFrame, late: str = "1 hour", width: str = "12 hours") -> DataFrame:
    """Calls and failures by host and window; works on a stream and on a table alike."""
    seen = events.withWatermark("ts", late) if events.isStreaming else events
    return seen.groupBy(F.window("ts", width), "user_id").agg(F.count("*").alias("calls"), F.count_if(F.col("event_type") == "error").alias("failures")).select(F.col("window.start").alias("start"), "user_id", "calls", "failures")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    seen = events.withWatermark("ts", late) if events.isStreaming else events
    return seen.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def upserted(stream: DataFrame, key: str, version: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append every batch's newest version of each key under ``target``; latest() reads the newest of all. A batch that is run again after a
    failure overwrites its own folder, so nothing is doubled."""

    def write(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), version).alias("_row")).select("_row.*")
        newest.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str, key: str, version: str) -> DataFrame:
    rows = spark.read.parquet(target)
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(version, "batch")).alias("_row")).select("_row.*").drop("batch")
