"""Windowed detectors on a Structured Streaming source.

Each function turns a stream into a stream; `run_available` drives one over everything that has arrived and returns
what it wrote. With append output a window appears once, when the watermark has passed its end, so later runs add rows
and never change them; rows later than the watermark are dropped by Spark. `run_bounded` is for a source that has
ended: it also writes the windows that are still open.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, TimestampNTZType

from ledgerlens.functions.clock import as_instant, as_wall_clock, is_after_hours
from ledgerlens.session import own_folder


def read_events(
    spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet", files_per_batch: int | None = None
) -> DataFrame:
    """Parquet files of a folder as a stream with `hour`, the clock hour of the event.

    A `ts` without zone is carried as the same clock reading in UTC, so days and windows are calendar days and do not
    move with the session's zone.
    """
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    events = reader.parquet(folder).withColumn("hour", F.hour("ts"))
    if isinstance(schema["ts"].dataType, TimestampNTZType):
        events = events.withColumn("ts", as_instant(F.col("ts")))
    return events


def after_hours_events(events: DataFrame) -> DataFrame:
    """Every event after hours. Stateless."""
    late = events.filter(is_after_hours(F.col("hour")))
    return late.select("event_id", "user_id", as_wall_clock(F.col("ts")).alias("ts"), "hour")


def daily_repeats(events: DataFrame, key: str = "user_id", late: str = "1 day", min_rows: int = 2) -> DataFrame:
    """Keys with several events on one day; state is one counter per key and open day."""
    counted = (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", "1 day"), key)
        .agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
    )
    return counted.filter(F.col("events") >= min_rows).select(
        as_wall_clock(F.col("window.start")).cast("date").alias("day"), key, "events", "total"
    )


def sliding_history(
    events: DataFrame, key: str = "user_id", length: str = "30 days", slide: str = "1 day", late: str = "1 day"
) -> DataFrame:
    """Count and mean value per key over sliding windows."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", length, slide), key)
        .agg(F.count(F.lit(1)).alias("events"), F.avg("value").alias("average"))
        .select(
            as_wall_clock(F.col("window.start")).alias("start"),
            as_wall_clock(F.col("window.end")).alias("end"),
            key,
            "events",
            "average",
        )
    )


def failure_bursts(
    events: DataFrame, key: str = "user_id", gap: str = "6 hours", late: str = "1 day", min_failures: int = 2
) -> DataFrame:
    """Sessions of failed attempts no further apart than `gap`."""
    sessions = (
        events.filter(F.col("event_type") == "error")
        .withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap), key)
        .agg(F.count(F.lit(1)).alias("failures"), F.max("ts").alias("last_at"))
    )
    return sessions.filter(F.col("failures") >= min_failures).select(
        as_wall_clock(F.col("session_window.start")).alias("first_at"),
        as_wall_clock(F.col("last_at")).alias("last_at"),
        key,
        "failures",
    )


def run_available(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Process everything available, then stop; returns the written rows. A second run on the same folder resumes."""
    spark = stream.sparkSession
    folder = folder or own_folder(spark, "streams")
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", f"{folder}/progress")
        .option("path", f"{folder}/rows")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def run_bounded(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Process a windowed stream whose source has ended and return all rows, those of open windows included.

    Complete output holds every window seen so far; each batch replaces what the one before it wrote.
    """
    spark = stream.sparkSession
    folder = folder or own_folder(spark, "streams")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows")

    query = (
        stream.writeStream.foreachBatch(put)
        .outputMode("complete")
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
