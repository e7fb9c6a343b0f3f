"""Streaming usage counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import constants as C


def _timed(stream: DataFrame, column: str, lateness: str) -> DataFrame:
    """Watermarks need an instant; zoneless columns are read in the session zone."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(
        column, lateness)


def daily_counts(cases: DataFrame) -> DataFrame:
    """Counts per day, class and source of facts."""
    return cases.groupBy(F.to_date("ts").alias("day"), "classification", "source").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("knn_was_correct").alias("knn_correct"),
        F.count_if(~F.col("knn_was_correct")).alias("knn_incorrect"))


def write_daily_counts(cases: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a query that keeps each micro-batch's own daily counts below ``path``.

    There is no state and no watermark, so a fact counts however late it comes; a repeated batch
    replaces its own folder. ``read_daily_counts`` adds the batches up.
    """
    def put(batch: DataFrame, number: int) -> None:
        daily_counts(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return cases.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"processingTime": "5 seconds"})).start()


def read_daily_counts(spark: SparkSession, path: str) -> DataFrame:
    """(day, classification, source, n, knn_correct, knn_incorrect) over all stored batches."""
    return spark.read.parquet(path).groupBy("day", "classification", "source").agg(
        *[F.sum(c).alias(c) for c in ("n", "knn_correct", "knn_incorrect")])


def stream_window_counts(events: DataFrame, keys: list[str], lateness: str = "10 minutes",
                         size: str = "1 hour") -> DataFrame:
    """Counts per tumbling window and key, final once the watermark has passed (append mode)."""
    return _timed(events, "ts", lateness).groupBy(
        F.window("ts", size).alias("w"), *keys
    ).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), *keys, "n")


def deduplicated(reports: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Reports once per id, with the memory of ids bounded by the watermark."""
    return _timed(reports, "arrived_at", lateness).dropDuplicatesWithinWatermark(
        ["report_id"])


def monthly(days: DataFrame) -> DataFrame:
    """Month totals of ``read_daily_counts`` rows."""
    return days.groupBy(F.year("day").alias("year"), F.month("day").alias("month")).agg(
        F.sum("n").alias("total"),
        *[F.sum(F.when(F.col("classification") == c, F.col("n")).otherwise(0)).alias(c)
          for c in C.LABELS],
        *[F.sum(F.when(F.col("source") == s, F.col("n")).otherwise(0)).alias(s)
          for s in C.SOURCES])
