"""Extensions: the ledger as an unbounded stream (no batch query depends on it)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def daily_counts(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Events and amount per day and type; late rows beyond the watermark are dropped."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("amount"))


def sessions(events: DataFrame, gap: str = "2 hours", delay: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def deduplicated(events: DataFrame, delay: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
