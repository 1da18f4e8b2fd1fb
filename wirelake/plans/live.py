"""Queries by Structured Streaming: the table is read as a stream of its files until its end."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelake.session import cut, table


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    path = f"{d}/{name}.parquet"
    schema = table(spark, d, name).schema
    # a table is a folder of parts or one file; a stream wants a pattern for the latter
    pattern = f"{path}/*.parquet" if os.path.isdir(path.removeprefix("file://")) else f"{d}/{name}.parquet*"
    # watermarks want an instant
    return spark.readStream.schema(schema).parquet(pattern).withColumn("ts", F.col("ts").cast("timestamp"))


def _finished(df: DataFrame) -> DataFrame:
    """What a stream has put out when its input is at its end. Meant for results of the size of a
    report, as they pass through memory."""
    name = f"live_{uuid.uuid4().hex}"
    spark = df.sparkSession
    q = df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    out = cut(spark.table(name))
    spark.catalog.dropTempView(name)
    return out


def live_windows(spark: SparkSession, d: str) -> DataFrame:
    """Rows and values per event type and hour."""
    rows = _stream(spark, d, "events").withWatermark("ts", "1 day")
    counts = rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    return _finished(counts.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", "low", "high"))


def live_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Users' events in windows of a day that begin every twelve hours."""
    rows = _stream(spark, d, "events").withWatermark("ts", "2 days")
    counts = rows.groupBy(F.window("ts", "24 hours", "12 hours").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return _finished(counts.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n"))


QUERIES = {"live_windows": live_windows, "live_sliding": live_sliding}
ORACLES = {
    "live_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n, min(value) AS low, max(value) AS high FROM events GROUP BY ALL",
    "live_sliding": """SELECT strftime(make_timestamp((epoch_us(ts) // 43200000000 - k) * 43200000000), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events CROSS JOIN (VALUES (0), (1)) AS x(k) GROUP BY ALL""",
}
