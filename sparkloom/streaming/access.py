"""The access report as a stream (an extension: the batch report is operators.aggregates.access_report)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "ts timestamp, tool string, arg_keys array<string>, n int, empty boolean"


def access_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).json(path)


def windowed_report(log: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, tool, calls, empties, empty_rate) a window; rows later than the watermark are dropped."""
    g = log.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "tool").agg(F.count("*").alias("calls"), F.count_if("empty").alias("empties"))
    return g.select(F.col("w.start").alias("start"), "tool", "calls", "empties", F.round(F.col("empties") / F.col("calls"), 3).alias("empty_rate"))
