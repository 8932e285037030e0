"""Counts and new values of a table that grows, as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(stream: DataFrame, time: str, key: str, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows of each key and time window; rows later than ``late`` are left out and closed windows leave the state."""
    s = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return s.groupBy(F.window(time, size).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def new_values(stream: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Rows of the stream whose value the table seen before doesn't have (a stream-static anti join)."""
    return stream.join(known.select(column).distinct(), column, "left_anti")
