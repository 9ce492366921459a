"""Streams of progress, samples and heartbeats: each function takes a streaming or a batch DataFrame with ``ts``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, by: list[str], value: str, every: str, late: str = "10 minutes") -> DataFrame:
    """(window_start, *by, last): the last value of each poll; a stream forgets polls that are over by ``late``."""
    df = df.withWatermark("ts", late) if df.isStreaming else df
    return df.groupBy(F.window("ts", every).alias("_window"), *by).agg(F.max_by(value, "ts").alias("last")).select(F.col("_window.start").alias("window_start"), *by, "last")


def samples(df: DataFrame, by: list[str], value: str, every: str, late: str = "10 minutes") -> DataFrame:
    """(window_start, *by, n, mean, most) of tumbling windows; rows later than ``late`` don't count in a stream."""
    df = df.withWatermark("ts", late) if df.isStreaming else df
    out = df.groupBy(F.window("ts", every).alias("_window"), *by).agg(F.count(value).alias("n"), F.when(F.count(value) >= 2, F.round(F.avg(value), 4)).alias("mean"), F.max(value).alias("most"))
    return out.select(F.col("_window.start").alias("window_start"), *by, "n", "mean", "most")


def sessions(df: DataFrame, worker: str, silence: str, late: str = "10 minutes") -> DataFrame:
    """(worker, first, last, beats): a worker counts as lost once it was silent for ``silence``; then a session ends."""
    df = df.withWatermark("ts", late) if df.isStreaming else df
    out = df.groupBy(worker, F.session_window("ts", silence).alias("_window")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("beats"))
    return out.select(worker, "first", "last", "beats")


def once(df: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Results that arrive again are dropped."""
    return df.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def overdue(df: DataFrame, expected: str, elapsed: str) -> DataFrame:
    """``df`` with ``overdue``: longer than three times what was expected, and than 10 seconds."""
    return df.withColumn("overdue", F.col(elapsed) > F.greatest(3 * F.col(expected), F.lit(10.0)))
