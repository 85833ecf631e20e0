"""Batch writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_daily(df: DataFrame, path: str, ts: str = "@timestamp", mode: str = "append") -> None:
    """One folder per event day.

    Rows are gathered by day first, so a day is few files; a busy day is still split over tasks.
    """
    df.withColumn("event_date", F.to_date(ts)).hint("rebalance", "event_date").write.mode(mode).partitionBy("event_date").parquet(path)


def write_parsed(accepted: DataFrame, rejected: DataFrame, path: str, error_path: str,
                 ts: str = "@timestamp") -> None:
    """Accepted rows by event day, rejected lines aside by arrival day."""
    write_daily(accepted, path, ts)
    rejected.withColumn("event_date", F.current_date()).write.mode("append").partitionBy(
        "event_date").parquet(error_path)


def write_clean(df: DataFrame, path: str) -> None:
    """Parquet or CSV by the suffix of the path."""
    if path.endswith(".parquet"):
        df.write.mode("overwrite").parquet(path)
    elif path.endswith(".csv"):
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        raise ValueError(f"only .parquet and .csv are supported: {path}")


def append_ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
