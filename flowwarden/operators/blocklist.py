"""The block list as an append-only table of block and unblock events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DETAILS = ["severity", "reason", "score"]


def current_blocks(events: DataFrame) -> DataFrame:
    """Addresses whose newest event is a block; an unblock wins a tie."""
    cleaned = events.withColumn("ip", F.trim("ip")).filter(F.col("ip") != "")
    newest = cleaned.groupBy("ip").agg(
        F.max(F.struct("event_at", "action", *DETAILS)).alias("e"))
    return newest.filter("e.action = 'block'").select(
        "ip", *[F.col(f"e.{c}").alias(c) for c in DETAILS], F.col("e.event_at").alias("blocked_at"))


def _requests(wanted: DataFrame) -> DataFrame:
    return wanted.withColumn("ip", F.trim("ip")).filter(F.col("ip") != "").groupBy("ip").agg(
        F.max(F.struct("event_at", *DETAILS)).alias("e"))


def block_status(events: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row per requested address: the event to append, and whether it is new."""
    newest = _requests(wanted)
    listed = current_blocks(events).select("ip", F.lit(True).alias("known"))
    return newest.join(listed, "ip", "left").select(
        "ip", F.lit("block").alias("action"), *[F.col(f"e.{c}").alias(c) for c in DETAILS],
        F.col("e.event_at").alias("event_at"),
        F.when(F.col("known"), "already blocked").otherwise("blocked").alias("status"),
    )


def block_events(events: DataFrame, wanted: DataFrame) -> DataFrame:
    """The block events to append: requested addresses that are not blocked yet."""
    fresh = _requests(wanted).join(current_blocks(events).select("ip"), "ip", "left_anti")
    return fresh.select("ip", F.lit("block").alias("action"),
                        *[F.col(f"e.{c}").alias(c) for c in DETAILS], F.col("e.event_at").alias("event_at"))


def unblock_events(events: DataFrame, addresses: DataFrame) -> DataFrame:
    """The unblock events to append: requested addresses (``ip, event_at``) that are blocked."""
    asked = addresses.groupBy(F.trim("ip").alias("ip")).agg(F.max("event_at").alias("event_at"))
    return asked.join(current_blocks(events).select("ip"), "ip", "left_semi").select(
        "ip", F.lit("unblock").alias("action"),
        F.lit(None).cast("string").alias("severity"), F.lit(None).cast("string").alias("reason"),
        F.lit(None).cast("double").alias("score"), "event_at",
    )


def append_events(new: DataFrame, path: str) -> None:
    """Append only; the table being read is never rewritten."""
    new.write.mode("append").parquet(path)


def block_count(events: DataFrame) -> DataFrame:
    return current_blocks(events).agg(F.count("*").alias("blocked_ips"))


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)
