"""Scores to severities, detections, block decisions and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowwarden import schema as S
from flowwarden.functions import detect as D


def add_severity(df: DataFrame, score: str = "anomaly_score", bands=S.SEVERITY_BANDS,
                 floor: str = S.SEVERITY_FLOOR) -> DataFrame:
    return df.withColumn("severity", D.severity(F.col(score), bands, floor))


def detections(scored: DataFrame) -> DataFrame:
    """The detection record of every anomalous window."""
    return add_severity(scored.filter("is_anomaly")).select(
        F.col("src_ip").alias("ip"), "is_anomaly", "anomaly_score", "severity",
        F.col("total_connections").alias("logs_count"), F.col("window_end").alias("timestamp"),
    )


def latest_detection(found: DataFrame) -> DataFrame:
    """The newest detection per address; the lower score wins a tie."""
    fields = [c for c in found.columns if c != "ip"]
    newest = found.groupBy("ip").agg(F.max_by(
        F.struct(*fields), F.struct(F.col("timestamp"), -F.col("anomaly_score"))
    ).alias("d"))
    return newest.select("ip", "d.*")


def block_decisions(found: DataFrame, severities=S.BLOCK_SEVERITIES, auto_block: bool = True,
                    protect_private: bool = False, min_severity: str | None = None) -> DataFrame:
    """The detections that lead to a block, with a reason text.

    Listed severities, or every level from ``min_severity`` up.  Private and
    loopback addresses are spared only with ``protect_private``.
    """
    if not auto_block:
        chosen = found.filter(F.lit(False))
    elif min_severity is not None:
        lowest = S.SEVERITY_ORDER.index(min_severity) + 1
        chosen = found.filter(D.severity_rank(F.col("severity")) >= lowest)
    else:
        chosen = found.filter(F.col("severity").isin(*severities))
    if protect_private:
        chosen = chosen.filter(~F.col("ip").rlike(S.PRIVATE_OR_LOOPBACK_IP))
    return chosen.withColumn("reason", D.block_reason(F.col("anomaly_score"), F.col("severity")))


def alert_feed(found: DataFrame, severities=S.ALERT_SEVERITIES,
               per_minute: int = S.ALERTS_PER_MINUTE) -> DataFrame:
    """At most ``per_minute`` alerts a minute, worst scores first.

    The rank filter is applied before the shuffle too, so a minute full of
    detections sends only its best rows on.
    """
    minute = F.date_trunc("minute", "timestamp")
    order = W.partitionBy("minute").orderBy("anomaly_score", "ip", "timestamp")
    return (
        found.filter(F.col("severity").isin(*severities)).withColumn("minute", minute)
        .withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_minute)
    )


def severity_breakdown(scored: DataFrame) -> DataFrame:
    """Count and share of anomalies per severity, with a total row."""
    rows = scored.rollup("severity").agg(
        F.count("*").alias("n"),
        F.count(F.when(F.col("is_anomaly"), 1)).alias("anomalies"),
        F.grouping("severity").alias("is_total"),
    )
    return rows.select(
        F.when(F.col("is_total") == 1, "TOTAL").otherwise(F.col("severity")).alias("severity"),
        "n", "anomalies",
        (F.col("anomalies") * F.lit(100).cast("double") / F.col("n")).alias("anomaly_percent"),
    )


def ingest_latency(df: DataFrame, ts: str = "@timestamp", arrived: str = "ingest_ts") -> DataFrame:
    """Delay between event and arrival in seconds, and rows per second of arrival."""
    delay = (F.unix_micros(arrived) - F.unix_micros(ts)) / F.lit(1e6)
    span = (F.max(F.unix_micros(arrived)) - F.min(F.unix_micros(arrived))) / F.lit(1e6)
    return df.agg(
        F.count("*").alias("n"), F.avg(delay).alias("avg_latency"),
        F.min(delay).alias("min_latency"), F.max(delay).alias("max_latency"),
        F.try_divide(F.count("*").cast("double"), span).alias("rows_per_second"),
    )
