"""From rows to detections: windows, scores, severities, block events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwarden import schema as S
from flowwarden.operators import behavior as B
from flowwarden.operators import detect as D
from flowwarden.plans.training import Model, score

KEYS = ["window_start", "window_end", "src_ip", "total_connections"]


def score_windows(df: DataFrame, model: Model, ts: str = "@timestamp",
                  size: int = S.WINDOW_SECONDS, slide: int = S.SLIDE_SECONDS,
                  min_rows: int = S.MIN_ROWS_PER_IP, blocked: DataFrame | None = None,
                  order: list[str] | None = None) -> DataFrame:
    """Score of every eligible source and window, all at once."""
    behavior = B.ip_behavior(df, ts, size, slide, first_row=True, order=order)
    rows = B.representative_row(B.eligible(behavior, blocked, min_rows), "@timestamp")
    return score(rows, model, KEYS, "@timestamp")


def to_block_events(decisions: DataFrame) -> DataFrame:
    """Block decisions as events of the block table."""
    return decisions.select(
        "ip", F.lit("block").alias("action"), "severity", "reason",
        F.col("anomaly_score").alias("score"), F.col("timestamp").alias("event_at"))


def detect(scored: DataFrame, **rules) -> tuple[DataFrame, DataFrame]:
    """Detections of the scored windows and the blocks they lead to."""
    found = D.detections(scored)
    return found, D.block_decisions(found, **rules)
