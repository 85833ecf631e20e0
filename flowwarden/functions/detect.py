"""Column rules that turn scores and behaviour into labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowwarden import schema as S


def severity(score: Column, bands=S.SEVERITY_BANDS, floor: str = S.SEVERITY_FLOOR) -> Column:
    """Lowest scores are worst; a missing score has no severity."""
    rule = F.when(score.isNull(), F.lit(None).cast("string"))
    for name, below in bands:
        rule = rule.when(score < below, name)
    return rule.otherwise(floor)


def severity_rank(name: Column, order=S.SEVERITY_ORDER) -> Column:
    """Position in the ordered levels; 0 for an unknown level."""
    return F.array_position(F.array(*[F.lit(s) for s in order]), name)


def behaviour_labels(ports: Column, rate: Column, block_ratio: Column, risk_ratio: Column,
                     many_ports: int = S.MANY_PORTS, burst_rate: float = S.BURST_RATE,
                     high_drop: float = S.HIGH_DROP_RATIO,
                     high_risk: float = S.HIGH_RISK_RATIO) -> Column:
    return F.array_compact(F.array(
        F.when(ports > many_ports, "PORT SCANNING"),
        F.when(rate > burst_rate, "BURST TRAFFIC"),
        F.when(block_ratio > high_drop, "HIGH DROP RATE"),
        F.when(risk_ratio > high_risk, "TARGETING HIGH-RISK SERVICES"),
    ))


def block_reason(score: Column, level: Column) -> Column:
    return F.format_string("Anomaly detected (Score: %.3f, Severity: %s)", score, level)
