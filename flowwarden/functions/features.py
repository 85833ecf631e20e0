"""The per-connection model features as column expressions.

Each function returns ``{feature name: column}``.  A missing input makes a flag
0, never null, so every flag goes through :func:`flag`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowwarden import schema as S


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def temporal(ts: Column) -> dict[str, Column]:
    hour = F.hour(ts)
    day = F.weekday(ts)  # Monday = 0
    turn = 2 * F.pi()
    return {
        "hour": hour,
        "day_of_week": day,
        "hour_sin": F.sin(turn * hour / 24),
        "hour_cos": F.cos(turn * hour / 24),
        "day_sin": F.sin(turn * day / 7),
        "day_cos": F.cos(turn * day / 7),
        "is_weekend": flag(day >= 5),
        "is_business_hour": flag(hour.between(8, 17)),
        "is_night": flag((hour >= 22) | (hour <= 6)),
        "is_peak_hour": flag(hour.isin(S.PEAK_HOURS)),
    }


def ports(src: Column, dst: Column) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for side, port in (("src", src), ("dst", dst)):
        out[f"{side}_is_wellknown"] = flag(port <= 1023)
        out[f"{side}_is_registered"] = flag((port > 1023) & (port <= 49151))
        out[f"{side}_is_dynamic"] = flag(port > 49151)
    hundred = F.lit(100)
    out["dst_is_high_risk"] = flag(dst.isin(S.HIGH_RISK_PORTS))
    out["port_diff"] = F.abs(dst - src)
    out["port_range_span"] = F.greatest(src, dst) - F.least(src, dst)
    out["is_sequential_port"] = flag(F.pmod(src, hundred) == 0).bitwiseOR(
        flag(F.pmod(dst, hundred) == 0)
    )
    out["dst_is_web_service"] = flag(dst.isin(S.WEB_PORTS))
    out["dst_is_db_service"] = flag(dst.isin(S.DATABASE_PORTS))
    return out


def protocol(proto: Column, action: Column, direction: Column) -> dict[str, Column]:
    out = {f"is_{p}": flag(proto == p) for p in ("tcp", "udp", "icmp")}
    for p in ("tcp", "udp", "icmp"):
        out[f"{p}_blocked"] = flag((proto == p) & (action == "block"))
    out["tcp_inbound"] = flag((proto == "tcp") & (direction == "in"))
    out["tcp_outbound"] = flag((proto == "tcp") & (direction == "out"))
    out["udp_inbound"] = flag((proto == "udp") & (direction == "in"))
    return out


def packet(length: Column, ttl: Column, data_length: Column) -> dict[str, Column]:
    return {
        "packet_size_tiny": flag(length <= 64),
        "packet_size_small": flag((length > 64) & (length <= 512)),
        "packet_size_medium": flag((length > 512) & (length <= 1024)),
        "packet_size_large": flag(length > 1024),
        "packet_size_norm": length / 1500,
        "ttl_is_linux": flag(ttl == 64),
        "ttl_is_windows": flag(ttl.isin(127, 128)),
        "ttl_is_suspicious": flag((ttl < 30) | (ttl > 200)),
        "ttl_normalized": ttl / 255,
        "data_ratio": F.try_divide(data_length, length + 1),
    }


def connection(action: Column, direction: Column, reason: Column) -> dict[str, Column]:
    blocked = action == "block"
    return {
        "is_blocked": flag(blocked),
        "is_passed": flag(action == "pass"),
        "is_inbound": flag(direction == "in"),
        "is_outbound": flag(direction == "out"),
        "inbound_blocked": flag((direction == "in") & blocked),
        "outbound_blocked": flag((direction == "out") & blocked),
        "reason_is_match": flag(reason == "match"),
    }


def transport(flags: Column, window: Column) -> dict[str, Column]:
    size = F.coalesce(window.try_cast("double"), F.lit(0.0))
    out = {f"tcp_flag_{c.lower()}": flag(flags.contains(c)) for c in "SAFRPU"}
    out["tcp_syn_only"] = flag(flags == "S")
    out["tcp_fin_only"] = flag(flags == "F")
    out["tcp_null_scan"] = flag(F.coalesce(flags, F.lit("")).isin("", "nan", "None"))
    out["tcp_xmas_scan"] = flag(
        flags.contains("F") & flags.contains("P") & flags.contains("U")
    )
    out["window_is_zero"] = flag(size == 0)
    out["window_is_max"] = flag(size >= 65535)
    return out
