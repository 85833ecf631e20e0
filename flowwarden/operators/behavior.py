"""What each source address did in each sliding window.

Sums are taken per slide interval first and only those are repeated for the
windows they fall in, so the repetition comes after the map-side combine.  All
of them add up exactly (integers), so the result equals aggregating the rows.
Destinations and ports are counted from the set of intervals in which a source
reached each of them, which spreads a source holding a large share of the rows
over its destinations; each counts once in every window that the set touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowwarden import schema as S
from flowwarden.functions import detect as D
from flowwarden.plans.ranking import running_sums

WIDE = "decimal(20,0)"
WIDEST = "decimal(28,0)"
MEASURED = ["src_port", "dst_port", "length", "ttl", "data_length"]
SPREAD = ["dst_port", "length"]
FIRST_ROW = ["proto_name", "dir", "reason", "tcp_flags", "tcp_window"]


def event_time(df: DataFrame, ts: str = "@timestamp") -> DataFrame:
    """Rows of a known source; a row without a time counts as arriving now."""
    stamp = F.col(ts).cast("timestamp")
    return df.filter(F.col("src_ip").isNotNull()).withColumn(
        ts, F.coalesce(stamp, F.current_timestamp())
    )


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def partial_sums(first_row: bool, order: list[str]) -> list[Column]:
    c = F.col
    sums = [F.count("*").alias("n")]
    sums += [_count(c("action") == a).alias(f"n_{a}") for a in ("block", "pass")]
    sums += [_count(c("proto_name") == p).alias(f"n_{p}") for p in ("tcp", "udp", "icmp")]
    sums.append(_count(c("dst_port").isin(S.HIGH_RISK_PORTS)).alias("n_risk"))
    for name in MEASURED:
        value = c(name).cast("bigint")
        sums += [F.sum(value).alias(f"s_{name}"), F.count(value).alias(f"c_{name}")]
        if name in SPREAD:
            sums.append(F.sum((value * value).cast(WIDE)).alias(f"q_{name}"))
    if first_row:
        sums.append(F.min_by(F.struct(*FIRST_ROW), F.struct(*order)).alias("first_row"))
        sums.append(F.min(F.struct(*order)).alias("first_at"))
    return sums


def _sample_std(n: Column, total: Column, squares: Column) -> Column:
    """Sample deviation from exact integer sums; null below two values."""
    spread = (n * squares - total * total).cast("double")
    return F.when(n > 1, F.sqrt(spread / (n.cast("double") * (n - 1).cast("double"))))


def merged_sums(seconds: float, first_row: bool) -> list[Column]:
    n = F.sum("n")

    def ratio(name: str) -> Column:
        return F.sum(f"n_{name}") / n

    def mean(name: str) -> Column:
        return F.try_divide(F.sum(f"s_{name}").cast("double"), F.sum(f"c_{name}"))

    def deviation(name: str) -> Column:
        return _sample_std(*[F.sum(F.col(f"{k}_{name}").cast(WIDE if k in "cs" else WIDEST)) for k in "csq"])

    out = [
        n.alias("total_connections"),
        ratio("block").alias("block_ratio"), ratio("pass").alias("pass_ratio"),
        mean("src_port").alias("avg_src_port"), mean("dst_port").alias("avg_dst_port"),
        deviation("dst_port").alias("dst_port_diversity"),
        ratio("risk").alias("high_risk_port_ratio"),
        ratio("tcp").alias("tcp_ratio"), ratio("udp").alias("udp_ratio"),
        ratio("icmp").alias("icmp_ratio"),
        mean("length").alias("avg_packet_length"), deviation("length").alias("packet_length_std"),
        mean("ttl").alias("avg_ttl"),
        (n / F.lit(float(seconds))).alias("connection_rate"),
    ]
    if first_row:
        out += [
            mean("data_length").alias("avg_data_length"),
            F.min_by("first_row", "first_at").alias("first_row"),
        ]
    return out


def _in_windows(panes: DataFrame, size: int, slide: int) -> DataFrame:
    """Each interval once for every window it belongs to."""
    back = F.explode(F.sequence(F.lit(0), F.lit(size // slide - 1)))
    step = F.make_dt_interval(secs=F.col("back") * F.lit(slide).cast("decimal(18,6)"))
    return panes.withColumn("back", back).withColumn(
        "window_start", F.col("pane") - step).drop("pane", "back")


def _reached(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Each row twice: once with its destination, once with its port."""
    address, port = [f.dataType for f in rows.select("dst_ip", "dst_port").schema]
    kinds = [F.struct("dst_ip", F.lit(None).cast(port).alias("dst_port")), F.struct(F.lit(None).cast(address).alias("dst_ip"), "dst_port")]
    return rows.select(*keep, F.explode(F.array(*kinds)).alias("_one")).select(*keep, "_one.*")


def _reached_in_windows(rows: DataFrame, size: int, slide: int) -> DataFrame:
    """Each destination and each port of a source once for every window in which it was reached."""
    panes = _reached(rows, ["pane", "src_ip"]).groupBy("src_ip", "dst_ip", "dst_port").agg(F.collect_set("pane").alias("panes"))
    back = F.sequence(F.lit(0), F.lit(size // slide - 1))
    starts = F.transform("panes", lambda p: F.transform(
        back, lambda i: p - F.make_dt_interval(secs=i * F.lit(slide).cast("decimal(18,6)"))))
    return panes.select("src_ip", "dst_ip", "dst_port", F.explode(F.array_distinct(F.flatten(starts))).alias("window_start"))


def _assemble(sums: DataFrame, reached: DataFrame, keys: list[str], seconds: float,
              first_row: bool) -> DataFrame:
    """Both parts end up partitioned by the keys, so joining them moves nothing."""
    totals = sums.groupBy(*keys).agg(*merged_sums(seconds, first_row))
    distinct = reached.groupBy(*keys).agg(
        F.count("dst_ip").alias("unique_dst_ips"),
        F.count("dst_port").alias("unique_dst_ports"),
    )
    return totals.join(distinct, keys)


def ip_behavior(df: DataFrame, ts: str = "@timestamp", size: int = S.WINDOW_SECONDS,
                slide: int = S.SLIDE_SECONDS, first_row: bool = False,
                order: list[str] | None = None) -> DataFrame:
    """The behaviour columns per source and window of ``size`` seconds every ``slide``.

    ``size`` must be a multiple of ``slide``.  ``first_row`` also keeps the
    earliest row's text fields, ties broken by the ``order`` columns.
    """
    if size % slide:
        raise ValueError("the window size must be a multiple of the slide")
    rows = event_time(df, ts).withColumn("pane", F.window(F.col(ts), f"{slide} seconds")["start"])
    sums = rows.groupBy("pane", "src_ip").agg(*partial_sums(first_row, order or [ts]))
    joined = _assemble(_in_windows(sums, size, slide), _reached_in_windows(rows, size, slide),
                       ["window_start", "src_ip"], size, first_row)
    return joined.withColumn("window_end", F.col("window_start") + F.make_dt_interval(
        secs=F.lit(size).cast("decimal(18,6)")))


def ip_behavior_global(df: DataFrame, seconds: float, ts: str = "@timestamp") -> DataFrame:
    """The same columns per source over the whole table."""
    rows = event_time(df, ts)
    sums = rows.groupBy("src_ip").agg(*partial_sums(False, []))
    return _assemble(sums, _reached(rows, ["src_ip"]).distinct(), ["src_ip"], seconds, False)


def window_counts(df: DataFrame, ts: str = "@timestamp", size: int = S.WINDOW_SECONDS,
                  slide: int = S.SLIDE_SECONDS) -> DataFrame:
    rows = event_time(df, ts)
    grouped = rows.groupBy(F.window(F.col(ts), f"{size} seconds", f"{slide} seconds"), "src_ip")
    return grouped.agg(F.count("*").alias("n")).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        "src_ip", "n",
    )


def eligible(behavior: DataFrame, blocked: DataFrame | None = None,
             min_rows: int = S.MIN_ROWS_PER_IP) -> DataFrame:
    """Windows with enough rows whose source is not on the block list (column ``ip``)."""
    enough = behavior.filter(F.col("total_connections") >= min_rows)
    if blocked is None:
        return enough
    return enough.join(blocked.select(F.col("ip").alias("src_ip")), "src_ip", "left_anti")


def representative_row(behavior: DataFrame, ts: str = "@timestamp") -> DataFrame:
    """One connection-shaped row per window from ``ip_behavior(first_row=True)``.

    Numbers are the truncated means, text comes from the earliest row, and the
    window's end stands for the time.
    """
    c = F.col

    def whole(name: str) -> Column:
        return c(name).cast("int")

    return behavior.select(
        "*",
        c("window_end").alias(ts),
        whole("avg_src_port").alias("src_port"),
        whole("avg_dst_port").alias("dst_port"),
        F.coalesce(c("first_row.proto_name"), F.lit("tcp")).alias("proto_name"),
        F.when(c("block_ratio") > 0.5, "block").otherwise("pass").alias("action"),
        F.coalesce(c("first_row.dir"), F.lit("in")).alias("dir"),
        whole("avg_packet_length").alias("length"),
        whole("avg_data_length").alias("data_length"),
        whole("avg_ttl").alias("ttl"),
        F.coalesce(c("first_row.reason"), F.lit("match")).alias("reason"),
        F.coalesce(c("first_row.tcp_flags"), F.lit("")).alias("tcp_flags"),
        F.coalesce(c("first_row.tcp_window"), F.lit(0)).alias("tcp_window"),
    ).drop("first_row", "avg_data_length")


def behavior_flags(behavior: DataFrame) -> DataFrame:
    return behavior.withColumn("behaviors", D.behaviour_labels(
        F.col("unique_dst_ports"), F.col("connection_rate"), F.col("block_ratio"),
        F.col("high_risk_port_ratio")))


def suppress_after_block(detections: DataFrame) -> DataFrame:
    """Leave out a source's windows after the first one that got it blocked.

    ``detections`` has ``src_ip, window_end, blocked``.
    """
    first = detections.filter("blocked").groupBy(F.col("src_ip").alias("_ip")).agg(
        F.min("window_end").alias("_first"))
    joined = detections.join(first, F.col("src_ip") == F.col("_ip"), "left")
    return joined.filter("_first IS NULL OR window_end <= _first").drop("_ip", "_first")


def window_summary(scored: DataFrame, min_rows: int = S.MIN_ROWS_PER_IP) -> DataFrame:
    """Per window: rows, sources, eligible and analysed ones, outcome and scores.

    ``scored`` has one row per window and source with ``total_connections,
    analysed, is_anomaly, anomaly_score``.
    """
    on = F.col("analysed")
    return scored.groupBy("window_start", "window_end").agg(
        F.sum("total_connections").alias("total_logs"),
        F.count("*").alias("total_ips"),
        _count(F.col("total_connections") >= min_rows).alias("eligible_ips"),
        _count(on).alias("analysed_ips"),
        _count(on & ~F.col("is_anomaly")).alias("normal_ips"),
        _count(on & F.col("is_anomaly")).alias("anomalous_ips"),
        F.avg(F.when(on, F.col("anomaly_score"))).alias("avg_score"),
        F.min(F.when(on, F.col("anomaly_score"))).alias("min_score"),
    )


def running_totals(summary: DataFrame) -> DataFrame:
    """Totals so far per window end, from one row per window."""
    timed = summary.withColumn("_at", F.unix_micros("window_end"))
    totals = running_sums(timed, "_at", {
        "logs_so_far": "new_logs", "analysed_so_far": "analysed_ips",
        "normal_so_far": "normal_ips", "detections_so_far": "anomalous_ips",
        "blocks_so_far": "blocked_ips",
    })
    start = summary.agg(F.min(F.unix_seconds("window_end"))).scalar()
    return totals.withColumn("uptime_seconds", F.unix_seconds("window_end") - start).drop("_at")
