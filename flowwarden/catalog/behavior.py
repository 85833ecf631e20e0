"""Queries: windows, behaviour and detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowwarden import schema as S
from flowwarden.catalog.registry import flag, i8, query, r6, stamp
from flowwarden.catalog.tables import FW_VOLUME_DUCK, fw, fw_volume, with_fw
from flowwarden.operators import behavior as B
from flowwarden.operators import blocklist as L
from flowwarden.operators import detect as D
from flowwarden.plans.detection import to_block_events

DAY = 86_400
SIZE, SLIDE = 3 * DAY, DAY
RISK = ", ".join(map(str, S.HIGH_RISK_PORTS))

AGGREGATES = f"""
  {i8('count(*)')} AS total_connections,
  {i8('count(DISTINCT dst_ip)')} AS unique_dst_ips,
  {i8('count(DISTINCT dst_port)')} AS unique_dst_ports,
  {r6("avg(CASE WHEN action = 'block' THEN 1.0 ELSE 0.0 END)")} AS block_ratio,
  {r6("avg(CASE WHEN action = 'pass' THEN 1.0 ELSE 0.0 END)")} AS pass_ratio,
  {r6('avg(src_port)')} AS avg_src_port, {r6('avg(dst_port)')} AS avg_dst_port,
  {r6('stddev_samp(dst_port)')} AS dst_port_diversity,
  {r6(f'avg(CASE WHEN dst_port IN ({RISK}) THEN 1.0 ELSE 0.0 END)')} AS high_risk_port_ratio,
  {r6("avg(CASE WHEN proto_name = 'tcp' THEN 1.0 ELSE 0.0 END)")} AS tcp_ratio,
  {r6("avg(CASE WHEN proto_name = 'udp' THEN 1.0 ELSE 0.0 END)")} AS udp_ratio,
  {r6("avg(CASE WHEN proto_name = 'icmp' THEN 1.0 ELSE 0.0 END)")} AS icmp_ratio,
  {r6('avg(length)')} AS avg_packet_length, {r6('stddev_samp(length)')} AS packet_length_std,
  {r6('avg(ttl)')} AS avg_ttl"""

WINDOWS = """win AS (SELECT fw.*, date_trunc('day', ts) - to_days(CAST(i AS INTEGER)) AS ws
  FROM fw CROSS JOIN range(3) r(i))"""
BEHAVIOR = f"""beh AS (SELECT ws, ws + INTERVAL 3 DAY AS we, src_ip, {AGGREGATES},
  {r6(f'count(*) / {float(SIZE)}')} AS connection_rate FROM win GROUP BY ws, src_ip)"""
KEYS = f"{stamp('ws')} AS window_start, {stamp('we')} AS window_end, src_ip"
COLUMNS = """total_connections, unique_dst_ips, unique_dst_ports, block_ratio, pass_ratio, avg_src_port,
  avg_dst_port, dst_port_diversity, high_risk_port_ratio, tcp_ratio, udp_ratio, icmp_ratio,
  avg_packet_length, packet_length_std, avg_ttl, connection_rate"""


def with_behavior(body: str, more: str = "") -> str:
    return with_fw(f", {WINDOWS}, {BEHAVIOR}{more} {body}")


def behavior(spark, sf):
    return B.ip_behavior(fw(spark, sf), "ts", SIZE, SLIDE)


@query("window_counts", with_fw(f""", {WINDOWS}
SELECT {stamp('ws')} AS window_start, {stamp('ws + INTERVAL 3 DAY')} AS window_end, src_ip,
  {i8('count(*)')} AS n FROM win GROUP BY ws, src_ip"""))
def window_counts(spark, sf):
    return B.window_counts(fw(spark, sf), "ts", SIZE, SLIDE)


@query("ip_behavior_windows", with_behavior(f"SELECT {KEYS}, {COLUMNS} FROM beh"))
def ip_behavior_windows(spark, sf):
    return behavior(spark, sf)


@query("ip_behavior_global", with_fw(f"""SELECT src_ip, {AGGREGATES},
  {r6(f'count(*) / {30.0 * DAY}')} AS connection_rate FROM fw GROUP BY src_ip"""))
def ip_behavior_global(spark, sf):
    return B.ip_behavior_global(fw(spark, sf), 30 * DAY, "ts")


VOLUME_WINDOWS = f"""WITH fw AS ({FW_VOLUME_DUCK}), win AS (
  SELECT fw.*, to_timestamp(CAST(floor(epoch(ts) / {30 * DAY}) AS BIGINT) * {30 * DAY} - i * {30 * DAY})
    AT TIME ZONE 'UTC' AS ws FROM fw CROSS JOIN range(3) r(i))"""


@query("ip_behavior_windows_volume", f"""{VOLUME_WINDOWS}
SELECT {stamp('ws')} AS window_start, {stamp('ws + INTERVAL 90 DAY')} AS window_end, src_ip, {AGGREGATES},
  {r6(f'count(*) / {90.0 * DAY}')} AS connection_rate FROM win GROUP BY ws, src_ip""")
def ip_behavior_windows_volume(spark, sf):
    return B.ip_behavior(fw_volume(spark, sf), "ts", 90 * DAY, 30 * DAY)


# A block list derived from the data: the sources of some of the events.
BLOCKED_SQL = "blocked AS (SELECT DISTINCT src_ip AS ip FROM fw WHERE event_id % 211 = 0)"


def blocked(spark, sf):
    return fw(spark, sf).filter("event_id % 211 = 0").select(F.col("src_ip").alias("ip")).distinct()


@query("eligible_ips", with_behavior(f"""SELECT {KEYS}, {COLUMNS} FROM beh
WHERE total_connections >= 5 AND src_ip NOT IN (SELECT ip FROM blocked)""", f", {BLOCKED_SQL}"))
def eligible_ips(spark, sf):
    return B.eligible(behavior(spark, sf), blocked(spark, sf))


@query("behavior_flags", with_behavior(f"""SELECT {KEYS}, {COLUMNS},
  array_to_string(list_sort(list_filter([
    CASE WHEN unique_dst_ports > 50 THEN 'PORT SCANNING' END,
    CASE WHEN connection_rate > 5 THEN 'BURST TRAFFIC' END,
    CASE WHEN block_ratio > 0.7 THEN 'HIGH DROP RATE' END,
    CASE WHEN high_risk_port_ratio > 0.5 THEN 'TARGETING HIGH-RISK SERVICES' END],
    lambda x: x IS NOT NULL)), ',') AS behaviors FROM beh"""))
def behavior_flags(spark, sf):
    return B.behavior_flags(behavior(spark, sf))


@query("representative_row", with_behavior(f"""
SELECT {stamp('b.ws')} AS window_start, {stamp('b.we')} AS window_end, b.src_ip,
  CAST(trunc(m.a) AS BIGINT) AS src_port, CAST(trunc(m.b) AS BIGINT) AS dst_port,
  CAST(trunc(m.c) AS BIGINT) AS length, CAST(trunc(m.d) AS BIGINT) AS data_length,
  CAST(trunc(m.e) AS BIGINT) AS ttl,
  CASE WHEN m.f > 0.5 THEN 'block' ELSE 'pass' END AS action,
  f.proto_name, f.dir, f.reason, coalesce(f.tcp_flags, '') AS tcp_flags,
  {i8('coalesce(f.tcp_window, 0)')} AS tcp_window
FROM beh b
JOIN (SELECT ws, src_ip, avg(src_port) a, avg(dst_port) b, avg(length) c, avg(data_length) d, avg(ttl) e,
        avg(CASE WHEN action = 'block' THEN 1.0 ELSE 0.0 END) f FROM win GROUP BY ws, src_ip) m
  ON m.ws = b.ws AND m.src_ip = b.src_ip
JOIN (SELECT *, row_number() OVER (PARTITION BY ws, src_ip ORDER BY ts, event_id) AS rn FROM win) f
  ON f.ws = b.ws AND f.src_ip = b.src_ip AND f.rn = 1"""))
def representative_row(spark, sf):
    b = B.ip_behavior(fw(spark, sf), "ts", SIZE, SLIDE, first_row=True, order=["ts", "event_id"])
    return B.representative_row(b, "ts").select(
        "window_start", "window_end", "src_ip", "src_port", "dst_port", "length", "data_length",
        "ttl", "action", "proto_name", "dir", "reason", "tcp_flags", "tcp_window")


# A score per window that spans every severity band.
SCORE_SQL = "((total_connections * 37 + unique_dst_ports * 101 + unique_dst_ips * 11) % 1000) / 1000.0 - 0.7"
SEVERITY_SQL = """CASE WHEN anomaly_score < -0.5 THEN 'CRITICAL' WHEN anomaly_score < -0.3 THEN 'HIGH'
  WHEN anomaly_score < -0.1 THEN 'MEDIUM' ELSE 'LOW' END"""
SCORED_SQL = f""", scored AS (SELECT *, anomaly_score < 0 AS is_anomaly, {SEVERITY_SQL} AS severity FROM (
  SELECT *, CAST({SCORE_SQL} AS DOUBLE) AS anomaly_score FROM beh WHERE total_connections >= 5) q),
 found AS (SELECT src_ip AS ip, is_anomaly, anomaly_score, severity, total_connections AS logs_count,
  we AS "timestamp" FROM scored WHERE is_anomaly)"""


def scored(spark, sf):
    rows = B.eligible(behavior(spark, sf)).withColumn(
        "anomaly_score", F.expr(f"CAST({SCORE_SQL} AS DOUBLE)"))
    return D.add_severity(rows.withColumn("is_anomaly", F.col("anomaly_score") < 0))


@query("severity_bands", with_behavior(f"""SELECT {KEYS}, {r6('anomaly_score')} AS anomaly_score, severity
FROM scored""", SCORED_SQL))
def severity_bands(spark, sf):
    return scored(spark, sf).select("window_start", "window_end", "src_ip", "anomaly_score", "severity")


@query("severity_bands_alt", with_behavior(f"""SELECT {KEYS}, {r6('anomaly_score')} AS anomaly_score,
  CASE WHEN anomaly_score < -0.4 THEN 'CRITICAL' WHEN anomaly_score < -0.3 THEN 'HIGH'
    WHEN anomaly_score < -0.2 THEN 'MEDIUM' WHEN anomaly_score < -0.1 THEN 'LOW' ELSE 'INFO' END AS severity
FROM scored""", SCORED_SQL))
def severity_bands_alt(spark, sf):
    return D.add_severity(scored(spark, sf), bands=S.ALT_SEVERITY_BANDS, floor=S.ALT_SEVERITY_FLOOR).select(
        "window_start", "window_end", "src_ip", "anomaly_score", "severity")


FOUND_COLUMNS = f"""ip, {flag('is_anomaly')} AS is_anomaly, {r6('anomaly_score')} AS anomaly_score, severity,
  logs_count, {stamp('"timestamp"')} AS "timestamp\""""


@query("latest_detection", with_behavior(f"""SELECT {FOUND_COLUMNS} FROM (
  SELECT *, row_number() OVER (PARTITION BY ip ORDER BY "timestamp" DESC, anomaly_score) AS rn FROM found) q
WHERE rn = 1""", SCORED_SQL))
def latest_detection(spark, sf):
    return D.latest_detection(D.detections(scored(spark, sf)))


REASON_SQL = "printf('Anomaly detected (Score: %.3f, Severity: %s)', anomaly_score, severity) AS reason"


@query("block_decisions", with_behavior(f"""SELECT {FOUND_COLUMNS}, {REASON_SQL} FROM found
WHERE severity IN ('CRITICAL', 'HIGH', 'MEDIUM')""", SCORED_SQL))
def block_decisions(spark, sf):
    return D.block_decisions(D.detections(scored(spark, sf)))


@query("block_min_severity", with_behavior(f"""SELECT {FOUND_COLUMNS}, {REASON_SQL} FROM found
WHERE severity IN ('CRITICAL', 'HIGH')""", SCORED_SQL))
def block_min_severity(spark, sf):
    return D.block_decisions(D.detections(scored(spark, sf)), min_severity="HIGH")


@query("block_candidates_public", with_behavior(f"""SELECT {FOUND_COLUMNS}, {REASON_SQL} FROM found
WHERE severity IN ('CRITICAL', 'HIGH', 'MEDIUM')
  AND NOT regexp_matches(ip, '{S.PRIVATE_OR_LOOPBACK_IP}')""", SCORED_SQL))
def block_candidates_public(spark, sf):
    return D.block_decisions(D.detections(scored(spark, sf)), protect_private=True)


FLAGGED_SQL = SCORED_SQL + """, flagged AS (SELECT *, is_anomaly AND severity IN ('CRITICAL', 'HIGH') AS blocked
  FROM scored), firsts AS (SELECT src_ip AS ip, min(we) AS first_block FROM flagged WHERE blocked GROUP BY src_ip)"""


def flagged(spark, sf):
    return scored(spark, sf).withColumn(
        "blocked", F.col("is_anomaly") & F.col("severity").isin("CRITICAL", "HIGH"))


@query("suppress_after_block", with_behavior(f"""SELECT {KEYS}, {r6('anomaly_score')} AS anomaly_score,
  severity, {flag('blocked')} AS blocked
FROM flagged LEFT JOIN firsts ON src_ip = ip WHERE first_block IS NULL OR we <= first_block""", FLAGGED_SQL))
def suppress_after_block(spark, sf):
    return B.suppress_after_block(flagged(spark, sf)).select(
        "window_start", "window_end", "src_ip", "anomaly_score", "severity", "blocked")


SUMMARY_SQL = f""", judged AS (SELECT *, total_connections >= 5 AS analysed,
    CAST({SCORE_SQL} AS DOUBLE) AS anomaly_score, CAST({SCORE_SQL} AS DOUBLE) < 0 AS is_anomaly FROM beh),
 summary AS (SELECT ws, we, CAST(sum(total_connections) AS BIGINT) AS total_logs, count(*) AS total_ips,
  count(*) FILTER (total_connections >= 5) AS eligible_ips, count(*) FILTER (analysed) AS analysed_ips,
  count(*) FILTER (analysed AND NOT is_anomaly) AS normal_ips,
  count(*) FILTER (analysed AND is_anomaly) AS anomalous_ips,
  round(avg(anomaly_score) FILTER (analysed), 6) AS avg_score,
  round(min(anomaly_score) FILTER (analysed), 6) AS min_score FROM judged GROUP BY ws, we)"""


def summary(spark, sf):
    judged = behavior(spark, sf).withColumn("anomaly_score", F.expr(f"CAST({SCORE_SQL} AS DOUBLE)"))
    return B.window_summary(judged.withColumns({
        "analysed": F.col("total_connections") >= 5, "is_anomaly": F.col("anomaly_score") < 0}))


@query("window_summary", with_behavior(f"""SELECT {stamp('ws')} AS window_start, {stamp('we')} AS window_end,
  total_logs, total_ips, eligible_ips, analysed_ips, normal_ips, anomalous_ips, avg_score, min_score
FROM summary""", SUMMARY_SQL))
def window_summary(spark, sf):
    return summary(spark, sf)


@query("running_totals", with_behavior(f"""SELECT {stamp('we')} AS window_end,
  CAST(sum(total_logs) OVER w AS BIGINT) AS logs_so_far, CAST(sum(analysed_ips) OVER w AS BIGINT) AS analysed_so_far,
  CAST(sum(normal_ips) OVER w AS BIGINT) AS normal_so_far,
  CAST(sum(anomalous_ips) OVER w AS BIGINT) AS detections_so_far,
  CAST(sum(anomalous_ips // 2) OVER w AS BIGINT) AS blocks_so_far, total_ips,
  CAST(epoch(we) - epoch(min(we) OVER ()) AS BIGINT) AS uptime_seconds
FROM summary WINDOW w AS (ORDER BY we)""", SUMMARY_SQL))
def running_totals(spark, sf):
    rows = summary(spark, sf).withColumns({
        "new_logs": F.col("total_logs"), "blocked_ips": F.expr("anomalous_ips div 2")})
    return B.running_totals(rows).select(
        "window_end", "logs_so_far", "analysed_so_far", "normal_so_far", "detections_so_far",
        "blocks_so_far", "total_ips", "uptime_seconds")


# Detections at row level for the alert rules: the event's own time and a score.
ROW_SCORE = "-0.7 + (event_id % 1000) / 1000.0"
ALERT_SQL = f""", rows AS (SELECT src_ip AS ip, ts AS "timestamp", CAST({ROW_SCORE} AS DOUBLE) AS anomaly_score FROM fw),
 found AS (SELECT *, {SEVERITY_SQL} AS severity FROM rows)"""


def row_detections(spark, sf):
    rows = fw(spark, sf).select(F.col("src_ip").alias("ip"), F.col("ts").alias("timestamp"),
                                F.expr(f"CAST({ROW_SCORE} AS DOUBLE)").alias("anomaly_score"))
    return D.add_severity(rows)


@query("alert_feed", with_fw(f"""{ALERT_SQL} SELECT ip, {stamp('"timestamp"')} AS "timestamp",
  {r6('anomaly_score')} AS anomaly_score, severity, {stamp('m')} AS minute, {i8('rn')} AS place FROM (
  SELECT *, date_trunc('minute', "timestamp") AS m, row_number() OVER (
    PARTITION BY date_trunc('minute', "timestamp") ORDER BY anomaly_score, ip, "timestamp") AS rn
  FROM found WHERE severity IN ('CRITICAL', 'HIGH', 'MEDIUM')) q WHERE rn <= 10"""))
def alert_feed(spark, sf):
    return D.alert_feed(row_detections(spark, sf))


@query("severity_breakdown", with_fw(f"""{ALERT_SQL}
SELECT coalesce(severity, 'TOTAL') AS severity, {i8('count(*)')} AS n,
  {i8('count(*) FILTER (anomaly_score < 0)')} AS anomalies,
  {r6('count(*) FILTER (anomaly_score < 0) * 100.0 / count(*)')} AS anomaly_percent
FROM found GROUP BY ROLLUP (severity)"""))
def severity_breakdown(spark, sf):
    rows = row_detections(spark, sf).withColumn("is_anomaly", F.col("anomaly_score") < 0)
    return D.severity_breakdown(rows)


@query("ingest_latency", with_fw(f"""SELECT {i8('count(*)')} AS n,
  {r6('avg(event_id * 17 % 5000) / 1000.0')} AS avg_latency, {r6('min(event_id * 17 % 5000) / 1000.0')} AS min_latency,
  {r6('max(event_id * 17 % 5000) / 1000.0')} AS max_latency,
  {r6("count(*) / ((max(epoch_us(a)) - min(epoch_us(a))) / 1000000.0)")} AS rows_per_second
FROM (SELECT *, ts + to_milliseconds(event_id * 17 % 5000) AS a FROM fw) q"""))
def ingest_latency(spark, sf):
    late = F.timestamp_micros(F.unix_micros("ts") + (F.col("event_id") * 17 % 5000) * 1000)
    return D.ingest_latency(fw(spark, sf).withColumn("ingest_ts", late), "ts")


# The block table: decisions append block events, every third source is released later.
EVENTS_SQL = FLAGGED_SQL + f""", ev AS (
  SELECT ip, 'block' AS action, severity, {REASON_SQL}, anomaly_score AS score, "timestamp" AS event_at
    FROM found WHERE severity = 'CRITICAL'
  UNION ALL
  SELECT DISTINCT ip, 'unblock', NULL, NULL, NULL, TIMESTAMP '2024-01-20 00:00:00' FROM found
    WHERE severity = 'CRITICAL' AND logs_count % 3 = 0),
 cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ip
   ORDER BY event_at DESC, action DESC, severity DESC NULLS LAST, reason DESC NULLS LAST) AS rn FROM ev) q WHERE rn = 1 AND action = 'block'),
 want AS (SELECT * FROM (SELECT ip, severity, {REASON_SQL}, anomaly_score AS score, "timestamp" AS event_at,
   row_number() OVER (PARTITION BY ip ORDER BY "timestamp" DESC, severity DESC, {REASON_SQL.replace(' AS reason', '')} DESC) AS rn
   FROM found WHERE severity IN ('CRITICAL', 'HIGH', 'MEDIUM')) q WHERE rn = 1)"""


def block_table(spark, sf):
    found = D.detections(scored(spark, sf)).filter("severity = 'CRITICAL'")
    added = to_block_events(D.block_decisions(found))
    freed = found.filter("logs_count % 3 = 0").select("ip").distinct().select(
        "ip", F.lit("unblock").alias("action"), F.lit(None).cast("string").alias("severity"),
        F.lit(None).cast("string").alias("reason"), F.lit(None).cast("double").alias("score"),
        F.lit("2024-01-20 00:00:00").cast("timestamp").alias("event_at"))
    return added.unionByName(freed)


def block_requests(spark, sf):
    return to_block_events(D.block_decisions(D.detections(scored(spark, sf))))


@query("blocklist_list", with_behavior(f"""SELECT ip, severity, reason, {r6('score')} AS score,
  {stamp('event_at')} AS blocked_at FROM cur""", EVENTS_SQL))
def blocklist_list(spark, sf):
    return L.current_blocks(block_table(spark, sf))


@query("blocklist_count", with_behavior(f"SELECT {i8('count(*)')} AS blocked_ips FROM cur", EVENTS_SQL))
def blocklist_count(spark, sf):
    return L.block_count(block_table(spark, sf))


@query("blocklist_upsert", with_behavior(f"""SELECT w.ip, 'block' AS action, w.severity, w.reason,
  {r6('w.score')} AS score, {stamp('w.event_at')} AS event_at,
  CASE WHEN c.ip IS NULL THEN 'blocked' ELSE 'already blocked' END AS status
FROM want w LEFT JOIN cur c ON c.ip = w.ip""", EVENTS_SQL))
def blocklist_upsert(spark, sf):
    return L.block_status(block_table(spark, sf), block_requests(spark, sf))


@query("blocklist_new_events", with_behavior(f"""SELECT ip, 'block' AS action, severity, reason,
  {r6('score')} AS score, {stamp('event_at')} AS event_at FROM want WHERE ip NOT IN (SELECT ip FROM cur)""", EVENTS_SQL))
def blocklist_new_events(spark, sf):
    return L.block_events(block_table(spark, sf), block_requests(spark, sf))


@query("blocklist_remove", with_behavior(f"""SELECT ip, 'unblock' AS action,
  '2024-02-10 00:00:00.000000' AS event_at FROM cur
WHERE ip IN (SELECT src_ip FROM fw WHERE event_id % 211 = 0)""", EVENTS_SQL))
def blocklist_remove(spark, sf):
    asked = blocked(spark, sf).withColumn("event_at", F.lit("2024-02-10 00:00:00").cast("timestamp"))
    return L.unblock_events(block_table(spark, sf), asked).select("ip", "action", "event_at")
