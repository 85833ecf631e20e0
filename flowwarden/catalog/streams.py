"""Queries: long-running streams, stopped and started again on the way."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from flowwarden.catalog.behavior import (
    AGGREGATES, COLUMNS, EVENTS_SQL, FLAGGED_SQL, KEYS, SCORE_SQL, SIZE, SLIDE, SUMMARY_SQL, behavior, block_table, scored, with_behavior,
)
from flowwarden.catalog.registry import flag, i8, query, r6, stamp
from flowwarden.catalog.tables import fw, load, with_fw
from flowwarden.operators import blocklist as L
from flowwarden.plans.storage import materialize, new_path
from flowwarden.sources.keyset import KeysetSource
from flowwarden.streaming import jobs as J
from flowwarden.streaming.blocklog import BlockLog
from flowwarden.streaming.counters import RunningCounters, Totals, observe_fetches, observe_windows
from flowwarden.streaming.latest import latest_by_source, write_latest


# ---- the block log in snapshots and changes ----
@query("blocklist_compacted", with_behavior(f"""SELECT ip, severity, reason, {r6('score')} AS score,
  {stamp('event_at')} AS blocked_at FROM cur""", EVENTS_SQL))
def blocklist_compacted(spark, sf):
    """Events dealt to twelve batches of two streams, merged every three batches."""
    events = materialize(block_table(spark, sf), "events")
    log, origins = BlockLog(spark, new_path(spark, "block-log")), [str(uuid.uuid4()) for _ in range(2)]
    for k in range(12):
        log.write_batch(events.filter(F.pmod(F.xxhash64("ip", "event_at", "action"), F.lit(12)) == k), origins[k % 2], k)
        log.compact(3)
    return L.current_blocks(log.events())


# ---- a table read on from the last (time, id), hours as times so that many rows tie ----
HOURLY_SQL = """SELECT event_id, date_trunc('hour', ts) AS ts, src_ip, dst_port FROM {fw}"""
CUT_SQL = "ts < TIMESTAMP '2024-01-16 00:00:00' OR (ts = TIMESTAMP '2024-01-16 00:00:00' AND event_id % 2 = 0)"


@query("stream_keyset", with_fw(f""", hourly AS ({HOURLY_SQL.format(fw='fw')})
SELECT event_id, {stamp('ts')} AS ts, src_ip, {i8('dst_port')} AS dst_port, {i8('1')} AS times FROM hourly"""))
def stream_keyset(spark, sf):
    """Half of the rows, then all of them after a restart, cut inside rows of one time: each row once."""
    spark.dataSource.register(KeysetSource)
    rows = spark.sql(HOURLY_SQL, fw=fw(spark, sf))
    base = new_path(spark, "keyset")
    # Ids of the cut's time follow the order in which they arrive.
    ranked = rows.withColumn("event_id", F.struct((~F.expr(CUT_SQL)).cast("int").alias("part"), "event_id"))
    parts = materialize(ranked.select(
        (F.col("event_id.part") * 1_000_000_000 + F.col("event_id.event_id")).alias("event_id"), "ts", "src_ip", "dst_port",
        F.col("event_id.part").alias("part")), "parts")
    for k in range(2):
        parts.filter(F.col("part") == k).drop("part").write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.format("keyset").schema(parts.drop("part").schema).option("path", f"{base}/in").option("ts", "ts").load()
        running = J.write_table(stream, f"{base}/out", f"{base}/state", once=False, seconds=0)
        try:
            running.processAllAvailable()
        finally:
            running.stop()
    seen = spark.read.parquet(f"{base}/out").withColumn("event_id", F.col("event_id") % 1_000_000_000)
    return seen.groupBy("event_id", "ts", "src_ip", "dst_port").agg(F.count(F.lit(1)).alias("times"))


# ---- counters of a live detector ----
def replayed(spark, rows, by: str, name: str, run, files: int = 1):
    """Write a table as one file per value of a column and stream it some files at a time, in two runs of one query.

    ``run(stream, checkpoint)`` starts a query over the stream and returns it.
    """
    base = new_path(spark, name)
    # A folder per value, written in one pass: its file is then made from its own rows, not by reading the whole table.
    staged = rows.filter(F.col(by).isNotNull()).withColumn("_at", F.col(by).cast("string"))
    staged.hint("rebalance", "_at").write.partitionBy("_at").parquet(f"{base}/staged")
    stored = spark.read.schema(staged.schema).parquet(f"{base}/staged")
    values = [r[0] for r in stored.groupBy("_at").agg(F.min(by).alias("v")).orderBy("v").collect()]
    half = len(values) // 2
    for part in (values[:half], values[half:]):
        for v in part:
            one = stored.filter(F.col("_at") == F.lit(v)).drop("_at")
            one.coalesce(1).write.mode("append").parquet(f"{base}/in")
        running = run(J.tail_table(spark, f"{base}/in", rows.schema, max_files=files), f"{base}/state")
        running.awaitTermination()
    return running


LIVE_SQL = f"""SELECT {i8('sum(total_logs)')} AS logs_so_far, {i8('sum(analysed_ips)')} AS analysed_so_far,
  {i8('sum(normal_ips)')} AS normal_so_far, {i8('sum(anomalous_ips)')} AS detections_so_far,
  {i8('max_by(total_ips, we)')} AS current_window_ips FROM summary"""
COUNTERS = ["logs_so_far", "analysed_so_far", "normal_so_far", "detections_so_far", "current_window_ips"]


def _judged(spark, sf):
    rows = behavior(spark, sf).withColumn("anomaly_score", F.expr(f"CAST({SCORE_SQL} AS DOUBLE)"))
    return rows.withColumns({"analysed": F.col("total_connections") >= 5, "is_anomaly": F.col("anomaly_score") < 0})


def _counted(spark, rows, by, name, observe, names):
    """Totals of one query over two runs, each with a listener of its own."""
    path = new_path(spark, "totals")

    def run(stream, checkpoint):
        listener = RunningCounters(Totals(spark, path), name)
        spark.streams.addListener(listener)
        running = observe(stream).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).format("noop").start()
        running.awaitTermination()
        # Events come in order; what was observed is there before the query is said to have ended.
        spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
        spark.streams.removeListener(listener)
        return running

    replayed(spark, rows, by, "counted", run)
    return Totals(spark, path).table(names).select(*names)


@query("running_totals_live", with_behavior(LIVE_SQL, SUMMARY_SQL))
def running_totals_live(spark, sf):
    """The detector's counters from a listener, one window per batch, after a restart."""
    return _counted(spark, _judged(spark, sf), "window_end", "detector", observe_windows, COUNTERS)


@query("fetch_totals_live", with_fw(f"""SELECT {i8('count(*)')} AS total_fetched,
  {i8("count(*) FILTER (date_trunc('day', ts) = (SELECT max(date_trunc('day', ts)) FROM fw))")} AS last_batch_size FROM fw"""))
def fetch_totals_live(spark, sf):
    """Rows fetched in all and in the last batch, one day per batch."""
    rows = fw(spark, sf).select("event_id", "ts", F.date_trunc("day", "ts").alias("day"))
    return _counted(spark, rows, "day", "fetches", lambda s: observe_fetches(s, ts="ts"), ["total_fetched", "last_batch_size"])


# ---- one state per source instead of a join with the log ----
LATEST_FIELDS = ["window_start", "window_end", "src_ip", "anomaly_score", "severity", "blocked"]


def _kept_live(spark, sf, every=False):
    base = new_path(spark, "live-out")

    def run(stream, checkpoint):
        kept = latest_by_source(stream, severities=["CRITICAL", "HIGH"], every=every)
        return write_latest(kept, f"{base}/kept", checkpoint)

    # Only anomalous windows can block; scores of the others are kept as they are.
    rows = scored(spark, sf).withColumn("severity", F.when(F.col("is_anomaly"), F.col("severity")).otherwise("LOW"))
    replayed(spark, rows, "window_end", "live", run, files=5)
    return f"{base}/kept"


@query("stream_suppress_after_block", with_behavior(f"""SELECT {KEYS}, {r6('anomaly_score')} AS anomaly_score,
  CASE WHEN is_anomaly THEN severity ELSE 'LOW' END AS severity, {flag('blocked')} AS blocked
FROM flagged LEFT JOIN firsts ON src_ip = ip WHERE first_block IS NULL OR we <= first_block""", FLAGGED_SQL))
def stream_suppress_after_block(spark, sf):
    """Five windows per batch: a source's windows after the one that blocked it are left out."""
    return spark.read.parquet(_kept_live(spark, sf, every=True)).select(*LATEST_FIELDS)


@query("stream_latest_detection", with_behavior(f"""SELECT {KEYS}, {r6('anomaly_score')} AS anomaly_score,
  CASE WHEN is_anomaly THEN severity ELSE 'LOW' END AS severity, {flag('blocked')} AS blocked FROM (
  SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY we DESC) AS rn
  FROM flagged LEFT JOIN firsts ON src_ip = ip WHERE first_block IS NULL OR we <= first_block) q WHERE rn = 1""", FLAGGED_SQL))
def stream_latest_detection(spark, sf):
    """One row per source: the newest that its state let through."""
    return J.latest_windows(spark, _kept_live(spark, sf), ("src_ip",)).select(*LATEST_FIELDS)


# ---- exact distinct destinations of closed windows ----
def _exact_windows(spark, rows, size, slide):
    """A last row far ahead closes all windows."""
    base = new_path(spark, "exact")
    rows.write.parquet(f"{base}/in")
    wide = materialize(J.wide_sources(spark.read.schema(rows.schema).parquet(f"{base}/in")), "wide")
    stream = lambda: J.tail_table(spark, f"{base}/in", rows.schema)
    exact = lambda: J.exact_behavior_stream(stream(), "ts", size, slide, order=["event_id"], wide=wide)
    start = lambda: J.write_table(exact(), f"{base}/out", f"{base}/state")
    start().awaitTermination()
    ahead = rows.limit(1).withColumns({"ts": F.col("ts") + F.expr("INTERVAL 10000 DAYS"), "src_ip": F.lit("closing")})
    ahead.write.mode("append").parquet(f"{base}/in")
    start().awaitTermination()
    return spark.read.parquet(f"{base}/out").filter("src_ip <> 'closing'").drop("avg_data_length", "first_row")


WINDOWS_SQL = f"""win AS (SELECT fw.*, date_trunc('day', ts) - to_days(CAST(i AS INTEGER)) AS ws FROM fw CROSS JOIN range(3) r(i))
SELECT {stamp('ws')} AS window_start, {stamp('ws + INTERVAL 3 DAY')} AS window_end, src_ip, {AGGREGATES},
  {r6(f'count(*) / {float(SIZE)}')} AS connection_rate FROM win GROUP BY ws, src_ip"""


@query("stream_windows_exact", with_fw(f", {WINDOWS_SQL}"))
def stream_windows_exact(spark, sf):
    return _exact_windows(spark, fw(spark, sf), SIZE, SLIDE)


# One source reaches as many destinations as there are orders.
SWEEP_SQL = """SELECT l_orderkey * 10 + l_linenumber AS event_id, {ts} AS ts,
  CASE WHEN l_linenumber % 3 = 0 THEN concat('203.0.113.', l_suppkey % 4) ELSE '203.0.113.200' END AS src_ip,
  concat('10.', CAST(FLOOR(l_orderkey / 65536) % 256 AS INT), '.', CAST(FLOOR(l_orderkey / 256) % 256 AS INT), '.', l_orderkey % 256) AS dst_ip,
  CAST(1024 + l_partkey % 50000 AS INT) AS src_port, CAST(1 + l_suppkey % 1000 AS INT) AS dst_port, 'tcp' AS proto_name,
  CASE WHEN l_returnflag = 'R' THEN 'block' ELSE 'pass' END AS action, 'in' AS dir, 'match' AS reason,
  CAST(40 + l_partkey % 1461 AS INT) AS length, CAST(l_partkey % 500 AS INT) AS data_length, 64 AS ttl,
  'S' AS tcp_flags, 64240 AS tcp_window FROM {lineitem}"""
# All rows fall into a few days, whatever the years of the orders.
SWEEP_DUCK = SWEEP_SQL.format(ts="TIMESTAMP '2024-01-01' + to_days(CAST(l_orderkey % 2 AS INTEGER)) + to_hours(CAST(l_linenumber AS INTEGER))", lineitem="lineitem")


@query("stream_windows_sweep", f"WITH fw AS ({SWEEP_DUCK}), {WINDOWS_SQL}")
def stream_windows_sweep(spark, sf):
    """A source that sweeps over all addresses: exact where a sketch is off."""
    ts = "TIMESTAMP '2024-01-01' + make_dt_interval(CAST(l_orderkey % 2 AS INT), CAST(l_linenumber AS INT))"
    rows = spark.sql(SWEEP_SQL.replace("{ts}", ts), lineitem=load(spark, sf, "lineitem"))
    return _exact_windows(spark, rows, SIZE, SLIDE).select("window_start", "window_end", "src_ip", *[c.strip() for c in COLUMNS.split(",")])
