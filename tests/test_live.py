"""Live totals, keyset stream, state per source and exact distinct counts beside plain references."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from flowwarden.catalog.streams import stream_windows_exact
from flowwarden.catalog.tables import fw
from flowwarden.plans import versions
from flowwarden.plans.storage import new_path
from flowwarden.sources.keyset import KeysetReader, KeysetSource
from flowwarden.sources.readers import fetch_after, next_cursor
from flowwarden.streaming import jobs as J
from flowwarden.streaming.counters import RunningCounters, Totals, observe_fetches
from flowwarden.streaming.latest import latest_by_source, write_latest

SF = "/root/testdata/sf0.001"
START = dt.datetime(2024, 1, 1)


# --- totals --------------------------------------------------------------------------
def test_totals_count_a_retried_batch_once(spark):
    totals = Totals(spark, new_path(spark, "totals"))
    for batch in range(50):
        for _ in range(1 + batch % 2):
            totals.add("q", batch, {"n": batch, "newest": START + dt.timedelta(days=batch % 7), "last_batch_size": batch, "nothing": None})
    assert totals.add("q", 10, {"n": 1000}) == totals.read("q")  # older than the last
    got = totals.read("q")
    assert got["n"] == sum(range(50)) and got["last_batch_size"] == 49 and got["newest"].startswith("2024-01-07")
    assert totals.queries() == ["q"] and len(versions.children(spark, f"{totals.path}/q")) == 2
    totals.add("other", 0, {"n": 5})
    rows = {r["query"]: (r.last_batch, r.n, r.nothing) for r in totals.table(["n", "nothing"]).collect()}
    assert rows == {"q": (49, sum(range(50)), None), "other": (0, 5, None)}


def test_totals_outlive_a_broken_file(spark):
    totals = Totals(spark, new_path(spark, "totals"))
    totals.add("q", 0, {"n": 1})
    totals.add("q", 1, {"n": 2})
    versions.write_text(spark, totals._file("q", 2), '{"before": {"n"', replace=True)
    assert totals.read("q") == {"n": 3}
    assert totals.add("q", 2, {"n": 4}) == {"n": 7} == totals.read("q")


def test_listener_and_batch_together(spark):
    """The job adds its batches itself and the listener hears of them too: each counts once."""
    base = new_path(spark, "both")
    rows = fw(spark, SF).select("event_id", "ts")
    rows.repartition(5, "event_id").write.parquet(f"{base}/in")
    totals = Totals(spark, f"{base}/totals")
    listener = RunningCounters(totals, "fetches")
    spark.streams.addListener(listener)

    def write(batch, number):
        totals.add(running.id, number, {"total_fetched": batch.count()})

    stream = observe_fetches(J.tail_table(spark, f"{base}/in", rows.schema, max_files=1), ts="ts")
    running = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    running.awaitTermination()
    spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
    spark.streams.removeListener(listener)
    assert totals.read(running.id)["total_fetched"] == rows.count()
    assert running.id in listener.rows_per_second and listener.uptime_seconds(running.id) == 0.0 and not listener.failed


# --- keyset --------------------------------------------------------------------------
def keyset(spark, path, schema, **options):
    spark.dataSource.register(KeysetSource)
    return spark.readStream.format("keyset").schema(schema).option("path", path).option("ts", "ts").options(**options).load()


@pytest.mark.parametrize("kind", ["INT96", "TIMESTAMP_MICROS"])
def test_keyset_restart(spark, kind):
    """Ties across the restart, files written in between, none lost and none repeated; fetches agree."""
    base = new_path(spark, "keyset")
    spark.conf.set("spark.sql.parquet.outputTimestampType", kind)
    rows = [(i, START + dt.timedelta(hours=i // 40), f"10.0.0.{i % 9}") for i in range(400)] + [(None, START, "x"), (7000, None, "y")]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, src_ip string")
    try:
        for low, high in ((0, 130), (130, 131), (131, 400)):
            chosen = F.col("event_id").between(low, high - 1) | (F.lit(low == 0) & (F.col("event_id").isNull() | F.col("ts").isNull()))
            df.filter(chosen).repartition(3).write.mode("append").parquet(f"{base}/in")
            running = J.write_table(keyset(spark, f"{base}/in", df.schema, tasks=2), f"{base}/out", f"{base}/state", once=False, seconds=0)
            running.processAllAvailable()
            running.stop()
    finally:
        spark.conf.unset("spark.sql.parquet.outputTimestampType")
    got = sorted((tuple(r) for r in spark.read.parquet(f"{base}/out").collect()), key=lambda r: (r[1], -1 if r[0] is None else r[0]))
    assert [g[0] for g in got] == [None, *range(400)]
    table, cursor, fetched = spark.read.parquet(f"{base}/in"), (START - dt.timedelta(days=1), -1), []
    while True:
        batch = fetch_after(table, *cursor, 150, "ts")
        after = next_cursor(batch, "ts")
        if after is None:
            break
        fetched += [tuple(r) for r in batch.collect()]
        cursor = after
    assert fetched == got


def test_keyset_plans_by_statistics(spark):
    """Row groups outside the range are left out, and work is dealt evenly to the tasks."""
    path = new_path(spark, "keyset")
    df = spark.range(1000).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    df.repartitionByRange(10, "ts").write.parquet(path)
    reader = KeysetReader(df.schema, {"path": path, "ts": "ts", "tasks": "3"})
    assert reader.initialOffset() == {"ts": None, "id": None}
    end = reader.latestOffset()
    assert end == {"ts": 999 * 60_000_000, "id": 999}
    whole = reader.partitions(reader.initialOffset(), end)
    assert len(whole) == 3 and sum(len(p.parts) for p in whole) == 10
    some = reader.partitions({"ts": 950 * 60_000_000, "id": 950}, end)
    assert sum(len(p.parts) for p in some) == 1
    assert sum(b.num_rows for p in some for b in reader.read(p)) == 49
    assert reader.partitions(end, end) == []
    assert KeysetReader(df.schema, {"path": new_path(spark, "nothing"), "ts": "ts"}).latestOffset() == {"ts": None, "id": None}


# --- state per source ----------------------------------------------------------------
def test_latest_by_source_with_commands(spark):
    """A block by hand holds a source, an unblock frees it, and a restart keeps both."""
    base = new_path(spark, "live")
    day = lambda n: START + dt.timedelta(days=n)
    scored = "src_ip string, window_start timestamp, window_end timestamp, total_connections long, anomaly_score double, severity string"
    asked = "src_ip string, event_at timestamp, action string"

    def batch(n, rows, commands=()):
        spark.createDataFrame(rows, scored).coalesce(1).write.mode("append").parquet(f"{base}/in")
        spark.createDataFrame(list(commands), asked).coalesce(1).write.mode("append").parquet(f"{base}/asked")
        stream = J.tail_table(spark, f"{base}/in", spark.createDataFrame([], scored).schema)
        hands = J.tail_table(spark, f"{base}/asked", spark.createDataFrame([], asked).schema)
        write_latest(latest_by_source(stream, hands, ["HIGH"]), f"{base}/out", f"{base}/state").awaitTermination()
        out = spark.read.parquet(f"{base}/out").filter(F.col("batch") >= n)
        return sorted((r.src_ip, r.window_end, r.blocked) for r in out.collect())

    before = spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled")
    row = lambda ip, n, severity="LOW", score=-0.1: (ip, day(n - 1), day(n), 9, score, severity)
    assert batch(0, [row("a", 1, "HIGH"), row("a", 2), row("b", 1), row("b", 2), (None, day(0), day(1), 1, -0.1, "LOW"), ("c", day(0), day(1), 1, None, "LOW")]) == [
        ("a", day(1), True), ("b", day(2), False)]
    assert batch(1, [row("a", 3), row("b", 3)], [(" b ", day(3), "block"), ("x", day(3), "other")]) == [("b", day(3), False)]
    assert batch(2, [row("a", 5), row("b", 5)], [("a", day(4), "unblock")]) == [("a", day(5), False)]
    assert batch(3, [row("a", 4)]) == []  # late, not newer
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == before


# --- exact distinct counts -----------------------------------------------------------
def test_exact_distinct_destinations(spark):
    """12,000 destinations of one source, some ports on all of them, nulls in every column."""
    base = new_path(spark, "wide")
    rows = fw(spark, SF).limit(1).drop("event_id").crossJoin(spark.range(24_000).withColumnRenamed("id", "event_id"))
    rows = rows.withColumns({
        "ts": F.timestamp_seconds(F.lit(1_704_100_000) + F.col("event_id") % 50), "src_ip": F.lit("203.0.113.1"),
        "dst_ip": F.when(F.col("event_id") % 1000 != 7, F.concat(F.lit("10.1."), (F.col("event_id") % 12_000).cast("string"))),
        "dst_port": F.when(F.col("event_id") % 11 != 3, (F.col("event_id") % 997).cast("int"))})
    far = rows.limit(1).withColumn("ts", F.timestamp_seconds(F.lit(1_804_100_000)))
    for part in (rows, far):
        part.write.mode("append").parquet(f"{base}/in")
        stream = J.exact_behavior_stream(J.tail_table(spark, f"{base}/in", rows.schema), "ts", 86_400, 86_400, order=["event_id"])
        J.write_table(stream, f"{base}/out", f"{base}/state").awaitTermination()
    got = spark.read.parquet(f"{base}/out").collect()
    want = rows.agg(F.count_distinct("dst_ip"), F.count_distinct("dst_port"), F.count("*")).first()
    assert len(got) == 1 and (got[0].unique_dst_ips, got[0].unique_dst_ports, got[0].total_connections) == tuple(want)
    assert got[0].unique_dst_ips > 10_000


def test_exact_destinations_have_a_state_per_part(spark):
    """9,000 destinations of one source make as many states as there are parts, not one each."""
    base = new_path(spark, "parts")
    rows = fw(spark, SF).limit(1).drop("event_id").crossJoin(spark.range(9_000).withColumnRenamed("id", "event_id")).withColumns({
        "ts": F.timestamp_seconds(F.lit(1_704_100_000)), "src_ip": F.lit("203.0.113.1"), "dst_ip": F.concat(F.lit("10.1."), F.col("event_id").cast("string"))})
    rows.write.parquet(f"{base}/in")
    running = J.write_table(J.exact_behavior_stream(J.tail_table(spark, f"{base}/in", rows.schema), "ts", 86_400, 86_400), f"{base}/out", f"{base}/state")
    running.awaitTermination()
    most = max(s.numRowsTotal for p in running.recentProgress for s in p.stateOperators)
    assert 0 < most <= 512


def test_sources_not_listed_as_wide_have_one_state_per_window(spark):
    """2,000 destinations each: the listed source has a state per part, the other one, and both counts are exact."""
    base = new_path(spark, "narrow")
    rows = fw(spark, SF).limit(1).drop("event_id").crossJoin(spark.range(4_000).withColumnRenamed("id", "event_id")).withColumns({
        "ts": F.timestamp_seconds(F.lit(1_704_100_000) + F.col("event_id") % 50),
        "src_ip": F.when(F.col("event_id") % 2 == 0, "203.0.113.1").otherwise("203.0.113.2"),
        "dst_ip": F.when(F.col("event_id") > 9, F.concat(F.lit("10.1."), (F.col("event_id") % 3_000).cast("string"))),
        "dst_port": F.when(F.col("event_id") > 5, (F.col("event_id") % 97).cast("int"))})
    far = rows.limit(1).withColumn("ts", F.timestamp_seconds(F.lit(1_804_100_000)))
    wide = spark.createDataFrame([("203.0.113.1",), ("203.0.113.9",)], "src_ip string")
    states = 0
    for part in (rows, far):
        part.write.mode("append").parquet(f"{base}/in")
        stream = J.exact_behavior_stream(J.tail_table(spark, f"{base}/in", rows.schema), "ts", 86_400, 86_400, order=["event_id"], wide=wide)
        running = J.write_table(stream, f"{base}/out", f"{base}/state")
        running.awaitTermination()
        states = max([states, *(s.numRowsTotal for p in running.recentProgress for s in p.stateOperators)])
    shown = ["src_ip", "unique_dst_ips", "unique_dst_ports", "total_connections", "first_row"]
    got = sorted(spark.read.parquet(f"{base}/out").select(*shown).collect())
    first = F.min_by(F.struct("proto_name", "dir", "reason", "tcp_flags", "tcp_window"), F.struct("ts", "event_id")).alias("first_row")
    want = rows.groupBy("src_ip").agg(
        F.count_distinct("dst_ip").alias("unique_dst_ips"), F.count_distinct("dst_port").alias("unique_dst_ports"),
        F.count("*").alias("total_connections"), first)
    assert got == sorted(want.select(*shown).collect()) and len(got) == 2
    assert 400 < states <= 512 + 1


def test_wide_sources(spark):
    reached = spark.range(3_000).select(F.lit("a").alias("src_ip"), F.col("id").cast("string").alias("dst_ip"))
    rows = reached.union(reached.selectExpr("'b'", "string(dst_ip % 20)")).union(reached.selectExpr("CAST(NULL AS STRING)", "dst_ip"))
    assert [r.src_ip for r in J.wide_sources(rows, 1_000).collect()] == ["a"]
    assert J.wide_sources(rows).count() == 0


def test_exact_windows_keep_a_state_per_window_and_source(spark, monkeypatch):
    """Sources of few destinations: no more states than windows that come out."""
    started, write = [], J.write_table
    monkeypatch.setattr(J, "write_table", lambda *a, **b: started.append(write(*a, **b)) or started[-1])
    windows = stream_windows_exact(spark, SF).count()
    most = max(s.numRowsTotal for q in started for p in q.recentProgress for s in p.stateOperators)
    assert 0 < most <= windows + 3  # the row that closes the windows is in three
