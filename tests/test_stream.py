"""Streaming jobs: the block loop, duplicates, folders by day."""

import datetime as dt

from pyspark.sql import functions as F

from flowwarden import schema as S
from flowwarden.catalog.tables import fw
from flowwarden.operators import blocklist as L
from flowwarden.plans import training as Tr
from flowwarden.plans.storage import new_path
from flowwarden.sources import writers
from flowwarden.streaming import jobs as J
from flowwarden.streaming.counters import Totals

SF = "/root/testdata/sf0.001"


def test_detection_stream_blocks_once(spark):
    rows = fw(spark, SF, "@timestamp")
    model, _ = Tr.fit(rows, trees=20, rows_per_tree=64)
    model.offset = 0.0  # everything is anomalous: every eligible source must end up blocked
    base = new_path(spark, "detect")
    spark.createDataFrame([], S.block_event_schema()).write.parquet(f"{base}/blocks/batch=-1")
    spark.createDataFrame([("192.168.0.1", "block", "HIGH", "by hand", -0.4, dt.datetime(2024, 1, 1))],
                          S.block_event_schema()).write.mode("overwrite").parquet(f"{base}/blocks/batch=-1")

    def run(part):
        part.write.mode("append").parquet(f"{base}/in")
        stream = J.tail_table(spark, f"{base}/in", rows.schema)
        windows = J.behavior_stream(stream, "@timestamp", 3 * 86_400, 86_400)
        J.detection_stream(windows, model, f"{base}/blocks", f"{base}/found", f"{base}/state", totals=totals).awaitTermination()

    totals = Totals(spark, f"{base}/totals")
    run(rows.filter("`@timestamp` < '2024-01-15'"))
    blocks = J.read_block_log(spark, f"{base}/blocks")
    first = {r.ip for r in L.current_blocks(blocks).collect()}
    assert len(first) > 3
    run(rows.filter("`@timestamp` >= '2024-01-15'"))
    found = spark.read.option("recursiveFileLookup", "true").parquet(f"{base}/found")
    assert found.filter("ip = '192.168.0.1'").count() == 0
    later = {r.ip for r in found.filter("batch > 0").select("ip").distinct().collect()}
    assert not later & first  # a blocked source is not analysed again
    per_ip = J.read_block_log(spark, f"{base}/blocks").groupBy("ip").count()
    assert per_ip.filter("count > 1").count() == 0
    counted = totals.read(totals.queries()[0])
    assert counted["blocks_so_far"] == per_ip.count() - 1 and counted["detections_so_far"] == found.count() == counted["analysed_so_far"]
    latest = J.latest_detections(spark, f"{base}/found")
    assert latest.count() == latest.select("ip", "timestamp").distinct().count() > 0

    # An unblock by hand counts from the next batch on, with a new checkpoint too; old blocks stay.
    freed = sorted(first - {"192.168.0.1"})[0]
    gone = spark.createDataFrame([(freed, "unblock", None, None, None, dt.datetime(2030, 1, 1))], S.block_event_schema())
    L.append_events(gone, f"{base}/blocks")
    stream = J.tail_table(spark, f"{base}/in", rows.schema)
    windows = J.behavior_stream(stream, "@timestamp", 3 * 86_400, 86_400)
    J.detection_stream(windows, model, f"{base}/blocks", f"{base}/found-again", f"{base}/state-again").awaitTermination()
    again = {r.ip for r in spark.read.option("recursiveFileLookup", "true").parquet(f"{base}/found-again").select("ip").distinct().collect()}
    assert freed in again
    assert "192.168.0.1" not in again
    assert not again & (first - {freed})
    assert J.read_block_log(spark, f"{base}/blocks").filter(F.col("ip") == "192.168.0.1").count() == 1


def test_stream_duplicates_and_stats(spark):
    base = new_path(spark, "dedup")
    rows = fw(spark, SF).select("event_id", "ts", "src_ip")
    rows.unionAll(rows).write.parquet(f"{base}/in")
    stream = J.dedup_stream(J.tail_table(spark, f"{base}/in", rows.schema), ["event_id"], "ts")
    J.write_table(stream, f"{base}/out", f"{base}/state").awaitTermination()
    assert spark.read.parquet(f"{base}/out").count() == rows.count()


def test_stream_totals_outlast_the_progress_history(spark):
    """More batches than Spark keeps progress of: the total still counts all."""
    base = new_path(spark, "totals")
    rows = fw(spark, SF).select("event_id", "ts")
    rows.repartition(107, "event_id").write.parquet(f"{base}/in")
    stream = J.tail_table(spark, f"{base}/in", rows.schema, max_files=1)
    J.count_batches(stream, f"{base}/counts", f"{base}/state", "ts").awaitTermination()
    stats = J.stream_stats(spark, f"{base}/counts").first()
    assert spark.read.option("recursiveFileLookup", "true").parquet(f"{base}/counts").count() > 100
    assert stats.total_fetched == rows.count()


def test_rows_without_time_count_as_now(spark):
    base = new_path(spark, "now")
    rows = fw(spark, SF, "@timestamp").withColumn("@timestamp", F.lit(None).cast("timestamp"))
    rows.write.parquet(f"{base}/in")
    windows = J.behavior_stream(J.tail_table(spark, f"{base}/in", rows.schema), "@timestamp", 60, 60)
    J.upsert_windows(windows, f"{base}/out", f"{base}/state").awaitTermination()
    assert J.latest_windows(spark, f"{base}/out").agg(F.sum("total_connections")).first()[0] == rows.count()


def test_parsed_and_rejected_go_to_their_own_folders(spark):
    base = new_path(spark, "parsed")
    good = fw(spark, SF)
    bad = good.limit(3).select(F.col("src_ip").alias("message"))
    writers.write_parsed(good, bad, f"{base}/ok", f"{base}/errors", "ts")
    day = spark.read.parquet(f"{base}/ok").filter("event_date = '2024-01-02'")
    assert day.count() == good.filter("to_date(ts) = '2024-01-02'").count()
    assert spark.read.parquet(f"{base}/errors").count() == 3
