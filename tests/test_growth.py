"""Work that must not grow faster than the tables: lines made once, files of bounded size, values staged apart."""

import datetime as dt

from pyspark.sql import functions as F

from flowwarden.catalog import QUERIES, lines, streams
from flowwarden.plans import storage
from flowwarden.streaming import jobs as J

SF = "/root/testdata/sf0.001"


def test_accounting_makes_its_lines_once(spark):
    plan = QUERIES["parse_accounting"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "filterlog 98188" not in plan


def test_streamed_lines_are_in_files_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(lines, "LINES_PER_FILE", 100, raising=False)
    base = storage.new_path(spark, "growth")
    monkeypatch.setattr(lines, "new_path", lambda *_: base)
    lines.parse_stream_counts(spark, SF).collect()
    written = spark.read.parquet(f"{base}/in").groupBy(F.input_file_name()).count()
    assert written.count() >= 9 and max(r["count"] for r in written.collect()) < 200


def test_replayed_values_are_staged_apart_and_streamed_in_order(spark, monkeypatch):
    base = storage.new_path(spark, "growth")
    monkeypatch.setattr(streams, "new_path", lambda *_: base)
    times = [dt.datetime(2024, 1, d) for d in (3, 1, 2)]
    rows = spark.createDataFrame([(i, times[i % 3]) for i in range(30)] + [(99, None)], "i int, at timestamp")
    seen = []

    def run(stream, checkpoint):
        note = lambda batch, _: seen.append({r.at for r in batch.collect()})
        running = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(note).start()
        running.awaitTermination()
        return running

    streams.replayed(spark, rows, "at", "growth", run)
    assert seen == [{t} for t in sorted(times)]
    assert len(spark.read.parquet(f"{base}/staged").select(F.input_file_name()).distinct().collect()) == 3


def test_destinations_of_a_stream_are_a_small_sketch(spark):
    rows = spark.range(3001).select(
        F.lit("a").alias("src_ip"), F.when(F.col("id") < 3000, F.concat(F.lit("d"), "id")).alias("dst_ip"), F.lit(80).alias("dst_port"), F.lit("in").alias("dir"),
        F.lit("pass").alias("action"), F.lit("tcp").alias("proto_name"), F.lit(1).alias("src_port"), F.lit(10).alias("length"), F.lit(64).alias("ttl"),
        F.lit(5).alias("data_length"), F.lit("match").alias("reason"), F.lit("S").alias("tcp_flags"), F.lit(1).alias("tcp_window"),
        F.lit(dt.datetime(2024, 1, 1)).alias("ts"))
    found = J.behavior_stream(rows, "ts", 60, 60)
    assert "hll_sketch_agg" in found._jdf.queryExecution().analyzed().toString()
    assert abs(found.first().unique_dst_ips - 3000) < 150
    nothing = J.behavior_stream(rows.withColumn("dst_ip", F.lit(None).cast("string")), "ts", 60, 60)
    assert nothing.first().unique_dst_ips == 0
