"""The same operators under Structured Streaming."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowwarden import schema as S
from flowwarden.operators import behavior as B
from flowwarden.operators import blocklist as L
from flowwarden.operators import detect as D
from flowwarden.operators import parse as P
from flowwarden.plans.joins import checked_left_join
from flowwarden.plans.training import Model, score
from flowwarden.sources.writers import write_daily
from flowwarden.streaming.blocklog import COMPACT_EVERY, BlockLog
from flowwarden.streaming.counters import Totals, window_metrics

# Registers of the sketch of destinations, as a power of two: a standard error of 1.6 %.
SKETCH_BITS = 12
# Parts into which a source's destinations are dealt where they are counted exactly.
DESTINATION_PARTS = 512
# The part of a source that is not dealt out, and how many destinations one state may hold.
WHOLE = -1
WIDE_SOURCE = 16_384


def tail_lines(spark: SparkSession, folder: str, kind: str = "firewall",
               max_files: int = 100) -> DataFrame:
    """Raw lines as they arrive in a folder, tagged with their kind."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(folder)
    return lines.select(F.col("value").alias("message"), F.lit(kind).alias("type"))


def tail_table(spark: SparkSession, folder: str, schema: T.StructType, files: str = "*.parquet",
               max_files: int = 100) -> DataFrame:
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
            .option("pathGlobFilter", files).parquet(folder))


def _start(df: DataFrame, checkpoint: str, once: bool, seconds: int):
    writer = df.writeStream.option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True) if once else writer.trigger(
        processingTime=f"{seconds} seconds")


def write_table(df: DataFrame, path: str, checkpoint: str, once: bool = True,
                seconds: int = S.FETCH_SECONDS, kind: str = "parquet",
                partition_by: list[str] = ()):
    """Append a stream to files: parquet, or ``json`` for one object per line."""
    writer = _start(df, checkpoint, once, seconds).format(kind).option("path", path).outputMode("append")
    return (writer.partitionBy(*partition_by) if partition_by else writer).start()


def parse_stream(lines: DataFrame, path: str, error_path: str, checkpoint: str, totals: Totals | None = None,
                 message: str = "message", once: bool = True, seconds: int = S.FETCH_SECONDS):
    """Parse a stream of raw lines once; write accepted rows and rejected lines, and count all outcomes.

    The parsed batch is kept while its two parts are written, so a batch is read
    and parsed once.  Both parts go to a folder per batch, which a retry
    replaces, and below it by day.  The counts (``read`` and one per outcome)
    are observed while the accepted rows are written and added to ``totals``
    before the batch is committed.
    """
    def write(batch: DataFrame, number: int) -> None:
        parsed = P.classify_lines(batch, message).persist()
        try:
            seen = Observation()
            counted = parsed.observe(seen, F.count(F.lit(1)).alias("read"), *[
                F.count_if(F.col("outcome") == o).alias(o.replace(" ", "_")) for o in P.OUTCOMES])
            accepted = counted.filter("outcome = 'accepted'").drop("outcome", "tags", message)
            write_daily(accepted, f"{path}/batch={number}", mode="overwrite")
            rejected = parsed.filter("outcome = 'rejected'").select(*batch.columns, "tags").withColumn("event_date", F.current_date())
            rejected.write.mode("overwrite").partitionBy("event_date").parquet(f"{error_path}/batch={number}")
            if totals is not None:
                totals.add(_query_id(batch.sparkSession, checkpoint), number, seen.get)
        finally:
            parsed.unpersist()

    return _start(lines, checkpoint, once, seconds).outputMode("append").foreachBatch(write).start()


def dedup_stream(df: DataFrame, columns: list[str] | None = None, ts: str = "@timestamp",
                 delay: str = "60 seconds") -> DataFrame:
    return df.withWatermark(f"`{ts}`", delay).dropDuplicatesWithinWatermark(columns or df.columns)


def behavior_stream(df: DataFrame, ts: str = "@timestamp", size: int = S.WINDOW_SECONDS,
                    slide: int = S.SLIDE_SECONDS, delay: str | None = None,
                    order: list[str] = ()) -> DataFrame:
    """The behaviour columns per window and source as a streaming aggregate.

    The earliest row of a window stands for it; ``order`` breaks ties of time,
    then the row's own values do.

    State per key is bounded: destinations are counted with a sketch that is small
    for few of them (within 2 %), ports by the set of at most 65,536 values.
    """
    c = F.col

    ties = [c(x) for x in [*order, *B.FIRST_ROW]]

    def share(condition):
        return F.avg(F.coalesce(condition, F.lit(False)).cast("int"))

    # A row without a time counts as arriving now, as in the batch operators.
    now = F.coalesce(c(f"`{ts}`").cast("timestamp"), F.current_timestamp())
    rows = df.filter(c("src_ip").isNotNull()).withColumn(ts, now)
    grouped = rows.withWatermark(f"`{ts}`", delay or f"{size} seconds").groupBy(
        F.window(c(ts), f"{size} seconds", f"{slide} seconds"), "src_ip")
    out = grouped.agg(
        F.count("*").alias("total_connections"),
        F.hll_sketch_estimate(F.hll_sketch_agg(c("dst_ip").cast("string"), SKETCH_BITS)).alias("unique_dst_ips"),
        F.size(F.collect_set("dst_port")).cast("bigint").alias("unique_dst_ports"),
        share(c("action") == "block").alias("block_ratio"),
        share(c("action") == "pass").alias("pass_ratio"),
        F.avg("src_port").alias("avg_src_port"), F.avg("dst_port").alias("avg_dst_port"),
        F.stddev_samp("dst_port").alias("dst_port_diversity"),
        share(c("dst_port").isin(S.HIGH_RISK_PORTS)).alias("high_risk_port_ratio"),
        share(c("proto_name") == "tcp").alias("tcp_ratio"),
        share(c("proto_name") == "udp").alias("udp_ratio"),
        share(c("proto_name") == "icmp").alias("icmp_ratio"),
        F.avg("length").alias("avg_packet_length"),
        F.stddev_samp("length").alias("packet_length_std"),
        F.avg("ttl").alias("avg_ttl"),
        (F.count("*") / F.lit(float(size))).alias("connection_rate"),
        F.avg("data_length").alias("avg_data_length"),
        F.min_by(F.struct(*B.FIRST_ROW), F.struct(F.col(f"`{ts}`"), *ties)).alias("first_row"),
    )
    return out.select(c("window.start").alias("window_start"), c("window.end").alias("window_end"),
                      *[x for x in out.columns if x != "window"])


def wide_sources(df: DataFrame, more_than: int = WIDE_SOURCE) -> DataFrame:
    """Sources of a table that reach more than so many destinations, by a sketch: ``wide`` of :func:`exact_behavior_stream`."""
    seen = df.filter(F.col("src_ip").isNotNull()).groupBy("src_ip").agg(F.approx_count_distinct("dst_ip").alias("_reached"))
    return seen.filter(F.col("_reached") > more_than).select("src_ip")


def exact_behavior_stream(df: DataFrame, ts: str = "@timestamp", size: int = S.WINDOW_SECONDS,
                          slide: int = S.SLIDE_SECONDS, delay: str | None = None, order: list[str] = (),
                          wide: DataFrame | None = None) -> DataFrame:
    """The behaviour columns of :func:`behavior_stream` with exact distinct counts.

    Two stateful steps: sums and sets per window, source and part of its destinations, then
    their sums per window and source.  A destination is in one of ``DESTINATION_PARTS``
    parts by its hash, so a source that reaches very many of them is spread over tasks and
    has a state per part, not one per destination; the sizes of the parts' sets add up to
    the exact count.  Windows come out once, in append mode, when the watermark has passed them.

    With ``wide``, a table with ``src_ip``, only its sources are dealt into parts; any other has one
    state per window.  The counts are exact whatever it lists, but it must be the same for the life of a checkpoint.
    """
    now = F.coalesce(F.col(f"`{ts}`").cast("timestamp"), F.current_timestamp())
    rows = df.filter(F.col("src_ip").isNotNull()).withColumn(ts, now).withWatermark(f"`{ts}`", delay or f"{size} seconds")
    dealt = F.pmod(F.xxhash64("dst_ip"), F.lit(DESTINATION_PARTS))
    if wide is None:
        rows = rows.withColumn("_part", dealt)
    else:
        rows = checked_left_join(rows, wide.select(F.col("src_ip").alias("_wide")).distinct(), [("src_ip", "_wide")])
        rows = rows.withColumn("_part", F.when(F.col("_wide").isNotNull(), dealt).otherwise(WHOLE)).drop("_wide")
    # The earliest row as one value: its times and keys, then the fields that are wanted of it.
    lead = [ts, *order]
    earliest = F.min(F.struct(*[F.col(f"`{x}`").alias(f"_{i}") for i, x in enumerate([*lead, *B.FIRST_ROW])])).alias("first_at")
    per_part = rows.groupBy(F.window(F.col(f"`{ts}`"), f"{size} seconds", f"{slide} seconds"), "src_ip", "_part").agg(
        *B.partial_sums(False, []), earliest, F.collect_set("dst_ip").alias("_reached"), F.collect_set("dst_port").alias("ports"))
    first_row = F.struct(*[F.col(f"first_at._{i}").alias(x) for i, x in enumerate(B.FIRST_ROW, len(lead))])
    # Ports of a source in one part are counted here.  Else there is one row per port; a part's sums go with its first row only.
    whole = F.col("_part") == WHOLE
    per_part = per_part.withColumns({
        "_reached": F.size("_reached"), "first_row": first_row, "_ports": F.when(whole, F.size("ports")).otherwise(0),
        "ports": F.when(~whole, F.col("ports"))})
    kept = [c for c in per_part.columns if c not in ("window", "src_ip", "_part", "ports")]
    per_port = per_part.select("window", "src_ip", *kept, F.posexplode_outer("ports").alias("_place", "_port"))
    first = F.coalesce(F.col("_place"), F.lit(0)) == 0
    per_port = per_port.select("window", "src_ip", "_port", *[F.when(first, F.col(c)).alias(c) for c in kept])
    out = per_port.groupBy("window", "src_ip").agg(
        *B.merged_sums(size, True), F.sum("_reached").alias("unique_dst_ips"),
        (F.sum("_ports") + F.size(F.collect_set("_port"))).cast("bigint").alias("unique_dst_ports"))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                      *[c for c in out.columns if c != "window"])


def upsert_windows(df: DataFrame, path: str, checkpoint: str, once: bool = True,
                   seconds: int = S.SLIDE_SECONDS):
    """Write every update of a windowed aggregate with its batch number.

    A restarted batch overwrites its own folder, so a retry adds nothing twice.
    Read the result with :func:`latest_windows`.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return _start(df, checkpoint, once, seconds).outputMode("update").foreachBatch(write).start()


def latest_windows(spark: SparkSession, path: str, keys=("window_start", "window_end", "src_ip")) -> DataFrame:
    rows = spark.read.option("basePath", path).parquet(path)
    fields = [x for x in rows.columns if x not in keys and x != "batch"]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), "batch").alias("r"))
    return newest.select(*keys, "r.*")


def read_block_log(spark: SparkSession, path: str) -> DataFrame:
    """Block and unblock events, by hand and of streams; of merged ones the newest of each address."""
    return BlockLog(spark, path).history()


def _query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id a query keeps for the life of its checkpoint; a new checkpoint has a new one."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def detection_stream(behavior: DataFrame, model: Model, block_path: str, found_path: str,
                     checkpoint: str, min_rows: int = S.MIN_ROWS_PER_IP, once: bool = True,
                     seconds: int = S.SLIDE_SECONDS, compact_every: int = COMPACT_EVERY, totals: Totals | None = None, **rules):
    """Score each batch of windows, append detections, append blocks.

    Blocked sources are left out by an anti join with the block table, so a
    source is not analysed again after its block.  ``block_path`` may be empty;
    events may be appended to it by hand at any time and count from the next
    batch on.  A batch reads the newest snapshot of the log and the changes after
    it, which are merged every ``compact_every`` batches.

    With ``totals`` the detector's counters are added to it inside each batch: rows and
    windows analysed, normal ones, detections and blocks so far, and the sources of the last batch.

    Every batch writes a folder named by query id and batch number, so a retry
    replaces its own rows and a new checkpoint adds to the old ones.  Read the
    detections with :func:`latest_detections`.
    """
    keys = ["window_start", "window_end", "src_ip", "total_connections"]

    def act(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        origin = _query_id(spark, checkpoint)
        log = BlockLog(spark, block_path)
        log.compact(compact_every)
        events = log.events(origin, number)
        blocks = L.current_blocks(events)
        chosen = B.eligible(batch, blocks, min_rows)
        scored = score(B.representative_row(chosen, "@timestamp"), model, keys).persist()
        stamp = {"origin": F.lit(origin), "batch": F.lit(number).cast("long")}
        found = D.detections(scored).withColumns(stamp)
        out = f"{found_path}/{origin}-{number}"
        found.write.mode("overwrite").parquet(out)
        kept = spark.read.schema(found.schema).parquet(out)
        wanted = D.block_decisions(kept, **rules).select(
            "ip", "severity", "reason", F.col("anomaly_score").alias("score"),
            F.col("timestamp").alias("event_at"))
        new = log.write_batch(L.block_events(events, wanted), origin, number)
        if totals is not None:
            totals.add(origin, number, scored.agg(*window_metrics()).first().asDict() | {"blocks_so_far": new.count()})
        scored.unpersist()

    return _start(behavior, checkpoint, once, seconds).outputMode("update").foreachBatch(act).start()


def latest_detections(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The last detection of each source and window end; earlier updates of a window are left out."""
    reader = spark.read.option("recursiveFileLookup", "true")
    rows = (reader.schema(schema) if schema else reader).parquet(path)
    fields = [c for c in rows.columns if c not in ("ip", "timestamp")]
    newest = rows.groupBy("ip", "timestamp").agg(F.max_by(F.struct(*fields), F.struct("batch", "logs_count")).alias("r"))
    return newest.select("ip", "timestamp", "r.*")


def count_batches(df: DataFrame, path: str, checkpoint: str, ts: str = "@timestamp", once: bool = True,
                  seconds: int = S.FETCH_SECONDS):
    """Write the row count and newest time of every batch; a retried batch replaces its own row."""
    def write(batch: DataFrame, number: int) -> None:
        counted = batch.agg(F.count("*").alias("fetched"), F.max(f"`{ts}`").alias("newest"))
        counted.withColumn("batch", F.lit(number).cast("long")).coalesce(1).write.mode("overwrite").parquet(f"{path}/{number}")

    return _start(df, checkpoint, once, seconds).outputMode("append").foreachBatch(write).start()


def stream_stats(spark: SparkSession, path: str) -> DataFrame:
    """Rows fetched so far, rows of the last batch and the newest time, over all batches ever counted."""
    counts = spark.read.option("recursiveFileLookup", "true").parquet(path)
    return counts.agg(
        F.sum("fetched").alias("total_fetched"), F.max_by("fetched", "batch").alias("last_batch_size"), F.max("newest").alias("checkpoint"))
