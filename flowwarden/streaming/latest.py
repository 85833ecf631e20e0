"""Detections per source as state: the newest one, and whether the source is held.

A live detector must not analyse a source again that it has blocked.  Here that
is a value kept per source, so a batch looks up only the sources it contains
and reads no log.  Both values end after a time, which bounds the state by the
sources of that time.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowwarden import schema as S
from flowwarden.streaming.jobs import upsert_windows

# State that is kept per key and ends after a time needs this store.  A query whose state ends by the
# clock would otherwise run batches without data for ever, and never end when it should run once.
START_WITH = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
DAY_SECONDS = 86_400
# Times are microseconds inside.
FIELDS = [("window_start", T.LongType()), ("window_end", T.LongType()), ("total_connections", T.LongType()),
          ("anomaly_score", T.DoubleType()), ("severity", T.StringType())]
TIMES = ("window_start", "window_end")
OUT = T.StructType([T.StructField("src_ip", T.StringType()), *[T.StructField(n, t) for n, t in FIELDS],
                    T.StructField("blocked", T.BooleanType())])
COMMANDS = ("block", "unblock")


class SourceState(StatefulProcessor):
    def __init__(self, severities: list[str], hold_seconds: int, keep_seconds: int, every: bool) -> None:
        self.severities, self.hold, self.keep, self.every = set(severities), hold_seconds, keep_seconds, every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "at long", ttlDurationMs=self.hold * 1000)
        self.newest = handle.getValueState("newest", "window_end long, anomaly_score double", ttlDurationMs=self.keep * 1000)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held: int | None = self.held.get()[0] if self.held.exists() else None
        newest = tuple(self.newest.get()) if self.newest.exists() else None
        before, chosen, kept = held, None, []
        # Commands count from their time on, ahead of a window that ends then.
        for r in sorted(rows, key=lambda r: (r["window_end"], r["command"] is None, r["window_start"] or 0)):
            if r["command"] is not None:
                held = r["window_end"] if r["command"] == "block" else None
                continue
            if held is not None and r["window_end"] > held:
                continue
            stops = r["severity"] in self.severities
            if stops and (held is None or r["window_end"] < held):
                held = r["window_end"]
            kept.append((r, stops))
            # The lower score wins a tie.
            if newest is None or (r["window_end"], -r["anomaly_score"]) >= (newest[0], -newest[1]):
                newest, chosen = (r["window_end"], r["anomaly_score"]), (r, stops)
        if held is None and before is not None:
            self.held.clear()
        elif held is not None and held != before:
            self.held.update((held,))
        if chosen is not None:
            self.newest.update(newest)
        for r, stops in kept if self.every else [chosen] if chosen else []:
            yield Row(src_ip=key[0], **{n: r[n] for n, _ in FIELDS}, blocked=stops)

    def close(self) -> None:
        pass


def latest_by_source(scored: DataFrame, commands: DataFrame | None = None, severities=S.BLOCK_SEVERITIES,
                     hold_seconds: int = DAY_SECONDS, keep_seconds: int = DAY_SECONDS, every: bool = False) -> DataFrame:
    """The newest detection of each source in every batch that brings a newer one; ``every`` gives all that are kept.

    ``scored`` is a stream of windows (``src_ip, window_start, window_end,
    total_connections, anomaly_score, severity``).  From the window on that gets a
    source blocked (one of ``severities``) its later windows are left out, until
    ``hold_seconds`` have passed.  ``commands`` is a stream of blocks and unblocks by
    hand (``src_ip, event_at, action``).  Write it in update mode; the newest row of
    a source is then its latest detection.  Rows without source, window end or score are left out.

    Start it with :func:`write_latest`.
    """
    inside = lambda n, t: (F.unix_micros(F.col(n).cast("timestamp")) if n in TIMES else F.col(n).cast(t)).alias(n)
    rows = scored.select("src_ip", *[inside(n, t) for n, t in FIELDS], F.lit(None).cast("string").alias("command"))
    rows = rows.filter(F.col("src_ip").isNotNull() & F.col("window_end").isNotNull() & F.col("anomaly_score").isNotNull())
    if commands is not None:
        asked = commands.filter(F.col("action").isin(*COMMANDS) & F.col("event_at").isNotNull()).select(
            F.trim("src_ip").alias("src_ip"),
            *[(F.unix_micros("event_at") if n == "window_end" else F.lit(None)).cast(t).alias(n) for n, t in FIELDS],
            F.col("action").alias("command"))
        rows = rows.unionByName(asked.filter(F.col("src_ip") != ""))
    found = rows.groupBy("src_ip").transformWithState(
        SourceState(list(severities), hold_seconds, keep_seconds, every), OUT, "Update", "ProcessingTime")
    return found.select(*[F.timestamp_micros(n).alias(n) if n in TIMES else F.col(n) for n in found.columns])


def write_latest(latest: DataFrame, path: str, checkpoint: str, once: bool = True, seconds: int = S.SLIDE_SECONDS):
    """Write each batch to a folder by its number and return the query; see ``jobs.latest_windows``.

    The settings it needs hold for this query only.
    """
    conf = latest.sparkSession.conf
    before = {k: conf.get(k, None) for k in START_WITH}
    for k, v in START_WITH.items():
        conf.set(k, v)
    try:
        return upsert_windows(latest, path, checkpoint, once, seconds)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
