"""Running totals of live queries that outlast restarts.

A query's totals are one small file.  Adding a batch writes the next file, which
keeps the totals before that batch too, so a batch that is added again replaces
what it added first: a retried batch counts once, and the number of files does
not grow.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from flowwarden.plans import versions

# Metrics by these names keep the greatest or the last value; all others are summed.
GREATEST = ("newest", "checkpoint")
LAST = ("last_batch_size", "current_window_ips")


def _merged(before: dict, row: dict) -> dict:
    out = dict(before)
    for name, value in row.items():
        if value is None:
            continue
        old = out.get(name)
        if name in LAST or old is None:
            out[name] = value
        else:
            out[name] = max(old, value) if name in GREATEST else old + value
    return out


def _plain(value):
    """Numbers and texts; times as text, whose order is the order of time."""
    if isinstance(value, dt.datetime):
        return value.astimezone(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%f") if value.tzinfo else value.isoformat(timespec="microseconds")
    return value


class Totals:
    """Totals per query under one folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self, query: str) -> list[int]:
        names = versions.children(self.spark, f"{self.path}/{query}")
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _file(self, query: str, batch: int) -> str:
        return f"{self.path}/{query}/{batch:012d}.json"

    def _last(self, query: str) -> tuple[int, dict]:
        """The last batch whose file is whole, and that file."""
        for batch in reversed(self._files(query)):
            found = versions.read_record(self.spark, self._file(query, batch))
            if found is not None:
                return batch, found
        return -1, {"before": {}, "totals": {}}

    def read(self, query: str) -> dict:
        return self._last(query)[1]["totals"]

    def add(self, query: str, batch: int, row: dict) -> dict:
        """Totals with a batch's metrics; the last batch again replaces its own, an older one changes nothing."""
        last, found = self._last(query)
        if batch < last:
            return found["totals"]
        before = found["before"] if batch == last else found["totals"]
        totals = _merged(before, {k: _plain(v) for k, v in row.items()})
        record = {"before": before, "totals": totals, "added_at": dt.datetime.now(dt.timezone.utc).isoformat()}
        versions.write_text(self.spark, self._file(query, batch), json.dumps(record), replace=True)
        # The file before stays: it counts if this one was not written to its end.
        for old in [f for f in self._files(query) if f < batch][:-1]:
            versions.remove(self.spark, self._file(query, old))
        return totals

    def queries(self) -> list[str]:
        return versions.children(self.spark, self.path)

    def table(self, names: list[str]) -> DataFrame:
        """One row per query: its id, its last batch, and the named totals (numbers)."""
        rows = []
        for query in self.queries():
            batch, found = self._last(query)
            rows.append((query, batch, *[found["totals"].get(n) for n in names]))
        fields = [T.StructField("query", T.StringType()), T.StructField("last_batch", T.LongType())]
        return self.spark.createDataFrame(rows, T.StructType(fields + [T.StructField(n, T.LongType()) for n in names]))


class RunningCounters(StreamingQueryListener):
    """Adds the metrics that queries observe under one name to their totals.

    Mark the stream with ``df.observe(name, ...)`` (or :func:`observe_windows`) and
    add the listener to ``spark.streams``.  A listener hears of a batch after its
    commit: what is between the two when the driver dies is not counted.  A job
    with its own ``foreachBatch`` calls :meth:`Totals.add` inside it instead,
    where a batch that is not counted is not committed either; both may be used
    together, since a batch counts once.
    """

    def __init__(self, totals: Totals, name: str) -> None:
        self.totals, self.name = totals, name
        self.started: dict[str, dt.datetime] = {}
        self.rows_per_second: dict[str, float] = {}
        self.failed: list[str] = []

    def onQueryStarted(self, event) -> None:
        self.started[str(event.id)] = dt.datetime.now(dt.timezone.utc)

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        query = str(progress.id)
        self.rows_per_second[query] = progress.processedRowsPerSecond
        row = progress.observedMetrics.get(self.name)
        if row is not None and progress.numInputRows:
            self.totals.add(query, progress.batchId, row.asDict())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception is not None:
            self.failed.append(str(event.id))
        self.started.pop(str(event.id), None)

    def uptime_seconds(self, query: str) -> float:
        """Seconds since the running query's start, 0 if it does not run."""
        begun = self.started.get(query)
        return 0.0 if begun is None else (dt.datetime.now(dt.timezone.utc) - begun).total_seconds()


def window_metrics(analysed: bool = False) -> list:
    """The detector's counters over scored windows (``total_connections, is_anomaly``, and ``analysed`` if asked for)."""
    on = F.coalesce(F.col("analysed"), F.lit(False)) if analysed else F.lit(True)
    bad = F.coalesce(F.col("is_anomaly"), F.lit(False))
    return [
        F.coalesce(F.sum("total_connections"), F.lit(0)).alias("logs_so_far"),
        F.count_if(on).alias("analysed_so_far"), F.count_if(on & ~bad).alias("normal_so_far"),
        F.count_if(on & bad).alias("detections_so_far"), F.count(F.lit(1)).alias("current_window_ips"),
    ]


def observe_windows(scored: DataFrame, name: str = "detector") -> DataFrame:
    """Let a stream of scored windows, some of them not analysed, report the detector's counters."""
    return scored.observe(name, *window_metrics(analysed=True))


def observe_fetches(rows: DataFrame, name: str = "fetches", ts: str = "@timestamp") -> DataFrame:
    """Let a stream report rows fetched in all, rows of the last batch and the newest time."""
    return rows.observe(name, F.count(F.lit(1)).alias("total_fetched"), F.count(F.lit(1)).alias("last_batch_size"),
                        F.max(F.col(f"`{ts}`")).alias("newest"))
