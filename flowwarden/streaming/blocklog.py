"""The block log as a snapshot and the changes since, for streams that run for years.

Every batch adds a folder of events.  Folding them all for each batch would cost
more with every batch, so closed folders are merged into a snapshot now and
then: the newest event of every address.  A reader takes the newest snapshot and
the folders after it.

What makes this safe: merging an event twice changes nothing; a folder is
removed one version after the snapshot that holds it was committed; and a reader
lists the folders before it looks for the snapshot, so that what it does not
list is in the snapshot it finds.  The last folder of every stream is never
merged, since its batch may be retried.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowwarden import schema as S
from flowwarden.operators.blocklist import DETAILS
from flowwarden.plans import versions

# Events by hand have no origin; a stream's events carry its query id and batch number.
BLOCK_LOG_SCHEMA = T.StructType([
    *S.block_event_schema().fields, T.StructField("origin", T.StringType()), T.StructField("batch", T.LongType())])
SNAPSHOTS = "_snapshots"
BATCH_FOLDER = re.compile(r"(.+)-([0-9]+)")
COMPACT_EVERY = 50


def newest_events(events: DataFrame) -> DataFrame:
    """The newest event of every address; an unblock wins a tie, as in ``current_blocks``."""
    ip = F.trim("ip")
    newest = events.filter(ip != "").groupBy(ip.alias("ip")).agg(
        F.max(F.struct("event_at", "action", *DETAILS, "origin", "batch")).alias("e"))
    return newest.select(*[F.col("ip") if c == "ip" else F.col(f"e.{c}").alias(c) for c in BLOCK_LOG_SCHEMA.names])


class BlockLog:
    """Block and unblock events under one folder.

    Files and folders in it are changes, whoever wrote them: ``append_events``
    by hand, or a stream one folder per batch, named by query id and batch.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], BLOCK_LOG_SCHEMA)
        reader = self.spark.read.schema(BLOCK_LOG_SCHEMA).option("recursiveFileLookup", "true")
        return reader.parquet(*[f"{self.path}/{n}" for n in names])

    def _parts(self) -> tuple[int, dict, list[str]]:
        """Version, its record, and the changes it does not hold."""
        changes = versions.children(self.spark, self.path)
        number, record = versions.current(self.spark, self.path) or (0, {"snapshot": None, "merged": []})
        held = set(record["merged"])
        return number, record, [c for c in changes if c not in held]

    def history(self) -> DataFrame:
        """Events that are not merged yet, and the newest one of each address from the snapshot."""
        _, record, changes = self._parts()
        return self._read([*([record["snapshot"]] if record["snapshot"] else []), *changes])

    def events(self, origin: str | None = None, before: int | None = None) -> DataFrame:
        """The newest event of every address.

        With an origin, its events from batch ``before`` on are left out: a retried
        batch must not see what its first attempt wrote.
        """
        rows = self.history()
        if origin is not None:
            own = (F.col("origin") == origin) & (F.col("batch") >= before)
            rows = rows.filter(~F.coalesce(own, F.lit(False)))
        return newest_events(rows)

    def write_batch(self, events: DataFrame, origin: str, number: int) -> DataFrame:
        """Write the events of a batch and return them as stored; a retry replaces them."""
        stamped = events.withColumns({"origin": F.lit(origin), "batch": F.lit(number).cast("long")})
        stamped.hint("rebalance").write.mode("overwrite").parquet(f"{self.path}/{origin}-{number}")
        return self._read([f"{origin}-{number}"])

    def _closed(self, changes: list[str]) -> list[str]:
        """All changes but the last folder of every stream."""
        last: dict[str, int] = {}
        batches = {c: m for c in changes if (m := BATCH_FOLDER.fullmatch(c))}
        for m in batches.values():
            last[m[1]] = max(last.get(m[1], -1), int(m[2]))
        return [c for c in changes if c not in batches or int(batches[c][2]) < last[batches[c][1]]]

    def compact(self, least: int = COMPACT_EVERY) -> bool:
        """Merge closed changes into a new snapshot if there are at least ``least``.

        May be ended at any point, and run by several at once: until the record is
        committed nothing has changed, after it what was merged before is removed.
        """
        number, record, changes = self._parts()
        closed = self._closed(changes)
        if len(closed) < max(least, 1):
            return False
        old = record["snapshot"]
        following = versions.next_number(self.spark, self.path)
        snapshot = f"{SNAPSHOTS}/{following:012d}-{uuid.uuid4().hex}"
        merged = newest_events(self._read([*([old] if old else []), *closed]))
        merged.hint("rebalance").write.parquet(f"{self.path}/{snapshot}")
        if not versions.commit(self.spark, self.path, following, {"snapshot": snapshot, "merged": closed}):
            versions.remove(self.spark, f"{self.path}/{snapshot}")
            return False
        self._clean(record, following, number)
        return True

    def _clean(self, before: dict, number: int, previous: int) -> None:
        """Remove what the version before already held, and snapshots that no version can name any more."""
        for name in before["merged"]:
            versions.remove(self.spark, f"{self.path}/{name}")
        for name in versions.children(self.spark, f"{self.path}/{SNAPSHOTS}"):
            if int(name.split("-")[0]) < number and f"{SNAPSHOTS}/{name}" != before["snapshot"]:
                versions.remove(self.spark, f"{self.path}/{SNAPSHOTS}/{name}")
        versions.forget_before(self.spark, self.path, previous)
