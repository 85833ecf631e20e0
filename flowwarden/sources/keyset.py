"""A table of Parquet files as a stream that goes on after the last (time, id).

The offset is the key of the last row read, so a restart neither loses nor
repeats rows, rows of one time included.  A batch is planned from the files'
statistics: row groups outside its range of keys are not opened, the others are
dealt to tasks.  No row passes through the driver.

    spark.dataSource.register(KeysetSource)
    spark.readStream.format("keyset").schema(schema).option("path", p).load()
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

EARLIEST = {"ts": None, "id": None}
TASKS = 32
TIME = pa.timestamp("us")


@dataclass
class Groups(InputPartition):
    """Row groups of some files, and the keys wanted of them."""

    parts: list[tuple[str, int]]
    start: dict
    end: dict

    def __post_init__(self) -> None:
        super().__init__(self.parts)


@dataclass(frozen=True)
class Group:
    """A row group and the range of its times (microseconds)."""

    file: str
    number: int
    rows: int
    first: int | None
    last: int | None


def _files(path: str) -> tuple[pafs.FileSystem, list[str]]:
    fs, root = (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)
    selector = pafs.FileSelector(root, recursive=True, allow_not_found=True)
    files = [f.path for f in fs.get_file_info(selector) if f.type == pafs.FileType.File and f.path.endswith(".parquet")]
    hidden = lambda name: any(part.startswith(("_", ".")) and "=" not in part for part in name[len(root):].split("/"))
    return fs, sorted(f for f in files if not hidden(f))


def _micros(times: pa.ChunkedArray) -> pa.ChunkedArray:
    kind = pa.timestamp("us", times.type.tz) if pa.types.is_timestamp(times.type) else TIME
    return times.cast(kind, safe=False).cast(pa.int64())


def _beyond(times: pa.ChunkedArray, keys: pa.ChunkedArray, bound: dict) -> pa.ChunkedArray:
    """Which rows come after a key; a row without a key comes before all others of its time."""
    if bound["ts"] is None:
        return pc.is_valid(times)
    later = pc.greater(times, bound["ts"])
    if bound["id"] is None:
        return pc.fill_null(pc.or_kleene(later, pc.and_kleene(pc.equal(times, bound["ts"]), pc.is_valid(keys))), False)
    tie = pc.and_kleene(pc.equal(times, bound["ts"]), pc.greater(keys, bound["id"]))
    return pc.fill_null(pc.or_kleene(later, tie), False)


class KeysetReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema, self.path = schema, options["path"]
        self.ts, self.key = options.get("ts", "@timestamp"), options.get("key", "event_id")
        self.tasks = int(options.get("tasks", TASKS))
        self.first = {"ts": int(options["start_ts"]) if "start_ts" in options else None,
                      "id": int(options["start_id"]) if "start_id" in options else None}
        self._known: dict[str, list[Group]] = {}

    def initialOffset(self) -> dict:
        return dict(self.first)

    def _groups(self) -> list[Group]:
        """Row groups of all files; a file is looked at once, since files do not change."""
        fs, files = _files(self.path)
        known = {}
        for name in files:
            known[name] = self._known.get(name) or self._look(fs, name)
        self._known = known
        return [g for groups in known.values() for g in groups]

    def _look(self, fs: pafs.FileSystem, name: str) -> list[Group]:
        file = pq.ParquetFile(name, filesystem=fs)
        column = file.schema_arrow.get_field_index(self.ts)
        place = next(i for i in range(file.metadata.num_columns) if file.metadata.schema.column(i).path == self.ts)
        out = []
        for number in range(file.metadata.num_row_groups):
            group = file.metadata.row_group(number)
            kind = file.schema_arrow.field(column).type
            column_chunk = group.column(place)
            stats = column_chunk.statistics if column_chunk.physical_type == "INT64" and pa.types.is_timestamp(kind) else None
            if stats is not None and stats.has_min_max:
                ends = pa.chunked_array([pa.array([stats.min, stats.max], kind)])
            else:
                # Old time formats have no statistics: the time column itself tells.
                ends = file.read_row_group(number, [self.ts])[self.ts]
            found = pc.min_max(_micros(ends)).as_py()
            out.append(Group(name, number, group.num_rows, found["min"], found["max"]))
        return out

    def latestOffset(self) -> dict:
        """The greatest key; only row groups that reach the greatest time are read."""
        groups = [g for g in self._groups() if g.last is not None]
        if not groups:
            return dict(self.first)
        last = max(g.last for g in groups)
        fs, _ = _files(self.path)
        most = None
        for g in groups:
            if g.last == last:
                table = pq.ParquetFile(g.file, filesystem=fs).read_row_group(g.number, [self.ts, self.key])
                found = pc.max(table[self.key].filter(pc.equal(_micros(table[self.ts]), last))).as_py()
                most = found if most is None or (found is not None and found > most) else most
        newest = {"ts": last, "id": most}
        return newest if self._after(newest, self.first) else dict(self.first)

    @staticmethod
    def _after(a: dict, b: dict) -> bool:
        if b["ts"] is None or a["ts"] is None:
            return a["ts"] is not None
        return (a["ts"], a["id"] if a["id"] is not None else -(2**63)) > (b["ts"], b["id"] if b["id"] is not None else -(2**63))

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        if end["ts"] is None or start == end:
            return []
        groups = [g for g in self._groups() if g.last is not None
                  and (start["ts"] is None or g.last >= start["ts"]) and g.first <= end["ts"]]
        # Largest first to the task with the fewest rows.
        dealt: list[list] = [[0, []] for _ in range(min(self.tasks, len(groups)))]
        for g in sorted(groups, key=lambda g: -g.rows):
            least = min(dealt, key=lambda d: d[0])
            least[0] += g.rows
            least[1].append((g.file, g.number))
        return [Groups(parts, start, end) for _, parts in dealt]

    def read(self, partition: Groups) -> Iterator[pa.RecordBatch]:
        fs, _ = (pafs.LocalFileSystem(), "") if self.path.startswith("/") else pafs.FileSystem.from_uri(self.path)
        wanted = to_arrow_schema(self.schema)
        names = wanted.names
        for name, number in partition.parts:
            file = pq.ParquetFile(name, filesystem=fs)
            for batch in file.iter_batches(row_groups=[number], columns=list(dict.fromkeys([*names, self.ts, self.key]))):
                table = pa.Table.from_batches([batch])
                times, keys = _micros(table[self.ts]), table[self.key]
                keep = _beyond(times, keys, partition.start)
                keep = pc.and_(keep, pc.invert(_beyond(times, keys, partition.end)))
                table = table.filter(pc.and_(keep, pc.is_valid(times))).select(names)
                yield from table.cast(wanted, safe=False).to_batches()

    def commit(self, end: dict) -> None:
        pass


class KeysetSource(DataSource):
    """Options: ``path``; ``ts`` and ``key``, the columns of the offset; ``tasks`` at most per
    batch; ``start_ts`` (microseconds) and ``start_id``, the key to begin after.

    The key column is whole numbers.  A row without a time is never reached, nor is one
    that arrives with a key before the offset, as with ``fetch_after``; a row
    without a key comes before the others of its time.  The schema must be given.
    """

    @classmethod
    def name(cls) -> str:
        return "keyset"

    def schema(self):
        raise ValueError("give the schema of the table")

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return KeysetReader(schema, dict(self.options))
