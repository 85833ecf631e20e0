"""Folders with numbered versions, of which the newest committed one counts.

Data is written first, to a folder of its own; then a small record that names
it is created under the next number.  Creating fails if another writer took the
number, so one of two writers wins, and a record that was not written to its
end is no record.  Names that begin with an underscore are skipped when Spark
lists a folder, so records may lie inside a table's folder.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

RECORDS = "_versions"


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def children(spark: SparkSession, folder: str, hidden: bool = False) -> list[str]:
    """Names in a folder, none if there is no such folder."""
    place, fs = _at(spark, folder)
    if not fs.exists(place):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(place)]
    return sorted(n for n in names if hidden or not n.startswith(("_", ".")))


def remove(spark: SparkSession, path: str) -> None:
    place, fs = _at(spark, path)
    fs.delete(place, True)


def write_text(spark: SparkSession, path: str, text: str, replace: bool = False) -> bool:
    """Write a small file; False if it is there already and may not be replaced."""
    place, fs = _at(spark, path)
    if not replace and fs.exists(place):
        return False
    try:
        out = fs.create(place, replace)
    except Exception:
        # Someone else created it since.
        if not replace and fs.exists(place):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def read_record(spark: SparkSession, path: str) -> dict | None:
    """A record, None where it is missing or was not written to its end."""
    place, fs = _at(spark, path)
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    try:
        found = json.loads(text)
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def numbers(spark: SparkSession, path: str) -> list[int]:
    names = children(spark, f"{path}/{RECORDS}")
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def record_path(path: str, number: int) -> str:
    return f"{path}/{RECORDS}/{number:012d}.json"


def current(spark: SparkSession, path: str) -> tuple[int, dict] | None:
    """Number and record of the newest committed version."""
    for number in reversed(numbers(spark, path)):
        record = read_record(spark, record_path(path, number))
        if record is not None:
            return number, record
    return None


def next_number(spark: SparkSession, path: str) -> int:
    return max(numbers(spark, path), default=0) + 1


def commit(spark: SparkSession, path: str, number: int, record: dict) -> bool:
    """Make a version current; False if another writer has that number."""
    return write_text(spark, record_path(path, number), json.dumps(record))


def forget_before(spark: SparkSession, path: str, number: int) -> None:
    """Remove the records of versions before ``number``."""
    for n in numbers(spark, path):
        if n < number:
            remove(spark, record_path(path, n))
