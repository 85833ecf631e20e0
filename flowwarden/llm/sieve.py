"""Bit tables of hashes, built by Spark and small enough to broadcast."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwarden.llm.text import mix64

LEAST_BITS, MOST_BITS = 20, 30


_SALTS = [np.uint64(x) for x in (0xA5A5, 0x1B873593, 0xCC9E2D51, 0x85EBCA6B)]


def slots(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The four places of each hash."""
    return [mix64(hashes ^ salt) >> np.uint64(64 - bits) for salt in _SALTS]


def part_slots(hashes: np.ndarray, parts: np.ndarray, part_bits: int, bits: int) -> list[np.ndarray]:
    """The four places of each hash, all in the stretch of the table that belongs to its part."""
    return [(parts << np.uint64(bits - part_bits)) | at for at in slots(hashes, bits - part_bits)]


def hits(table: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in the table (all that are, and a few others)."""
    return held(table, slots(hashes, bits), len(hashes))


def held(table: np.ndarray, places: list[np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for at in places:
        out &= (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return out


def _slots(batches, bits: int):
    for batch in batches:
        for at in slots(batch.column(0).to_numpy().view(np.uint64), bits):
            yield pa.RecordBatch.from_arrays(
                [pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((at & np.uint64(63)).astype(np.int32))], ["place", "bit"])


def build(hashes: DataFrame) -> tuple[np.ndarray, int]:
    """The bit table of a stored one-column table of hashes, and the logarithm of its size.

    Four places in at least 24 bits per hash, and at most 2 ** 30 in all (128 MB):
    one wrong hit in 2,000 up to some 4 * 10 ** 7 hashes, more beyond.  Callers
    count exactly what passes, so a wrong hit costs time, never a result.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, (24 * hashes.count()).bit_length()))
    places = hashes.mapInArrow(partial(_slots, bits=bits), "place long, bit int")
    got = places.groupBy("place").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[got.column("place").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return table, bits


def _stretches(batches, part_bits: int, bits: int):
    for batch in batches:
        for part, hashes in zip(batch.column("part").to_pylist(), batch.column("held")):
            table = np.zeros(1 << (bits - part_bits - 6), np.uint64)
            for at in slots(np.frombuffer(hashes.as_py(), np.uint64), bits - part_bits):
                np.bitwise_or.at(table, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([table.tobytes()], pa.binary())], ["part", "table"])


def build_parts(stored: DataFrame, part_bits: int) -> tuple[np.ndarray, int]:
    """The bit table of a stored table (part, n, held: the n hashes of the part), as ``build`` makes it, and the logarithm of its size.

    A part has a stretch of the table for itself, so nothing is moved between tasks.
    """
    total = stored.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = min(MOST_BITS, max(LEAST_BITS, part_bits + 6, (24 * int(total)).bit_length()))
    table = np.zeros(1 << (bits - 6), np.uint64)
    size = len(table) >> part_bits
    for part, stretch in stored.mapInArrow(partial(_stretches, part_bits=part_bits, bits=bits), "part int, table binary").toLocalIterator():
        table[part * size:(part + 1) * size] = np.frombuffer(stretch, np.uint64)
    return table, bits
