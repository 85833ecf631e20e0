"""What the text operators share: words, hashes of words, folders."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowwarden.plans.storage import materialize

__all__ = ["WORD", "materialize", "text_of", "word_count", "split_words", "hash_words", "NOT_WORD", "mix64", "grams", "checked_broadcast", "sealed"]

# A word is a run of anything but ASCII white space.  ``bytes.split()`` cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_ROWS = 200_000


def text_of(column: str) -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def word_count(column: Column) -> Column:
    return F.regexp_count(column, F.lit(WORD)).cast("long")


def checked_broadcast(small: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame | None:
    """A broadcast hint for a stored table of at most ``most`` rows; None beyond that."""
    return F.broadcast(small) if small.limit(most + 1).count() <= most else None


def sealed(docs: DataFrame, fresh: Iterable[str]) -> tuple[DataFrame, dict[str, str], list[str]]:
    """The table under inner names, the inner name of each column, and the columns that pass through.

    No column of the input can clash with one that an operator makes for itself.
    A column with the name of a result, in whatever case, is replaced by it.
    """
    inner = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    taken = {f.lower() for f in fresh}
    return docs.toDF(*[f"__c{i}" for i in range(len(docs.columns))]), inner, [c for c in docs.columns if c.lower() not in taken]


# --- vectorised hashes, inside tasks -------------------------------------------------
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0x9FB21C651E98DF25)
        return x ^ (x >> np.uint64(29))


def _byte_values() -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, 257, dtype=np.uint64)) * _SPREAD)


_BYTE = _byte_values()
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLOCK = 1 << 20
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> np.ndarray:
    """Powers of an odd multiplier, grown on demand up to one block of bytes."""
    if not _POWERS or len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 4096) - 1, _STEP)]))]
    return _POWERS[0][:n]


# For callers that also cut at ASCII punctuation.
NOT_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def split_words(raw: bytes, lower: bool = False, cut: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a text, where its words start and where they end."""
    data = np.frombuffer(raw, dtype=np.uint8)
    if lower:
        data = _LOWER[data]
    inside = np.concatenate([[False], ~cut[data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return data, edge[0::2], edge[1::2]


def hash_words(raw: bytes, lower: bool = False, cut: np.ndarray = _SPACE) -> np.ndarray:
    """A 64-bit hash of each word: sum of byte values times powers counted from the word's start."""
    data, start, end = split_words(raw, lower, cut)
    if not len(start):
        return np.zeros(0, np.uint64)
    length = end - start
    with np.errstate(over="ignore"):
        place = np.arange(len(data), dtype=np.int64) - np.repeat(
            np.concatenate([[0], start]), np.diff(np.concatenate([[0], start, [len(data)]])))
        longest = int(length.max())
        power = _powers(max(longest, 1))
        value = np.where(cut[data], np.uint64(0), _BYTE[data])
        value = value * power[np.minimum(place, longest - 1)]
        return mix64(np.add.reduceat(value, start) + length.astype(np.uint64) * _SPREAD)


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` word hashes, in text order."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = words[:n].copy()
        for k in range(1, size):
            out = mix64(out) + words[k:k + n]
        return mix64(out)
