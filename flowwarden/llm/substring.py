"""Repeated passages: windows counted exactly where their winnowed anchor repeats; maximal repeats are their unions."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwarden.llm import sieve
from flowwarden.llm.text import hash_words, materialize, mix64, text_of, sealed

WINDOW = 35
GRAM = 8
CHUNK_WORDS = 2_000_000


def _doubled(words: np.ndarray, size: int) -> dict[int, np.ndarray]:
    """Hashes of all runs of 1, 2, 4, ... words up to ``size``."""
    out, width = {1: words}, 1
    with np.errstate(over="ignore"):
        while width * 2 <= size:
            last = out[width]
            n = max(0, len(last) - width)
            width *= 2
            out[width] = mix64(mix64(last[:n]) + last[len(last) - n:] + np.uint64(width))
    return out


def _runs(parts: dict[int, np.ndarray], size: int, n_words: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words: two overlapping runs of a power of two."""
    n = max(0, n_words - size + 1)
    width = max(w for w in parts if w <= size)
    with np.errstate(over="ignore"):
        return mix64(mix64(parts[width][:n]) + parts[width][size - width:size - width + n] + np.uint64(size))


def _slide(values: np.ndarray, size: int, best=np.minimum) -> np.ndarray:
    """The least (or largest) of each ``size`` neighbours."""
    width, out = 1, values
    while width * 2 <= size:
        out = best(out[:-width], out[width:])
        width *= 2
    return best(out[:len(out) - (size - width)], out[size - width:]) if size > width else out


def seeds(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one text: the hash of each anchor, and for each window its anchor's hash and its own.

    The anchor of a window is the least of its gram hashes; equal windows have
    equal anchors at equal places.  Every gram that is the least of some window
    is an anchor once for its place.
    """
    empty = np.zeros(0, np.uint64)
    if len(words) < window:
        return empty, empty, empty
    parts = _doubled(words, window)
    grams = _runs(parts, gram, len(words))
    span = window - gram + 1
    least = _slide(grams, span)
    pad = np.zeros(span - 1, np.uint64)
    most = _slide(np.concatenate([pad, least, pad]), span, np.maximum)
    return grams[most == grams], least, _runs(parts, window, len(words))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _texts(batches, text_col: str):
    for batch in batches:
        for i, text in enumerate(batch.column(text_col)):
            yield batch, i, text.as_py()


def _anchors(batches, text_col: str, window: int, gram: int):
    """Anchor hashes with their counts, summed within chunks of the partition."""
    held, size = [], 0

    def flush():
        value, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([_signed(value), pa.array(np.minimum(n, 2).astype(np.int32))], ["anchor", "n"])

    for _, _, text in _texts(batches, text_col):
        found = seeds(hash_words(text.encode("utf-8")), window, gram)[0]
        held.append(found)
        size += len(found)
        if size >= CHUNK_WORDS:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def anchor_filter(docs: DataFrame, text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, int]:
    """Which anchors occur more than once in the table, as a bit table, and the logarithm of its size.

    Anchors are counted exactly, over all rows.  A wrong hit only lets further
    windows through to their exact count, so the table's size never changes a result.
    """
    found = docs.select(text_of(text_col).alias("text")).mapInArrow(
        partial(_anchors, text_col="text", window=window, gram=gram), "anchor long, n int")
    repeated = materialize(found.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"), "anchors")
    return sieve.build(repeated)


def _candidates(batches, shared, bits: int, window: int, gram: int):
    """Windows with a repeated anchor, summed within chunks of the partition.

    ``n`` is 1 for a window seen once in the chunk, with its place, and 2 for
    one seen more often, without.  The places of the latter are repeats already;
    they come as merged ranges.
    """
    table = shared.value
    ids: list = []
    marks: list[int] = []
    wins, docs, places, size, kind = [], [], [], 0, None

    def flush():
        win, doc, place = np.concatenate(wins), np.concatenate(docs), np.concatenate(places)
        value, first, inverse, count = np.unique(win, return_index=True, return_inverse=True, return_counts=True)
        alone = np.sort(first[count == 1])
        many = value[count > 1]
        again = np.flatnonzero(count[inverse] > 1)
        d, p = doc[again], place[again]
        new = np.concatenate([[True], (d[1:] != d[:-1]) | (p[1:] > p[:-1] + window)]) if len(again) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        end = np.concatenate([begin[1:], [len(again)]])[:len(begin)] - 1
        owner = np.concatenate([doc[alone], np.full(len(many), -1), d[begin]]).astype(np.int64)
        known = owner >= 0
        id_of = pa.array(ids, kind).take(pa.array(np.where(known, owner, 0), mask=~known))
        h_of = pa.array(np.where(known, np.array(marks, np.int64)[np.maximum(owner, 0)], 0).astype(np.int64))
        n_rows = len(owner)
        ranges = np.arange(n_rows) >= len(alone) + len(many)
        return pa.RecordBatch.from_arrays([
            pa.array(ranges), _signed(np.concatenate([win[alone], many, mix64(np.arange(len(begin), dtype=np.uint64))])),
            pa.array(np.where(np.arange(n_rows) < len(alone), 1, 2).astype(np.int32)), id_of, h_of,
            pa.array(np.concatenate([place[alone], np.full(len(many), -1), p[begin]]).astype(np.int32)),
            pa.array(np.concatenate([place[alone] + window, np.full(len(many), -1), p[end] + window]).astype(np.int32)),
        ], ["merged", "win", "n", "id", "h", "start", "stop"])

    for batch in batches:
        kind = batch.schema.field("id").type
        for i, text in enumerate(batch.column("text")):
            _, least, own = seeds(hash_words(text.as_py().encode("utf-8")), window, gram)
            hit = np.flatnonzero(sieve.hits(table, bits, least))
            if len(hit):
                wins.append(own[hit])
                docs.append(np.full(len(hit), len(ids)))
                places.append(hit)
                ids.append(batch.column("id")[i].as_py())
                marks.append(batch.column("h")[i].as_py())
                size += len(hit)
                if size >= CHUNK_WORDS:
                    yield flush()
                    ids, marks, wins, docs, places, size = [], [], [], [], [], 0
    if size:
        yield flush()


def _removed(batches, text_col: str, keep: list[str]):
    for batch in batches:
        kept, n_words, n_removed = [], [], []
        for text, ranges in zip(batch.column(text_col), batch.column("__ranges")):
            words = (text.as_py() or "").encode("utf-8").split()
            gone = 0
            if ranges.is_valid and len(ranges):
                step = np.zeros(len(words) + 1, np.int64)
                spans = ranges.values
                np.add.at(step, np.minimum(spans.field("start").to_numpy(), len(words)), 1)
                np.add.at(step, np.minimum(spans.field("stop").to_numpy(), len(words)), -1)
                stays = np.cumsum(step[:-1]) == 0
                n_words.append(len(words))
                words = [words[i] for i in np.flatnonzero(stays)]
                gone = int(len(stays) - len(words))
            else:
                n_words.append(len(words))
            n_removed.append(gone)
            kept.append(b" ".join(words).decode("utf-8"))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in keep), pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())],
            [*keep, "kept_text", "n_words", "n_removed"])


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Maximal repeats: (id, h, ranges) for every text that holds a window which starts anywhere else too.

    ``h`` is a hash of the text; ``ranges`` are [start, stop) of words.  Windows
    are joined on their hashes.  A window common to many texts reaches the join
    once per chunk of a task, not once per place.
    """
    table, bits = anchor_filter(docs, text_col, window, gram)
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(table)
    work = partial(_candidates, shared=shared, bits=bits, window=window, gram=gram)
    windows = rows.mapInArrow(lambda b: work(b), f"merged boolean, win long, n int, id {kind}, h long, start int, stop int")
    counted = windows.withColumn("all", F.expr("sum(n) over (partition by merged, win)"))
    return (counted.where((F.col("all") > 1) & (F.col("start") >= 0))
            .groupBy("id", "h").agg(F.collect_list(F.struct("start", "stop")).alias("ranges")))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The input rows with ``kept_text``, ``n_words``, ``n_removed``.

    Removes every word covered by a window of ``window`` words whose sequence
    also starts anywhere else in the table, in the same text included.  Words
    are runs of anything but ASCII white space, unchanged; the kept ones are
    joined by one space.  All windows are judged on the input.

    Null text has no words.  Texts shorter than a window keep all words.
    Repeated rows repeat each other's windows, so both lose them.  Rows with equal
    id are told apart by a hash of the text.  An empty table gives no rows; other
    columns pass through (the result names are replaced).
    """
    docs, inner, keep = sealed(docs, ("kept_text", "n_words", "n_removed"))
    names = [inner[c] for c in keep]
    found = repeats(docs, inner[id_col], inner[text_col], window, gram)
    rows = docs.select(*names, F.xxhash64(text_of(inner[text_col])).alias("__h"))
    joined = rows.join(found, rows[inner[id_col]].eqNullSafe(found["id"]) & (rows["__h"] == found["h"]), "left")
    joined = joined.select(*names, F.col("ranges").alias("__ranges"))
    schema = ", ".join([*(f"{n} {docs.schema[n].dataType.simpleString()}" for n in names), "kept_text string", "n_words long", "n_removed long"])
    done = joined.mapInArrow(partial(_removed, text_col=inner[text_col], keep=names), schema)
    return done.toDF(*keep, "kept_text", "n_words", "n_removed")
