"""Hard negatives by Kronecker-packed integer products.

Scores are inner products of integer vectors.  Components of several candidates
are made non-negative by a bias and put into separate fields of one wide
integer, so one multiplication by an anchor's component serves all of them.
After the sum over components each field holds one candidate's exact score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowwarden.llm.text import materialize
from flowwarden.llm.vectors import finite, floors, matrix

SCALE = 256
# Rows of a block of candidates and of anchors: some 20 MB of components each.
CANDIDATES, ANCHORS = 32_768, 16_384
# Positives are searched inside one of these groups of labels, so blocks of all rows may be larger there.
LABEL_GROUPS = 16
# Scores held at once.
CELLS = 1 << 22
# A double holds every integer of this many bits, so such products can be left to the matrix routines.
DOUBLE_BITS = 52
# Candidates in one integer where fields are wider than that.
WIDE_FIELDS = 64
LEAST, MOST = -(2**63) + 2, 2**63 - 1


def packed_scores(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products of all rows with all rows, exact; beyond a long's range the end of the range stands."""
    width = max(anchors.shape[1], candidates.shape[1])
    anchors, candidates = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (anchors, candidates))
    if not anchors.size or not candidates.size:
        return np.zeros((len(anchors), len(candidates)), np.int64)
    bias = -min(int(candidates.min()), 0)
    top = int(candidates.max()) + bias
    # No field, nor any sum on the way to it, is beyond this on either side.
    most = max(int(np.abs(anchors.astype(object)).sum(axis=1).max()), 1) * max(top, 1)
    bits = (2 * most + 1).bit_length()
    if bits > DOUBLE_BITS:
        return _wide_scores(anchors.astype(object), candidates.astype(object) + bias, bias, most, bits)
    fields = DOUBLE_BITS // bits
    rows = -(-len(candidates) // fields)
    biased = np.zeros((rows * fields, width), np.int64)
    biased[:len(candidates)] = candidates + bias
    shifts = bits * np.arange(fields)
    # Field f of integer r is candidate r * fields + f.
    packed = (biased.reshape(rows, fields, width) << shifts[None, :, None]).sum(axis=1)
    sums = (anchors.astype(np.float64) @ packed.T.astype(np.float64)).astype(np.int64)
    sums += int((most << shifts.astype(object)).sum())
    unpacked = (sums[:, :, None] >> shifts) & ((1 << bits) - 1)
    scores = unpacked.reshape(len(anchors), rows * fields)[:, :len(candidates)]
    scores -= most + bias * anchors.sum(axis=1)[:, None]
    return scores


def _wide_scores(anchors: np.ndarray, biased: np.ndarray, bias: int, most: int, bits: int) -> np.ndarray:
    """The same with integers of any length."""
    out = np.empty((len(anchors), len(biased)), np.int64)
    mask, back = (1 << bits) - 1, [bias * int(a) for a in anchors.sum(axis=1)]
    for start in range(0, len(biased), WIDE_FIELDS):
        block = biased[start:start + WIDE_FIELDS]
        shifts = np.array([bits * f for f in range(len(block))], dtype=object)
        packed = (block * (1 << shifts)[:, None]).sum(axis=0) if len(block) else []
        raised = sum(most << int(s) for s in shifts)
        for i, anchor in enumerate(anchors):
            total = int((anchor * packed).sum()) + raised
            for f, s in enumerate(shifts):
                out[i, start + f] = min(max(((total >> s) & mask) - most - back[i], LEAST), MOST)
    return out


def _chunks(anchors: np.ndarray, candidates: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    step = max(1, CELLS // max(1, len(candidates)))
    for start in range(0, len(anchors), step):
        part = slice(start, start + step)
        yield part, packed_scores(anchors[part], candidates)


def _first(rows: np.ndarray, count: int) -> np.ndarray:
    """Which entries are among the first ``count`` of their row; rows are in order."""
    return np.arange(len(rows)) - np.searchsorted(rows, rows) < count


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table[n].to_numpy() for n in names]


POSITIVE = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])
NEGATIVE = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("negative_id", pa.int64()),
                      ("positive_score", pa.int64()), ("negative_score", pa.int64())])


def _best_positives(count: int):
    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return POSITIVE.empty_table()
        right = right.sort_by("vec_id")
        (ids, labels), (other, theirs) = _columns(left, "vec_id", "label"), _columns(right, "vec_id", "label")
        anchors, candidates = matrix(left["x"]), matrix(right["x"])
        found = []
        for part, scores in _chunks(anchors, candidates):
            fits = (labels[part][:, None] == theirs) & (ids[part][:, None] != other)
            scores[~fits] = LEAST - 1
            place = max(0, len(other) - count)
            least = np.partition(scores, place, axis=1)[:, place]
            row, col = np.nonzero(fits & (scores >= least[:, None]))
            order = np.lexsort((col, -scores[row, col], row))
            row, col = row[order], col[order]
            keep = _first(row, count)
            found.append([ids[part][row[keep]], other[col[keep]], scores[row[keep], col[keep]]])
        return pa.table([np.concatenate(c) for c in zip(*found)], schema=POSITIVE)
    return best


def _best_negatives(count: int, low: int, high: int):
    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return NEGATIVE.empty_table()
        right = right.sort_by("vec_id")
        (ids, labels), (other, theirs) = _columns(left, "vec_id", "label"), _columns(right, "vec_id", "label")
        anchors, candidates = matrix(left["x"]), matrix(right["x"])
        lists = [left[n].to_pylist() for n in ("positive_ids", "positive_scores")]
        slots = max(len(p) for p in lists[0])
        # Bounds of each anchor's positives; an empty range where a slot is not used.
        wanted, scored = np.zeros((2, len(ids), slots), np.int64)
        floor, ceiling = np.full((len(ids), slots), MOST), np.full((len(ids), slots), LEAST - 1)
        for i, (p, s) in enumerate(zip(*lists)):
            for j in range(len(p)):
                wanted[i, j], scored[i, j] = p[j], s[j]
                lowest, highest = -(-low * s[j] // 100), high * s[j] // 100
                if lowest <= highest and lowest <= MOST and highest >= LEAST:
                    floor[i, j], ceiling[i, j] = max(lowest, LEAST), min(highest, MOST)
        found = []
        for part, scores in _chunks(anchors, candidates):
            lows, highs = floor[part], ceiling[part]
            fits = (labels[part][:, None] != theirs) & (scores >= lows.min(axis=1)[:, None]) & (scores <= highs.max(axis=1)[:, None])
            row, col = np.nonzero(fits)
            score = scores[row, col]
            order = np.lexsort((col, -score, row))
            row, col, score = row[order], col[order], score[order]
            for j in range(slots):
                at = np.flatnonzero((score >= lows[row, j]) & (score <= highs[row, j]))
                at = at[_first(row[at], count)]
                found.append([ids[part][row[at]], wanted[part][row[at], j], other[col[at]], scored[part][row[at], j], score[at]])
        return pa.table([np.concatenate(c) for c in zip(*found)], schema=NEGATIVE)
    return best


def hard_negatives(vectors: DataFrame, anchor: Column, label: Column | None = None, id_col: str = "vec_id",
                   vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 5,
                   low: int = 80, high: int = 100, scale: int = SCALE, candidates_per_block: int = CANDIDATES,
                   anchors_per_block: int = ANCHORS) -> DataFrame:
    """The first negatives of each anchor and each of its positives.

    A score is the inner product of ``floor(scale * v)`` of two vectors; higher
    scores come first, ties by smaller id.  Positives are an anchor's first
    ``positives`` other rows of its label.  Negatives are the first rows of
    another label whose score is ``low`` to ``high`` percent of the positive's.
    ``anchor`` says which rows are anchors and ``label`` may replace the label;
    both are columns of the input.

    Anchors and candidates are dealt to blocks by hashes of their ids, and every
    pair of blocks is one group of a cogroup: a task holds one block of each and
    returns the best few per anchor, whatever the labels' sizes.  The best of
    all blocks are then ranked.  Positives come first, since they bound the negatives.

    Rows without id or label, with a null vector, or with a null or non-finite
    entry take no part.  Repeated rows of one id are one row, the one with the
    smallest label and vector.  Vectors of different lengths count as filled with
    zeros.  A score beyond a long's range counts as the end of that range.
    Fewer positives or negatives than asked give fewer rows; anchors without give none,
    and so does an empty table.  Other columns are ignored.
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), (F.col(label_col) if label is None else label).cast("long").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector_col).alias("v"),
    ).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("v")))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", floors(F.col("v"), scale).alias("x"), "anchor")).alias("r"))
    rows = materialize(rows.select("vec_id", "r.label", "r.x", "r.anchor"), "vectors")
    anchors = materialize(rows.where("anchor").drop("anchor"), "anchors")
    total, chosen = rows.count(), anchors.count()
    spread = lambda parts: F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    anchor_blocks = max(1, -(-chosen // anchors_per_block))

    blocks = max(1, -(-total // (candidates_per_block * 4)))
    inside = F.pmod(F.xxhash64("label"), F.lit(LABEL_GROUPS)).cast("int").alias("g")
    key = ["g", "a", "c"]
    mine = anchors.select("vec_id", "label", "x", inside, spread(anchor_blocks).alias("a"), each(blocks).alias("c"))
    theirs = rows.select("vec_id", "label", "x", inside, spread(blocks).alias("c"), each(anchor_blocks).alias("a"))
    near = mine.groupBy(*key).cogroup(theirs.groupBy(*key)).applyInArrow(
        _best_positives(positives), "anchor_id long, positive_id long, positive_score long")
    first = W.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= positives)
    known = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("p"))
    known = materialize(known.select("anchor_id", F.col("p.positive_id").alias("positive_ids"),
                                     F.col("p.positive_score").alias("positive_scores")), "positives")

    blocks = max(1, -(-total // candidates_per_block))
    key = ["a", "c"]
    mine = anchors.join(known, F.col("vec_id") == F.col("anchor_id")).select(
        "vec_id", "label", "x", "positive_ids", "positive_scores", spread(anchor_blocks).alias("a"), each(blocks).alias("c"))
    theirs = rows.select("vec_id", "label", "x", spread(blocks).alias("c"), each(anchor_blocks).alias("a"))
    found = mine.groupBy(*key).cogroup(theirs.groupBy(*key)).applyInArrow(
        _best_negatives(negatives, low, high),
        "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    first = W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
