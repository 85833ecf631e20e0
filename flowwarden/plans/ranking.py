"""Exact running sums and quantiles over data of any size.

A window without a partition key would put every row into one task.  Here the
rows are range-partitioned by the sort column into parts of about the same size,
however many that takes; sums run inside each part and the totals of the parts
before it are added.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowwarden.plans.storage import materialize

ROWS_PER_PART = 200_000
SMALL_DOMAIN = 100_000
SKETCH = 10_000
# A search that sketches do not narrow in so many rounds is done by running sums.
MOST_ROUNDS = 8


def running_sums(df: DataFrame, order: str, sums: dict[str, str], rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Add, for each ``{output: input}``, the sum of the input up to and including the row.

    ``order`` must be unique per row (aggregate first), so a value that is very
    frequent is one row here.  The parts are stored with their number, so that
    a recomputed task cannot cut them elsewhere.
    """
    stored = materialize(df, "unranked")
    parts = max(1, -(-stored.count() // rows_per_part))
    marked = materialize(stored.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()), "ranked")
    inner = W.partitionBy("_part").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    local = marked.withColumns({out: F.sum(col).over(inner) for out, col in sums.items()})
    # One row per part from here on.
    totals = marked.groupBy("_part").agg(*[F.sum(col).alias(f"_{out}") for out, col in sums.items()])
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("_part").alias("_at_part"),
        *[F.coalesce(F.sum(f"_{out}").over(before), F.lit(0)).alias(f"_{out}") for out in sums])
    joined = local.join(F.broadcast(offsets), F.col("_part") == F.col("_at_part"))
    return joined.withColumns({out: F.col(out) + F.col(f"_{out}") for out in sums}).drop(
        "_part", "_at_part", *[f"_{out}" for out in sums])


def sorted_places(df: DataFrame, column: str, out: str, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Place of each distinct value in sorted order, from 0."""
    ranked = running_sums(df.withColumn("_one", F.lit(1)), column, {out: "_one"}, rows_per_part)
    return ranked.withColumn(out, F.col(out) - 1).drop("_one")


def _by_running_sums(df: DataFrame, ranks: list[int]) -> list[float]:
    """The values at some ranks, from the counts per value and their running sums."""
    counts = df.groupBy("v").agg(F.count("*").alias("n"))
    row = running_sums(counts, "v", {"upto": "n"}).agg(*[
        F.min(F.when(F.col("upto") > r, F.col("v"))).alias(f"r{i}") for i, r in enumerate(ranks)]).first()
    return [row[f"r{i}"] for i in range(len(ranks))]


@dataclass(eq=False)
class _Search:
    """Ranks wanted of one column, and the open interval their values lie in."""

    column: str
    ranks: list[int]
    low: float
    high: float
    below: int = 0
    inside: int = 0
    rounds: int = 0
    found: dict[int, float] = field(default_factory=dict)

    def missing(self) -> list[int]:
        return [r for r in self.ranks if r not in self.found]

    def value(self) -> Column:
        return F.col(f"`{self.column}`").cast("double")

    def between(self) -> Column:
        """The value where it lies strictly inside."""
        return F.when((self.value() > self.low) & (self.value() < self.high), self.value())


def _count_around(df: DataFrame, searches: list[_Search]) -> list[_Search]:
    """One pass: place the ends of every interval, and with them the ranks that fall on an end.

    Returns the searches whose interval misses a wanted rank.
    """
    counts = []
    for i, s in enumerate(searches):
        v = s.value()
        counts += [F.count(F.when(v < s.low, 1)).alias(f"b{i}"), F.count(F.when(v == s.low, 1)).alias(f"l{i}"),
                   F.count(s.between()).alias(f"i{i}"), F.count(F.when(v == s.high, 1)).alias(f"h{i}")]
    row = df.agg(*counts).first()
    lost = []
    for i, s in enumerate(searches):
        start = row[f"b{i}"]
        s.below, s.inside = start + row[f"l{i}"], row[f"i{i}"]
        # With equal ends the same rows were counted as both.
        end = s.below + s.inside + (row[f"h{i}"] if s.high != s.low else 0)
        for r in s.missing():
            if start <= r < s.below:
                s.found[r] = s.low
            elif s.below + s.inside <= r < end:
                s.found[r] = s.high
            elif not start <= r < end:
                lost.append(s)
                break
    return lost


def _look_inside(df: DataFrame, searches: list[_Search]) -> list[_Search]:
    """One pass: the wanted values of intervals with few rows, narrower ends for the others.

    Returns the searches that did not get narrower.
    """
    asked, places = [], []
    for i, s in enumerate(searches):
        at = [r - s.below for r in s.missing()]
        if s.inside <= SMALL_DOMAIN:
            values = F.array_sort(F.collect_list(s.between()))
            asked += [F.get(values, F.lit(p)).alias(f"v{i}_{p}") for p in at]
            places.append(at)
        else:
            margin = 4.0 / SKETCH
            levels = [max(0.0, min(at) / s.inside - margin), min(1.0, max(at) / s.inside + margin)]
            asked.append(F.percentile_approx(s.between(), levels, SKETCH).alias(f"e{i}"))
            places.append(None)
    row = df.agg(*asked).first()
    stuck = []
    for i, (s, at) in enumerate(zip(searches, places)):
        if at is not None:
            s.found.update({p + s.below: row[f"v{i}_{p}"] for p in at})
        else:
            low, high = row[f"e{i}"]
            # The ends are values inside now, so they are counted as ends next time.
            s.low, s.high, s.rounds = low, high, s.rounds + 1
            if s.rounds > MOST_ROUNDS:
                stuck.append(s)
    return stuck


def exact_quantile(df: DataFrame, column: str, level: float) -> float | None:
    """Linear-interpolated quantile of one column, exact at any number of distinct values."""
    return quantiles(df, [column], [level])[column][0]


def quantiles(df: DataFrame, columns: list[str], levels: list[float]) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of several columns at several levels, all at once.

    One pass of sketches brackets every wanted rank, one counts the rows around
    the brackets, and one sorts the few rows inside them: three passes over the
    columns, whatever their number.  A bracket that holds more than
    ``SMALL_DOMAIN`` rows is narrowed by another such pair of passes first; each
    leaves about a thousandth of it, or ends on the value that fills it.
    """
    margin = 4.0 / SKETCH
    ends = [[max(0.0, q - margin), min(1.0, q + margin)] for q in levels]
    value = {c: F.col(f"`{c}`").cast("double") for c in columns}
    row = df.agg(*[F.count(value[c]).alias(f"n{i}") for i, c in enumerate(columns)], *[
        F.percentile_approx(value[c], [x for e in ends for x in e], SKETCH).alias(f"e{i}") for i, c in enumerate(columns)]).first()
    searches: dict[tuple[int, int], _Search] = {}
    for i, c in enumerate(columns):
        n = row[f"n{i}"]
        for k, q in enumerate(levels):
            if n:
                low = int((n - 1) * q)
                searches[i, k] = _Search(c, sorted({low, min(low + 1, n - 1)}), *row[f"e{i}"][2 * k:2 * k + 2])
    waiting = list(searches.values())
    lost: list[_Search] = []
    while waiting:
        missed = _count_around(df, waiting)
        lost += missed
        waiting = [s for s in waiting if s.missing() and s not in missed]
        if waiting:
            stuck = _look_inside(df, waiting)
            lost += stuck
            waiting = [s for s in waiting if s.missing() and s not in stuck]
    for s in lost:
        values = df.select(s.value().alias("v")).filter("v IS NOT NULL")
        s.found.update(zip(s.missing(), _by_running_sums(values, s.missing())))
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(columns):
        out[c] = []
        for k, q in enumerate(levels):
            s = searches.get((i, k))
            if s is None:
                out[c].append(None)
                continue
            place = (row[f"n{i}"] - 1) * q
            a, b = s.found[s.ranks[0]], s.found[s.ranks[-1]]
            out[c].append(a + (b - a) * (place - s.ranks[0]))
    return out
