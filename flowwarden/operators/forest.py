"""Isolation Forest (Liu, Ting, Zhou 2008) as Spark jobs.

Spark draws the per-tree samples and shuffles them by tree; one tree is grown
from its few hundred rows inside a task.  The forest is a small table of nodes.
Scoring sends batches of feature columns through a vectorised descent.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowwarden import schema as S

EULER = 0.5772156649
NODE_SCHEMA = ("tree int, node int, feature int, threshold double, depth int, size int")
CHUNK = 512
# Every tree's sample is drawn from this many times the rows it needs.
OVERSAMPLE = 2


def check_no_address_columns(columns: list[str]) -> None:
    bad = [c for c in columns if any(part in c for part in S.ADDRESS_NAME_PARTS)]
    if bad:
        raise ValueError(f"address-based columns must not reach the model: {bad}")


def average_path(size) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``size`` rows."""
    n = np.asarray(size, dtype=float)
    big = np.maximum(n, 3.0)
    value = 2.0 * (np.log(big - 1.0) + EULER) - 2.0 * (big - 1.0) / big
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, value))


THINNING = 1 << 50


def sample_per_tree(df: DataFrame, key: str, trees: int = S.TREES,
                    rows_per_tree: int = S.ROWS_PER_TREE, seed: int = S.SEED,
                    total: int | None = None) -> DataFrame:
    """Up to ``rows_per_tree`` rows for every tree, none twice in one tree.

    Membership is decided by hashes of the row key, so it does not depend on
    how the rows are partitioned.  Each row goes to one tree of each of a few
    tree groups (just one group when there are rows enough), and large inputs
    are thinned before the shuffle: about ``OVERSAMPLE`` times the rows the
    forest needs are shuffled, whatever the size of the table.
    """
    n = df.count() if total is None else total
    need = OVERSAMPLE * trees * rows_per_tree
    groups = min(trees, max(1, math.ceil(need / max(n, 1))))
    share = min(1.0, need / max(n * groups, 1))
    per_group = F.floor((F.lit(trees - 1) - F.col("_group")) / groups) + 1
    k = F.col(key)
    rows = df
    if share < 1.0:
        rows = rows.filter(
            F.pmod(F.xxhash64(k, F.lit(seed), F.lit("keep")), F.lit(THINNING)) < int(share * THINNING) + 1
        )
    dealt = rows.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn(
        "tree",
        (F.col("_group") + groups * F.pmod(F.xxhash64(k, F.col("_group"), F.lit(seed)), per_group))
        .cast("int"),
    ).drop("_group")
    # The rank filter runs before the shuffle too, and bounds every tree's group.
    first = W.partitionBy("tree").orderBy(F.xxhash64(k, F.col("tree"), F.lit(seed)), k)
    return dealt.withColumn("_place", F.row_number().over(first)).filter(
        F.col("_place") <= rows_per_tree
    )


def _grower(width: int, depth_limit: int, seed: int):
    """The per-tree function; nested so that Spark ships it by value."""

    def grow(rows: pa.Table) -> pa.Table:
        """One tree in heap order: node i has children 2i+1 and 2i+2."""
        rows = rows.sort_by("_place").combine_chunks()
        tree = rows["tree"][0].as_py()
        x = rows["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        rng = np.random.default_rng([seed, tree])
        out = []
        waiting = [(0, 0, np.arange(len(x)))]
        while waiting:
            node, depth, inside = waiting.pop()
            part = x[inside]
            low, high = part.min(axis=0), part.max(axis=0)
            usable = np.flatnonzero(high > low)
            if depth >= depth_limit or len(inside) <= 1 or not len(usable):
                out.append((tree, node, -1, 0.0, depth, len(inside)))
                continue
            f = int(usable[rng.integers(len(usable))])
            # Strictly below the largest value, so neither side is empty.
            cut = float(min(rng.uniform(low[f], high[f]), np.nextafter(high[f], low[f])))
            left = part[:, f] <= cut
            out.append((tree, node, f, cut, depth, len(inside)))
            waiting.append((2 * node + 2, depth + 1, inside[~left]))
            waiting.append((2 * node + 1, depth + 1, inside[left]))
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32()]
        names = ["tree", "node", "feature", "threshold", "depth", "size"]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return grow


def _row(features: list[str]):
    """The model columns as one array, missing values 0."""
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])


def fit_nodes(df: DataFrame, features: list[str], key: str, trees: int = S.TREES,
              rows_per_tree: int = S.ROWS_PER_TREE, seed: int = S.SEED,
              total: int | None = None) -> DataFrame:
    """The forest's node table: at most ``trees * (2 * rows_per_tree - 1)`` rows."""
    check_no_address_columns(features)
    depth_limit = max(1, math.ceil(math.log2(max(rows_per_tree, 2))))
    packed = df.select(key, _row(features).alias("x"))
    sample = sample_per_tree(packed, key, trees, rows_per_tree, seed, total)
    return sample.select("tree", "_place", "x").groupBy("tree").applyInArrow(
        _grower(len(features), depth_limit, seed), NODE_SCHEMA)


def _pack(nodes: pd.DataFrame):
    """Node table to dense arrays; leaves above the last level pass their rows down."""
    trees = sorted(nodes["tree"].unique())
    deepest = int(nodes["depth"].max()) if len(nodes) else 0
    width = 2 ** (deepest + 1) - 1
    feature = np.zeros((len(trees), width), dtype=np.int64)
    cut = np.full((len(trees), width), np.inf)
    path = np.zeros((len(trees), width))
    place = {t: i for i, t in enumerate(trees)}
    ends = average_path(nodes["size"].to_numpy()) + nodes["depth"].to_numpy()
    for t, node, f, c, depth, end in zip(
        nodes["tree"], nodes["node"], nodes["feature"], nodes["threshold"], nodes["depth"], ends
    ):
        i = place[t]
        if f >= 0:
            feature[i, node], cut[i, node] = f, c
        else:
            for _ in range(deepest - int(depth)):
                node = 2 * node + 1
            path[i, node] = end
    return feature, cut, path, deepest


def score_samples(df: DataFrame, nodes: DataFrame, features: list[str],
                  rows_per_tree: int = S.ROWS_PER_TREE, out: str = "raw_score") -> DataFrame:
    """Add ``-2^(-mean path / expected path)``: lower is more anomalous.

    The node table is bounded by the forest's size, not the data's, so it is
    read once and broadcast.  Only the feature columns go to Python.
    """
    model = df.sparkSession.sparkContext.broadcast(_pack(nodes.toPandas()))
    norm = float(average_path(rows_per_tree))

    columns = len(features)

    def descend(rows: pa.Array) -> pa.Array:
        feature, cut, path, depth = model.value
        trees, width = feature.shape
        start = (np.arange(trees, dtype=np.int64) * width)[:, None]
        cuts, paths = cut.ravel(), path.ravel()
        x = rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, columns)
        out = np.empty(len(x))

        def beyond(part: np.ndarray, node: int) -> np.ndarray:
            return part[feature[:, node]] > cut[:, node, None]

        # All trees at once for a few hundred rows keeps the work inside the cache.
        for low in range(0, len(x), CHUNK):
            part = np.ascontiguousarray(x[low:low + CHUNK].T)
            n = part.shape[1]
            row = np.arange(n)[None, :]
            offset = (feature * n).ravel()
            at = np.zeros((trees, n), dtype=np.int64)
            # The nodes of the first two levels are compared for all rows: no row is looked up alone there.
            if depth:
                right = beyond(part, 0)
                at += 1
                at += right
            if depth > 1:
                right = np.where(right, beyond(part, 2), beyond(part, 1))
                at <<= 1
                at += 1
                at += right
            at += start
            place, value, limit = np.empty_like(at), np.empty(at.shape), np.empty(at.shape)
            # Every place is inside its table; clip only lets take write to ``out`` without a copy.
            for _ in range(depth - 2):
                offset.take(at, out=place, mode="clip")
                place += row
                part.take(place, out=value, mode="clip")
                cuts.take(at, out=limit, mode="clip")
                at <<= 1
                at += 1 - start
                at += value > limit
            out[low:low + n] = paths.take(at, out=value, mode="clip").sum(axis=0)
        return pa.array(-np.exp2(-out / trees / norm))

    descend.__annotations__ = {"rows": pa.Array, "return": pa.Array}
    return df.withColumn(out, F.arrow_udf(descend, "double")(_row(features)))


def apply_offset(df: DataFrame, offset: float, raw: str = "raw_score") -> DataFrame:
    """Decision score (below 0 is anomalous) and the −1/1 prediction."""
    score = F.col(raw) - F.lit(offset)
    return df.withColumns({
        "anomaly_score": score,
        "prediction": F.when(score < 0, -1).otherwise(1),
        "is_anomaly": score < 0,
    })
