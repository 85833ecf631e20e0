"""Whitening of embeddings from an exact integer scatter matrix."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowwarden.llm.spectrum import eigenpairs
from flowwarden.llm.text import materialize
from flowwarden.llm.vectors import finite, floors, matrix

SCALE, COMPONENTS = 1024, 8
# Sums travel as limbs of 32 bits, the last one signed, so that Spark adds them as longs without overflow.
LIMBS, LIMB_BITS = 6, 32
# Partial sums are first added in this many groups of tasks.
GROUPS = 256


def gram(x: np.ndarray) -> np.ndarray:
    """x' x in Python integers, by exact products of doubles where the sums allow it."""
    d = x.shape[1]
    most = max(-int(x.min()), int(x.max()), 1) if x.size else 1
    rows = 2**53 // most**2
    if rows < 1:
        wide = x.astype(object)
        return wide.T @ wide if len(x) else np.zeros((d, d), dtype=object)
    total = np.zeros((d, d), dtype=object)
    for start in range(0, len(x), min(rows, 1 << 16)):
        part = x[start:start + min(rows, 1 << 16)].astype(np.float64)
        total = total + (part.T @ part).astype(np.int64).astype(object)
    return total


def _limbs(values: list[int]) -> list[int]:
    mask = (1 << LIMB_BITS) - 1
    return [v >> LIMB_BITS * k & mask if k < LIMBS - 1 else v >> LIMB_BITS * k for v in values for k in range(LIMBS)]


def _value(limbs: list[int]) -> int:
    return sum(v << LIMB_BITS * k for k, v in enumerate(limbs))


def _moments(d: int):
    """One row per partition: rows, sums per entry and the upper half of x' x."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(d, dtype=object), np.zeros((d, d), dtype=object)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch["x"])
                n, sums, products = n + len(x), sums + x.astype(object).sum(axis=0), products + gram(x)
        if n:
            values = [n, *sums, *(products[i, j] for i, j in combinations_with_replacement(range(d), 2))]
            yield pa.record_batch([pa.array([_limbs([int(v) for v in values])], pa.list_(pa.int64()))], ["limbs"])
    return of


def _added(table: pa.Table) -> pa.Table:
    return pa.table({"limbs": pa.array([matrix(table["limbs"]).sum(axis=0).tolist()], pa.list_(pa.int64()))})


def scatter(rows: DataFrame, d: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of vectors, sums per entry, and ``n * x'x - S S'``, all exact.

    What reaches the driver is one number per pair of entries, whatever the number of rows.
    """
    parts = rows.select("x").mapInArrow(_moments(d), "limbs array<long>")
    parts = parts.groupBy(F.pmod(F.spark_partition_id(), F.lit(GROUPS)).alias("g")).applyInArrow(_added, "limbs array<long>")
    sums = dict(parts.select(F.posexplode("limbs").alias("k", "v")).groupBy("k").agg(F.sum("v")).collect())
    values = [_value([sums.get(i * LIMBS + k, 0) for k in range(LIMBS)]) for i in range(1 + d + d * (d + 1) // 2)]
    n, s = values[0], np.array(values[1:1 + d], dtype=object)
    products = np.zeros((d, d), dtype=object)
    for (i, j), v in zip(combinations_with_replacement(range(d), 2), values[1 + d:]):
        products[i, j] = products[j, i] = v
    return n, s, n * products - np.outer(s, s)


def _whitened(n: int, sums: list[int], vectors: list[list[float]], scales: list[float]):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, v, root = np.array(sums, dtype=object), np.array(vectors), np.array(scales)
        most = max([abs(x) for x in sums], default=0)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch["x"])
            bound = n * max(-int(x.min()), int(x.max())) + most
            z = n * x - s.astype(np.int64) if bound < 2**63 else n * x.astype(object) - s
            if bound**2 * len(sums) < 2**63:
                deviation = pa.array((z * z).sum(axis=1)).cast(pa.decimal128(38, 0))
            else:
                wide = (z.astype(object) ** 2).sum(axis=1)
                deviation = pa.array([str(w) if w < 10**38 else None for w in wide]).cast(pa.decimal128(38, 0))
            with np.errstate(divide="ignore", invalid="ignore"):
                white = z.astype(np.float64) @ v.T / root
            flat = pa.array(white.ravel(), mask=np.tile(root == 0, len(x)))
            ends = np.arange(len(x) + 1, dtype=np.int32) * len(scales)
            yield pa.record_batch([batch["row_id"], deviation, pa.ListArray.from_arrays(pa.array(ends), flat)],
                                  ["row_id", "deviation", "w"])
    return of


def _identity_error(stored: DataFrame, scales: list[float]) -> float | None:
    """The largest entry of the covariance of the whitened values minus the identity."""
    used = [k for k, s in enumerate(scales) if s]
    if not used:
        return None
    entry = lambda k: F.get("w", F.lit(k))
    pairs = list(combinations_with_replacement(used, 2))
    row = stored.agg(*[F.covar_pop(entry(i), entry(j)).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(row[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", fit: Column | None = None,
           components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """One row per vector and component: id, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    An entry c counts as the integer ``floor(scale * c)``.  The scatter matrix of
    the rows where ``fit`` holds (all by default) is summed exactly by Spark,
    its eigenvalues are roots of its exact characteristic polynomial, and the
    vectors come from its null spaces.  ``deviation`` is the sum over entries of
    (n * x - S)^2, decimal; adding a constant to every x changes no result.
    ``explained`` is the component's share of the total variance and
    ``identity_error`` is measured on the whitened rows of the fit.

    Rows with a null vector, or with a null or non-finite entry, are dropped, and
    so are vectors shorter than the longest: what they lack counts as null.
    Repeated rows and rows without id are rows like others.  A component without
    variance has null ``whitened``; without any variance ``explained`` and
    ``identity_error`` are null too.  ``deviation`` is null beyond 38 digits.  An
    empty table gives no rows.  Other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).alias("row_id"), F.col(vector_col).alias("v"),
                          (F.lit(True) if fit is None else F.coalesce(fit, F.lit(False))).alias("fit")).where(finite(F.col("v")))
    rows = materialize(rows.select("row_id", "fit", floors(F.col("v"), scale).alias("x"), F.size("v").alias("d")), "entries")
    d = rows.agg(F.max("d")).first()[0] or 0
    rows = rows.where((F.col("d") == d) & (F.col("d") > 0))
    n, sums, m = scatter(rows.where("fit"), d)
    count = min(components, d) if n else 0
    values, axes = eigenpairs(rows.sparkSession, m, count) if count else ([], [])
    total = int(np.trace(m)) if d else 0
    # whitened = (n x - S) v / n over sqrt(value) / n
    scales = [math.sqrt(v) for v in values]
    kind = rows.schema["row_id"].dataType.simpleString()
    done = rows.select("row_id", "x").mapInArrow(
        _whitened(n, [int(s) for s in sums], axes, scales), f"row_id {kind}, deviation decimal(38,0), w array<double>")
    done = materialize(done if count else done.limit(0), "whitened")
    shares = F.array(*[F.lit(float(Fraction(v) / total) if total else None).cast("double") for v in values])
    fitted = done if fit is None else materialize(
        rows.where("fit").select("row_id", "x").mapInArrow(_whitened(n, [int(s) for s in sums], axes, scales),
                                                           done.schema), "whitened-fit")
    error = _identity_error(fitted, scales)
    out = done.select("row_id", "deviation", F.posexplode_outer("w").alias("k", "whitened"))
    return out.select(
        F.col("row_id").alias(id_col), (F.col("k") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        "whitened", (F.get(shares, F.col("k")) if values else F.lit(None).cast("double")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"))
