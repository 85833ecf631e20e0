"""Eigenvalues and eigenvectors of a symmetric integer matrix without negative eigenvalues.

The characteristic polynomial is exact: Hessenberg reduction modulo many primes,
one small task each, and Chinese remaindering.  All its roots are real, so the
sign changes of the polynomial moved by t count the roots above t exactly, with
multiplicity; bisection isolates the largest ones to many more bits than a double
has.  Their null spaces follow by inverse iteration in fixed-point integers.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

# Bits of a root behind the point, and of the fixed-point numbers of inverse iteration.
ROOT_BITS, FIXED_BITS = 96, 320
STEPS = 3
_WITNESSES = (2, 3, 5, 7)


def _is_prime(n: int) -> bool:
    """Right below 3,215,031,751 with these four witnesses."""
    if n % 2 == 0 or n < 9:
        return n in (2, 3, 5, 7)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for a in _WITNESSES:
        x = pow(a, odd, n)
        if x in (0, 1, n - 1):
            continue
        if not any((x := x * x % n) == n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """Primes below 2^31, from the largest, whose product is above ``bound``."""
    found, product, n = [], 1, 2**31
    while product <= bound:
        n -= 1
        if _is_prime(n):
            found.append(n)
            product *= n
    return found


def characteristic_mod(m: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x - m) modulo a prime below 2^31, the constant first."""
    h, d = (m % p).astype(np.int64), len(m)
    for k in range(d - 2):
        rows = np.flatnonzero(h[k + 1:, k])
        if not len(rows):
            continue
        r = k + 1 + rows[0]
        if r != k + 1:
            h[[r, k + 1]] = h[[k + 1, r]]
            h[:, [r, k + 1]] = h[:, [k + 1, r]]
        factor = h[k + 2:, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2:] = (h[k + 2:] - factor[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2:] * factor % p).sum(axis=1)) % p
    # Polynomials of the leading minors, each from those before it.
    minors = np.zeros((d + 1, d + 1), np.int64)
    minors[0, 0] = 1
    for k in range(1, d + 1):
        weight, below = np.zeros(k, np.int64), 1
        weight[k - 1] = h[k - 1, k - 1]
        for i in range(k - 2, -1, -1):
            below = below * int(h[i + 1, i]) % p
            if not below:
                break
            weight[i] = int(h[i, k - 1]) * below % p
        minors[k, 1:] = minors[k - 1, :-1]
        minors[k] = (minors[k] - (weight[:, None] * minors[:k] % p).sum(axis=0)) % p
    return minors[d]


def characteristic(spark: SparkSession, m: np.ndarray) -> list[int]:
    """Exact coefficients of det(x - m), the constant first; ``m`` has Python integers and no negative eigenvalue."""
    d, trace = len(m), int(np.trace(m))
    # The k-th coefficient is a sum over k eigenvalues, greatest where all are equal.
    bound = max(math.comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))
    primes = primes_beyond(2 * bound)
    cells = m.tolist()

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.array(cells, dtype=object)
        for batch in batches:
            found = [characteristic_mod(whole, p).tolist() for p in batch["p"].to_pylist()]
            yield pa.record_batch([batch["p"], pa.array(found, pa.list_(pa.int64()))], ["p", "coefficients"])

    tasks = min(len(primes), spark.sparkContext.defaultParallelism)
    table = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks, F.col("p"))
    residues = dict(table.mapInArrow(reduce, "p long, coefficients array<long>").collect())
    product = math.prod(primes)
    out = [0] * (d + 1)
    for p in primes:
        others = product // p
        basis = others * pow(others, -1, p)
        for k, r in enumerate(residues[p]):
            out[k] += basis * r
    return [c % product if c % product <= product // 2 else c % product - product for c in out]


def _roots_above(coefficients: list[int], t: int) -> int:
    """How many roots are above t, by the sign changes of the polynomial moved by t."""
    moved = list(coefficients)
    for i in range(len(moved) - 1):
        for k in range(len(moved) - 2, i - 1, -1):
            moved[k] += t * moved[k + 1]
    signs = [c > 0 for c in moved if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign(coefficients: list[int], t: int) -> int:
    value = 0
    for c in reversed(coefficients):
        value = value * t + c
    return (value > 0) - (value < 0)


def largest_roots(coefficients: list[int], count: int, bits: int = ROOT_BITS) -> list[int]:
    """The largest roots, with multiplicity and in falling order, times 2^bits and rounded down to whole numbers."""
    d = len(coefficients) - 1
    scaled = [c << bits * (d - k) for k, c in enumerate(coefficients)]
    ceiling = -scaled[d - 1] + 1
    known = {-1: d, ceiling: 0}
    out = []
    for place in range(1, min(count, d) + 1):
        # Roots above ``low`` are at least ``place``, those above ``high`` fewer.
        low = max(t for t, n in known.items() if n >= place)
        high = min(t for t, n in known.items() if n < place)
        while high - low > 1 and known[low] - known[high] > 1:
            middle = (low + high) // 2
            known[middle] = _roots_above(scaled, middle)
            low, high = (middle, high) if known[middle] >= place else (low, middle)
        if high - low > 1:
            # One simple root is left: the sign tells on which side of it a point lies.
            above = _sign(scaled, high) or -_sign(scaled, low)
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (low, middle) if _sign(scaled, middle) in (0, above) else (middle, high)
        out.append(max(low, 0) if _sign(scaled, high) else high)
    return out


def _eliminated(m: np.ndarray, root: int) -> tuple[np.ndarray, list[int]]:
    """Triangular factors of m - root / 2^ROOT_BITS in fixed point, and the order of the rows."""
    d, order = len(m), list(range(len(m)))
    a = m * (1 << FIXED_BITS)
    a[np.diag_indices(d)] -= root << FIXED_BITS - ROOT_BITS
    for k in range(d):
        r = k + int(np.argmax(np.abs(a[k:, k])))
        if r != k:
            a[[r, k]] = a[[k, r]]
            order[r], order[k] = order[k], order[r]
        # An exact eigenvalue leaves nothing here; the least number stands for it.
        a[k, k] = a[k, k] or 1
        factor = np.array([(int(x) << FIXED_BITS) // int(a[k, k]) for x in a[k + 1:, k]], dtype=object)
        if len(factor):
            a[k + 1:, k + 1:] -= (factor[:, None] * a[k, k + 1:]) >> FIXED_BITS
            a[k + 1:, k] = factor
    return a, order


def _solved(a: np.ndarray, order: list[int], b: list[int]) -> list[int]:
    x = [b[i] for i in order]
    for i in range(len(x)):
        x[i] -= sum((int(a[i, j]) * x[j]) >> FIXED_BITS for j in range(i))
    for i in range(len(x) - 1, -1, -1):
        rest = x[i] - sum((int(a[i, j]) * x[j]) >> FIXED_BITS for j in range(i + 1, len(x)))
        x[i] = (rest << FIXED_BITS) // int(a[i, i])
    return x


def _unit(v: list[int]) -> list[int]:
    length = math.isqrt(sum(x * x for x in v))
    return [(x << FIXED_BITS) // length for x in v] if length else v


def null_vectors(m: np.ndarray, roots: list[int]) -> list[list[float]]:
    """A unit eigenvector for each root of :func:`largest_roots`, orthogonal to those before it.

    The entry largest in size is positive, the first of several.
    """
    found: list[list[int]] = []
    for place, root in enumerate(roots):
        a, order = _eliminated(m, root)
        rng = random.Random(place)
        v = _unit([rng.randrange(-2**64, 2**64) for _ in range(len(m))])
        for _ in range(STEPS):
            for u in found:
                along = sum(x * y for x, y in zip(u, v)) >> FIXED_BITS
                v = [y - (along * x >> FIXED_BITS) for x, y in zip(u, v)]
            v = _unit(_solved(a, order, _unit(v)))
        for u in found:
            along = sum(x * y for x, y in zip(u, v)) >> FIXED_BITS
            v = [y - (along * x >> FIXED_BITS) for x, y in zip(u, v)]
        v = _unit(v)
        most = max(v, key=abs)
        found.append([-x for x in v] if most < 0 else v)
    return [[float(Fraction(x, 1 << FIXED_BITS)) for x in v] for v in found]


def eigenpairs(spark: SparkSession, m: np.ndarray, count: int) -> tuple[list[Fraction], list[list[float]]]:
    """The largest eigenvalues, exact to ``ROOT_BITS`` bits behind the point, and their vectors."""
    roots = largest_roots(characteristic(spark, m), count)
    return [Fraction(r, 1 << ROOT_BITS) for r in roots], null_vectors(m, roots)
