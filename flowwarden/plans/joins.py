"""Lookup joins that stay safe when the table or one key is large."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 200_000
SALTS = 32
# A key with more rows than this is spread over several tasks.
HEAVY_ROWS = 200_000


def is_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> bool:
    """Whether the table has at most ``max_rows`` rows; reads no further than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def spread_heavy(left: DataFrame, table: DataFrame, keys: list[tuple[str, str]], salts: int) -> tuple[DataFrame, DataFrame]:
    """Left rows with ``_salt``, and the table with ``_part``: only keys with many left rows have more than one part."""
    # The partition number is part of the salt, so equal copies of a row are spread too.
    salt = F.pmod(F.hash(*[F.col(f"`{c}`") for c in left.columns], F.spark_partition_id()), F.lit(salts))
    parts = F.sequence(F.lit(0), F.lit(salts - 1))
    kinds = [(left.select(mine).schema[0].dataType, table.select(theirs).schema[0].dataType) for mine, theirs in keys]
    if left.isStreaming or any(a != b for a, b in kinds):
        return left.withColumn("_salt", salt), table.withColumn("_part", F.explode(parts))
    names = [f"_heavy{i}" for i in range(len(keys))]
    known = left.select(*[F.col(mine).alias(n) for n, (mine, _) in zip(names, keys)]).dropna()
    heavy = F.broadcast(known.groupBy(*names).agg(F.count("*").alias("_heavy_rows")).filter(F.col("_heavy_rows") > HEAVY_ROWS))
    same = [[F.col(pair[side]) == F.col(n) for n, pair in zip(names, keys)] for side in (0, 1)]
    is_heavy = F.col("_heavy_rows").isNotNull()
    no_key = reduce(or_, [F.col(mine).isNull() for mine, _ in keys])
    spread = left.join(heavy, same[0], "left").withColumn("_salt", F.when(no_key | is_heavy, salt).otherwise(0))
    repeated = table.join(heavy, same[1], "left").withColumn("_part", F.explode(F.when(is_heavy, parts).otherwise(F.array(F.lit(0)))))
    return spread.drop(*names, "_heavy_rows"), repeated.drop(*names, "_heavy_rows")


def checked_left_join(left: DataFrame, table: DataFrame, keys: list[tuple[str, str]],
                      extra: Column | None = None,
                      max_rows: int = MAX_BROADCAST_ROWS, salts: int = SALTS) -> DataFrame:
    """Left join with a lookup table whose size is checked first.

    A table of at most ``max_rows`` rows is broadcast.  A larger one is joined
    by shuffle, by sorting, whatever its size is taken for.  Keys that hold more
    than ``HEAVY_ROWS`` left rows are counted first; the rows of such a key are
    spread over ``salts`` parts and its table rows repeated for every part, so
    the key is worked on by many tasks.  The rest of the table is not repeated,
    and left rows without a key are spread too.  Both ways give the same rows.
    A stream cannot be counted before it is joined: there every key is spread.
    """
    condition = F.lit(True)
    for mine, theirs in keys:
        condition = condition & (F.col(mine) == F.col(theirs))
    if extra is not None:
        condition = condition & extra
    if is_small(table, max_rows):
        return left.join(F.broadcast(table), condition, "left")
    spread, repeated = spread_heavy(left, table, keys, salts)
    return spread.join(
        repeated.hint("merge"), condition & (F.col("_salt") == F.col("_part")), "left"
    ).drop("_salt", "_part")
