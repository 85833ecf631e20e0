"""How a query and its SQL twin are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def comparable(df: DataFrame, digits: int = 6) -> DataFrame:
    """Plain types for comparison: bigint, rounded double, text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BooleanType | T.IntegralType):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.FractionalType):
            c = F.round(c.cast("double"), digits)
        elif isinstance(f.dataType, T.TimestampType | T.TimestampNTZType):
            c = F.date_format(c, STAMP)
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(F.array_sort(c.cast("array<string>")), ",")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: comparable(run(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return run
    return register


# Pieces of SQL text for the other engine.
def r6(e: str) -> str:
    return f"round(CAST({e} AS DOUBLE), 6)"


def i8(e: str) -> str:
    return f"CAST({e} AS BIGINT)"


def flag(e: str) -> str:
    return f"CAST(coalesce({e}, false) AS BIGINT)"


def stamp(e: str) -> str:
    return f"strftime({e}, '%Y-%m-%d %H:%M:%S.%f')"
