"""Batch readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowwarden.functions import values as V


def read_ndjson(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON object per line; a bad line fails the read, a table without rows too.

    Fields that mix scalars and arrays are declared as text, which keeps their
    raw JSON for ``normalize_json_text``.
    """
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if df.isEmpty():
        raise ValueError(f"no rows in {path}")
    return df


def flatten_hits(hits: DataFrame, names: list[str], text: str = "hit") -> DataFrame:
    """Index hits as raw JSON text to one text column per name.

    ``_source`` is used if there is one, else ``fields``, else the hit itself.
    """
    body = F.coalesce(
        F.get_json_object(text, "$._source"), F.get_json_object(text, "$.fields"), F.col(text))
    raw = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = hits.withColumn("_body", F.from_json(body, raw))
    out = []
    for n in names:
        value = F.col("_body")[n]
        several = F.from_json(value, "array<string>")
        out.append(F.when(value.startswith("[") & several.isNotNull(), V.single_or_all(several))
                   .otherwise(value).alias(n))
    return rows.select(*hits.columns, *out).drop(text)


def newest_time(df: DataFrame, ts: str = "@timestamp") -> DataFrame:
    """Where a first fetch starts: the newest time, or now for an empty table."""
    return df.agg(F.coalesce(F.max(ts), F.current_timestamp()).alias("checkpoint"))


def fetch_after(df: DataFrame, after_ts, after_id, limit: int, ts: str = "@timestamp",
                key: str = "event_id") -> DataFrame:
    """The next ``limit`` rows after the cursor ``(time, id)``, in that order.

    The single-column bound repeats part of the cursor test so that it reaches
    the scan; rows sharing the cursor's time are not lost.
    """
    at = F.lit(after_ts).cast("timestamp")
    later = (F.col(ts) > at) | ((F.col(ts) == at) & (F.col(key) > F.lit(after_id)))
    return df.filter((F.col(ts) >= at) & later).orderBy(ts, key).limit(limit)


def next_cursor(batch: DataFrame, ts: str = "@timestamp", key: str = "event_id"):
    """The last row's ``(time, id)`` of a fetched batch, None for an empty one."""
    last = batch.agg(F.max(F.struct(ts, key)).alias("c")).first().c
    return None if last is None else (last[0], last[1])


def fetch_stats(df: DataFrame, batch: DataFrame, ts: str = "@timestamp") -> DataFrame:
    """Rows in reach, rows of the last batch and the time it ends at."""
    reach = df.agg(F.count("*")).scalar()
    return batch.agg(
        F.count("*").alias("last_batch_size"), F.max(ts).alias("checkpoint"),
    ).withColumn("total_available", reach)
