"""The model's feature table: projections only, plus two small fitted states."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowwarden import schema as S
from flowwarden.functions import features as X
from flowwarden.plans.joins import checked_left_join, is_small
from flowwarden.plans.ranking import sorted_places
from flowwarden.plans.storage import materialize

MAX_LITERAL_VOCABULARY = 1_000
MAX_SORTED_AT_ONCE = 1_000_000
UNKNOWN = "unknown"


def _columns(df: DataFrame, *names: str):
    """The named columns, null where the table lacks one."""
    return [F.col(n) if n in df.columns else F.lit(None) for n in names]


def add_temporal(df: DataFrame, ts: str = "@timestamp") -> DataFrame:
    return df.withColumns(X.temporal(F.col(ts)))


def add_ports(df: DataFrame) -> DataFrame:
    return df.withColumns(X.ports(*_columns(df, "src_port", "dst_port")))


def add_protocol(df: DataFrame) -> DataFrame:
    return df.withColumns(X.protocol(*_columns(df, "proto_name", "action", "dir")))


def add_packet(df: DataFrame) -> DataFrame:
    return df.withColumns(X.packet(*_columns(df, "length", "ttl", "data_length")))


def add_connection(df: DataFrame) -> DataFrame:
    return df.withColumns(X.connection(*_columns(df, "action", "dir", "reason")))


def add_transport(df: DataFrame) -> DataFrame:
    return df.withColumns(X.transport(*_columns(df, "tcp_flags", "tcp_window")))


def add_all(df: DataFrame, ts: str = "@timestamp") -> DataFrame:
    """All six groups in one projection."""
    def c(*names: str):
        return _columns(df, *names)

    return df.withColumns({
        **X.temporal(F.col(ts)), **X.ports(*c("src_port", "dst_port")),
        **X.protocol(*c("proto_name", "action", "dir")),
        **X.packet(*c("length", "ttl", "data_length")),
        **X.connection(*c("action", "dir", "reason")),
        **X.transport(*c("tcp_flags", "tcp_window")),
    })


def fit_vocabulary(df: DataFrame, columns=S.ENCODED_COLUMNS) -> DataFrame:
    """``(column_name, value, code)``: the place of each value among its column's sorted values.

    The distinct values are written once; up to a checked number of them are
    ranked by one window, more by sorted parts.
    """
    cols = [c for c in columns if c in df.columns]
    values = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)).alias(c) for c in cols])
    distinct = materialize(
        values.unpivot([], cols, "column_name", "value").distinct(), "values")
    if is_small(distinct, MAX_SORTED_AT_ONCE):
        place = F.row_number().over(W.partitionBy("column_name").orderBy("value"))
        return distinct.withColumn("code", (place - 1).cast("int"))
    parts = [
        sorted_places(distinct.filter(F.col("column_name") == c), "value", "code") for c in cols
    ]
    return reduce(DataFrame.unionByName, parts).withColumn("code", F.col("code").cast("int"))


def encode(df: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``<column>_encoded`` by the fitted vocabulary; −1 for a value it lacks.

    The encoded columns are those the vocabulary was fitted on.  A vocabulary of
    checked small size becomes literals in the projection; of a larger one each
    column's part is joined, by broadcast after a check of its size or salted.
    """
    fitted = sorted(r[0] for r in vocabulary.select("column_name").distinct().collect())
    names = [c for c in fitted if c in df.columns]
    entries = vocabulary.limit(MAX_LITERAL_VOCABULARY + 1).collect()
    if len(entries) <= MAX_LITERAL_VOCABULARY:
        known: dict[str, list[str]] = {}
        for r in sorted(entries, key=lambda r: (r.column_name, r.code)):
            known.setdefault(r.column_name, []).append(r.value)
        return df.withColumns({
            f"{c}_encoded": (F.array_position(
                F.array(*[F.lit(v) for v in words]),
                F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN))) - 1).cast("int")
            for c, words in known.items() if c in names
        })
    out = df
    for c in names:
        part = vocabulary.filter(F.col("column_name") == c).select(
            F.col("value").alias("_value"), F.col("code").alias("_code"))
        keyed = out.withColumn("_text", F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)))
        out = checked_left_join(keyed, part, [("_text", "_value")]).withColumn(
            f"{c}_encoded", F.coalesce("_code", F.lit(-1))).drop("_text", "_value", "_code")
    return out


def allowed_features(columns=S.MODEL_FEATURES) -> list[str]:
    """The listed columns without any that names an address."""
    return [c for c in columns if c not in S.FORBIDDEN_FEATURES]


def select_features(df: DataFrame, keep: list[str] = (), columns=S.MODEL_FEATURES) -> DataFrame:
    """All model columns as doubles in model order, null and absent ones 0."""
    have = set(df.columns)
    return df.select(*keep, *[
        F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in have
        else F.lit(0.0).alias(c)
        for c in allowed_features(columns)
    ])


def fit_scaler(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column_name, mean, std)`` with the population deviation, in one pass.

    A missing value counts as 0, as in the feature table.
    """
    row = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
    stats = df.select(array_to_vector(row).alias("v")).agg(
        Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s"))
    n = F.col("s.count")
    values = stats.select(
        vector_to_array("s.mean").alias("mean"), vector_to_array("s.variance").alias("variance"),
        ((n - 1) / n).alias("to_population"),
    )
    names = F.array(*[F.lit(c) for c in columns])
    return values.select(
        F.explode(F.arrays_zip(names.alias("name"), "mean", "variance")).alias("x"), "to_population"
    ).select(
        F.col("x.name").alias("column_name"), F.col("x.mean").alias("mean"),
        F.sqrt(F.col("x.variance") * F.col("to_population")).alias("std"),
    )


def scale(df: DataFrame, scaler: DataFrame) -> DataFrame:
    """``(x - mean) / std``; a constant column is only centred.

    The state has one row per column, so reading it is bounded by the schema.
    """
    fitted = {r.column_name: (r.mean, r["std"] or 1.0) for r in scaler.collect()}
    return df.select(*[
        ((F.col(c) - F.lit(fitted[c][0])) / F.lit(fitted[c][1])).alias(c)
        if c in fitted and fitted[c][0] is not None else F.col(c)
        for c in df.columns
    ])


def feature_table(df: DataFrame, vocabulary: DataFrame, keep: list[str] = (),
                  ts: str = "@timestamp") -> DataFrame:
    return select_features(encode(add_all(df, ts), vocabulary), keep)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
