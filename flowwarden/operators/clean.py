"""Cleaning: fitted values are a handful of numbers, the rows stay on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowwarden import schema as S
from flowwarden.functions import values as V
from flowwarden.plans.ranking import quantiles
from flowwarden.plans.storage import materialize


def present(df: DataFrame, columns) -> list[str]:
    return [c for c in columns if c in df.columns]


def missing_columns(df: DataFrame, required=S.REQUIRED_COLUMNS) -> list[tuple[str, str]]:
    """``(column, group)`` for each required column the table lacks."""
    return [(c, g) for g, cols in required.items() for c in cols if c not in df.columns]


def validate_schema(df: DataFrame, required=S.REQUIRED_COLUMNS) -> DataFrame:
    """Add the required columns a table lacks, as nulls."""
    return df.withColumns({
        c: F.lit(None).cast(S.REQUIRED_TYPES.get(c, "string"))
        for c, _ in missing_columns(df, required)
    })


def is_valid(df: DataFrame) -> bool:
    """A table without rows cannot be cleaned."""
    return not df.isEmpty()


def normalize_arrays(df: DataFrame) -> DataFrame:
    arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    return df.withColumns({c: V.unwrap_array(F.col(c)) for c in arrays})


def normalize_json_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """The same for raw JSON text that mixes scalars and arrays in one column."""
    return df.withColumns({c: V.unwrap_json_text(F.col(c)) for c in present(df, columns)})


def dedup_rows(df: DataFrame) -> DataFrame:
    """Equal rows once.  Copies collapse before the shuffle, so many copies of one
    row do not meet in one task."""
    return df.dropDuplicates()


def coerce_types(df: DataFrame, ts: str = "@timestamp", numeric=S.NUMERIC_COLUMNS,
                 lowered=S.LOWERED_COLUMNS) -> DataFrame:
    """Numbers, time and lower-case text; what does not convert is null.

    TCP flags go to upper case, the form the feature rules look for.
    """
    out = {c: V.number(F.col(c)) for c in present(df, numeric)}
    if ts in df.columns and isinstance(df.schema[ts].dataType, T.StringType):
        out[ts] = F.try_to_timestamp(F.col(ts))
    out.update({c: F.lower(F.col(c)) for c in present(df, lowered)})
    out.update({c: F.upper(F.col(c)) for c in present(df, ["tcp_flags"])})
    return df.withColumns(out)


def drop_incomplete(df: DataFrame, columns=S.CRITICAL_COLUMNS) -> DataFrame:
    return df.dropna(subset=present(df, columns))


def fill_defaults(df: DataFrame, fills=S.CONSTANT_FILLS) -> DataFrame:
    return df.fillna({c: v for c, v in fills.items() if c in df.columns})


def fit_medians(df: DataFrame, columns=S.MEDIAN_COLUMNS) -> dict[str, float]:
    cols = [c for c in present(df, columns) if isinstance(df.schema[c].dataType, T.NumericType)]
    if not cols:
        return {}
    return {c: q[0] for c, q in quantiles(df, cols, [0.5]).items() if q[0] is not None}


def apply_medians(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    return df.withColumns({
        c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in medians.items()
    })


def impute_median(df: DataFrame, columns=S.MEDIAN_COLUMNS) -> DataFrame:
    return apply_medians(df, fit_medians(df, columns))


def fit_bounds(df: DataFrame, columns=S.CLIPPED_COLUMNS,
               factor: float = S.IQR_FACTOR) -> dict[str, tuple[float, float]]:
    """``[Q1 - factor*IQR, Q3 + factor*IQR]`` per column."""
    found = quantiles(df, present(df, columns), [0.25, 0.75])
    return {
        c: (a - factor * (b - a), b + factor * (b - a))
        for c, (a, b) in found.items() if a is not None
    }


def apply_bounds(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Clip; a null stays null although ``greatest`` and ``least`` skip nulls."""
    return df.withColumns({
        c: F.when(F.col(c).isNotNull(), F.least(
            F.greatest(F.col(c).cast("double"), F.lit(low)), F.lit(high)))
        for c, (low, high) in bounds.items()
    })


def clip_iqr(df: DataFrame, columns=S.CLIPPED_COLUMNS, factor: float = S.IQR_FACTOR) -> DataFrame:
    return apply_bounds(df, fit_bounds(df, columns, factor))


def outlier_counts(df: DataFrame, columns=S.CLIPPED_COLUMNS,
                   factor: float = S.IQR_FACTOR) -> DataFrame:
    bounds = fit_bounds(df, columns, factor)
    counted = df.agg(*[
        V.count_if((F.col(c) < low) | (F.col(c) > high)).alias(c)
        for c, (low, high) in bounds.items()
    ])
    return counted.unpivot([], list(bounds), "column_name", "outliers")


def normalize_text(df: DataFrame, text=S.TRIMMED_TEXT_COLUMNS, ips=S.TRIMMED_IP_COLUMNS) -> DataFrame:
    out = {c: V.clean_text(F.col(c)) for c in present(df, text)}
    out.update({c: F.trim(F.col(c)) for c in present(df, ips)})
    return df.withColumns(out)


def null_counts(df: DataFrame, only_present: bool = False) -> DataFrame:
    """Nulls per column; ``only_present`` leaves out columns without any."""
    counted = df.agg(*[V.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    long = counted.unpivot([], [F.col(f"`{c}`") for c in df.columns], "column_name", "nulls")
    return long.filter("nulls > 0") if only_present else long


def value_distribution(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Count per value and its percentage of all rows."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count("*").alias("n")
    )
    total = df.agg(F.count("*")).scalar()
    shares = counts.withColumn("percent", F.col("n") * F.lit(100).cast("double") / total)
    return shares if top is None else shares.orderBy(F.desc("n"), "value").limit(top)


def sample_rows(df: DataFrame, order: list[str], columns: list[str], n: int = 5) -> DataFrame:
    return df.orderBy(*order).select(*present(df, columns)).limit(n)


def prepare(df: DataFrame, ts: str = "@timestamp") -> DataFrame:
    """The steps before anything is fitted: arrays, duplicates, types, fixed fills."""
    rows = coerce_types(dedup_rows(normalize_arrays(validate_schema(df))), ts)
    return fill_defaults(drop_incomplete(rows, ["action", "proto_name", ts]))


def clean(df: DataFrame, ts: str = "@timestamp") -> DataFrame:
    """All steps in their fixed order: medians before bounds, bounds before trimming.

    The rows are read and deduplicated once and written to the shared folder;
    fitting then scans only the numeric columns, and the result is a projection
    of that table.
    """
    rows = materialize(prepare(df, ts), "prepared")
    filled = apply_medians(rows, fit_medians(rows))
    return normalize_text(apply_bounds(filled, fit_bounds(filled)))


def clean_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows read, removed and kept."""
    read = before.agg(F.count("*")).scalar()
    return after.agg(F.count("*").alias("final_records")).select(
        read.alias("total_records"),
        (read - F.col("final_records")).alias("records_removed"),
        "final_records",
    )
