"""What a table holds: one long-form pass, combined before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONG_TEXT = 50
VERY_LONG_TEXT = 100
LARGE_NUMBER = 65535


def _text(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(column)
    return column.cast("string")


def profile_columns(df: DataFrame, samples: int = 2) -> DataFrame:
    """Per column: type, rows, nulls, null share, distinct values and the smallest values.

    Rows become (column, value) pairs that are counted per value, so a value
    held by many rows is one row after the map-side combine.
    """
    fields = df.schema.fields
    pairs = df.select(*[_text(f).alias(f.name) for f in fields]).unpivot(
        [], [F.col(f"`{f.name}`") for f in fields], "column_name", "value")
    counted = pairs.groupBy("column_name", "value").agg(F.count("*").alias("n"))
    per_column = counted.groupBy("column_name").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
        F.count("value").alias("distinct_values"),
    )
    order = W.partitionBy("column_name").orderBy("value")
    first = counted.filter(F.col("value").isNotNull()).withColumn(
        "place", F.row_number().over(order)
    ).filter(F.col("place") <= samples)
    listed = first.groupBy("column_name").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))),
                                 lambda x: x["value"]), ", ").alias("sample_values"))
    kinds = F.create_map(*[
        x for f in fields for x in (F.lit(f.name), F.lit(f.dataType.simpleString()))])
    return per_column.join(listed, "column_name", "left").select(
        "column_name", kinds[F.col("column_name")].alias("type"), "n_rows", "nulls",
        (F.col("nulls") * F.lit(100).cast("double") / F.col("n_rows")).alias("null_percent"),
        "distinct_values", "sample_values",
    )


def profile_warnings(df: DataFrame, longest: int = VERY_LONG_TEXT) -> DataFrame:
    """Columns that hold arrays, and text columns with values longer than ``longest``."""
    checks = {}
    for f in df.schema.fields:
        column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            checks[f.name] = F.struct(F.lit("holds arrays").alias("warning"),
                                      F.max(F.size(column)).cast("bigint").alias("largest"))
        elif isinstance(f.dataType, T.StringType):
            size = F.max(F.length(column)).cast("bigint")
            checks[f.name] = F.struct(F.when(size > longest, "long text").alias("warning"),
                                      size.alias("largest"))
    found = df.agg(*[c.alias(name) for name, c in checks.items()])
    long = found.unpivot([], [F.col(f"`{n}`") for n in checks], "column_name", "w")
    return long.filter("w.warning IS NOT NULL").select("column_name", "w.warning", "w.largest")


def _shape(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    missing = F.when(column.isNull(), "null")
    if isinstance(field.dataType, T.ArrayType):
        size = F.size(column)
        return (missing.when(size == 0, "empty array").when(size == 1, "single-item array")
                .when(size <= 3, "short array").otherwise("long array"))
    if isinstance(field.dataType, T.StringType):
        size = F.length(column)
        return (missing.when(size > VERY_LONG_TEXT, "very long text")
                .when(size > LONG_TEXT, "long text").otherwise("text"))
    if isinstance(field.dataType, T.IntegralType):
        return missing.when(column > LARGE_NUMBER, "large number").otherwise("number")
    return missing.otherwise(field.dataType.simpleString())


def field_shapes(df: DataFrame) -> DataFrame:
    """How many values of each shape every field has."""
    shapes = df.select(*[_shape(f).alias(f.name) for f in df.schema.fields])
    long = shapes.unpivot([], [F.col(f"`{c}`") for c in df.columns], "field", "shape")
    return long.groupBy("field", "shape").agg(F.count("*").alias("n"))


def profile_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two profiles side by side."""
    def side(df: DataFrame, tag: str) -> DataFrame:
        p = profile_columns(df)
        return p.select("column_name", *[
            F.col(c).alias(f"{tag}_{c}") for c in ("type", "n_rows", "nulls", "distinct_values")])
    return side(before, "before").join(side(after, "after"), "column_name", "full_outer")


# ---- profiles that merge: one small row per day and column, kept and added up later ----
HLL_BITS = 12
KLL_SIZE = 400


def day_sketches(df: DataFrame, day: Column, columns: list[str] | None = None) -> DataFrame:
    """Per day and column: rows, nulls, ends, and sketches of the distinct values and of the order of numbers.

    One pass in which only sketches are shuffled, some kilobytes for each day and
    column of a task.  Distinct values are those of the text form, as in
    :func:`profile_columns`; ends are the smallest and largest text.
    """
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    aggregates = []
    for i, f in enumerate(fields):
        text = _text(f)
        number = F.col(f"`{f.name}`").cast("double") if isinstance(f.dataType, T.NumericType) else F.lit(None).cast("double")
        aggregates += [
            F.count(text).alias(f"n{i}"), F.min(text).alias(f"a{i}"), F.max(text).alias(f"b{i}"),
            F.hll_sketch_agg(text, HLL_BITS).alias(f"d{i}"), F.kll_sketch_agg_double(number, KLL_SIZE).alias(f"q{i}")]
    wide = df.groupBy(day.cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"), *aggregates)
    rows = F.array(*[F.struct(
        F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("type"), F.col("n").alias("n_rows"),
        (F.col("n") - F.col(f"n{i}")).alias("nulls"), F.col(f"a{i}").alias("smallest"), F.col(f"b{i}").alias("largest"),
        F.col(f"d{i}").alias("distinct_sketch"),
        (F.col(f"q{i}") if isinstance(f.dataType, T.NumericType) else F.lit(None).cast("binary")).alias("order_sketch"))
        for i, f in enumerate(fields)])
    return wide.select("day", F.explode(rows).alias("p")).select("day", "p.*")


def write_day_sketches(sketches: DataFrame, path: str) -> None:
    """Add days to a folder of sketches; a day that is there already is replaced."""
    sketches.hint("rebalance", "day").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("day").parquet(path)


def merge_sketches(sketches: DataFrame, levels: list[float] = (0.5,)) -> DataFrame:
    """The profile of all the given days, from their sketches alone.

    Rows, nulls and ends are exact; ``distinct_values`` is off by some 1.6 % at
    ``HLL_BITS``, and the rank of each of ``quantiles`` by about a percent.  A
    column whose type changed has the type of its last day.
    """
    with_order = F.when(F.col("order_sketch").isNotNull() & (F.col("nulls") < F.col("n_rows")), F.col("order_sketch"))
    merged = sketches.groupBy("column_name").agg(
        F.max_by("type", "day").alias("type"), F.count_distinct("day").alias("days"), F.sum("n_rows").alias("n_rows"), F.sum("nulls").alias("nulls"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("distinct_values"),
        F.min("smallest").alias("smallest"), F.max("largest").alias("largest"),
        F.count(with_order).alias("_ordered"), F.kll_merge_agg_double(with_order).alias("_order"))
    quantiles = F.when(F.col("_ordered") > 0, F.array(*[F.kll_sketch_get_quantile_double("_order", F.lit(q)) for q in levels]))
    return merged.select(
        "column_name", "type", "days", "n_rows", "nulls", (F.col("nulls") * F.lit(100).cast("double") / F.col("n_rows")).alias("null_percent"),
        "distinct_values", "smallest", "largest", quantiles.alias("quantiles"))


def diff_merged(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two merged profiles side by side, such as those of two weeks."""
    def side(p: DataFrame, tag: str) -> DataFrame:
        return p.select("column_name", *[F.col(c).alias(f"{tag}_{c}") for c in ("type", "n_rows", "nulls", "distinct_values")])
    return side(before, "before").join(side(after, "after"), "column_name", "full_outer")
