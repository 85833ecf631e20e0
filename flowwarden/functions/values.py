"""Column rules for dirty values: arrays, numbers, times and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unwrap_array(values: Column) -> Column:
    """``[]`` → null, ``[x]`` → x, ``[x, y]`` → ``"x,y"``."""
    return (
        F.when(F.size(values) <= 0, F.lit(None).cast("string"))
        .when(F.size(values) == 1, F.get(values, F.lit(0)).cast("string"))
        .otherwise(F.array_join(values.cast("array<string>"), ",", "None"))
    )


def unwrap_json_text(text: Column) -> Column:
    """Raw JSON text that is either a scalar or an array of scalars.

    Text that starts like an array but is none is a scalar.
    """
    values = F.from_json(text, "array<string>")
    return F.when(text.startswith("[") & values.isNotNull(), unwrap_array(values)).otherwise(text)


def single_or_all(values: Column) -> Column:
    """Index-hit rule: one element is unwrapped, none is null, more stay an array (as JSON)."""
    return (
        F.when(F.size(values) <= 0, F.lit(None).cast("string"))
        .when(F.size(values) == 1, F.get(values, F.lit(0)))
        .otherwise(F.to_json(values))
    )


def number(value: Column) -> Column:
    return F.trim(value.cast("string")).try_cast("double")


def clean_text(value: Column) -> Column:
    return F.lower(F.trim(value))


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))
