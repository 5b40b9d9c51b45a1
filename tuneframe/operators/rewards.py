"""Reward functions and the reward matrix."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def apply_rewards(
    df: DataFrame, functions: dict[str, Callable[..., Column]], extra_columns: Sequence[str] = ()
) -> DataFrame:
    """Add one DOUBLE column per reward function.

    A function takes the prompt and completion columns and the extra columns: a built-in
    expression or a registered ``pandas_udf(double)``. NULL means "no reward"; a UDF's NaN
    counts as such.
    """
    arguments = [F.col("prompt"), F.col("completion"), *map(F.col, extra_columns)]
    return df.withColumns(
        {name: F.nanvl(function(*arguments).cast("double"), F.lit(None)) for name, function in functions.items()}
    )


def mark_unrewarded(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Flag rows for which every function gave nothing."""
    return df.withColumn("all_missing", F.coalesce(*names).isNull())


def reward_matrix(long: DataFrame, names: Sequence[str], example: str = "example_id") -> DataFrame:
    """One row per example and one column per function from ``(example, func, value)``."""
    columns = [F.max(F.when(F.col("func") == name, F.col("value"))).alias(name) for name in names]
    return mark_unrewarded(long.groupBy(example).agg(*columns), names)
