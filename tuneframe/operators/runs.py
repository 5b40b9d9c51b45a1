"""Run-level analytics: metric roll-ups, checkpoints, comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuneframe.constants import BEST_METRIC, RUN_NAME_REGEX

EVENT = ["run_id", "mode", "prefix", "step"]


def with_mode(metrics: DataFrame, event: Sequence[str] = ("run_id", "step"), name: str = "name") -> DataFrame:
    """Add ``mode``: a log event is an evaluation when any of its names starts with ``eval_``."""
    modes = metrics.groupBy(*event).agg(
        F.when(F.max(F.startswith(F.col(name), F.lit("eval_"))), "eval").otherwise("train").alias("mode")
    )
    return metrics.join(modes, list(event))


def metric_rollup(metrics: DataFrame, groups: Sequence[str] = tuple(EVENT)) -> DataFrame:
    """Mean of the buffered values of each metric per log event.

    The values are batch means, so this is the unweighted mean of batch means. Evaluation
    metrics are named with their prefix.
    """
    shown = F.when(F.col("mode") == "eval", F.concat_ws("_", "prefix", "name")).otherwise(F.col("name"))
    return (
        metrics.withColumn("name", shown)
        .groupBy(*groups, "name")
        .agg(F.avg("value").alias("value"), F.count("value").alias("n_batches"))
    )


def row_weighted_mean(metrics: DataFrame, weight: str, groups: Sequence[str]) -> DataFrame:
    """Mean over rows behind the batch means; differs from :func:`metric_rollup` when batch
    sizes differ."""
    return metrics.groupBy(*groups, "name").agg(
        F.try_divide(F.sum(F.col("value") * F.col(weight)), F.sum(weight)).alias("value")
    )


def latest_metric(metrics: DataFrame, groups: Sequence[str] = ("run_id", "name")) -> DataFrame:
    """Value at the highest step, for counters that are overwritten instead of averaged. Of several values at that step the largest, NaN
    and NULL least, as :func:`tuneframe.streaming.jobs.latest_from_sink` has it."""
    rank = F.struct("step", F.nanvl(F.col("value").cast("double"), F.lit(None).cast("double")))
    return metrics.groupBy(*groups).agg(F.max("step").alias("step"), F.max_by("value", rank).alias("value"))


def best_metric_name(task: Column) -> Column:
    branches = None
    for name, metric in BEST_METRIC.items():
        branches = F.when(task == name, metric) if branches is None else branches.when(task == name, metric)
    return branches


def best_checkpoint(metrics: DataFrame, groups: Sequence[str] = ("run_id",)) -> DataFrame:
    """Step with the greatest value; the earliest step wins a tie and NaN never does.

    ``metrics`` holds ``groups, step, value`` of the deciding metric, or with ``task`` and ``name``
    columns all metrics, of which each task's own metric decides (:func:`best_metric_name`, by the end of its name).
    """
    if {"task", "name"} <= set(metrics.columns):
        metrics = metrics.where(F.endswith(F.col("name"), best_metric_name(F.col("task"))))
    order = F.struct(F.col("value"), -F.col("step"))
    return metrics.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy(*groups).agg(
        F.max_by("step", order).alias("best_step"), F.max("value").alias("best_value")
    )


def init_vs_final(
    metrics: DataFrame, groups: Sequence[str] = ("run_id",), initial: str = "eval_init", final: str = "eval_final"
) -> DataFrame:
    """First and last evaluation of a metric side by side. Names are ``<prefix>_<metric>``."""
    # One prefix may start with the other, so the longer one is looked for first.
    phase, stem = F.lit(None).cast("string"), F.lit(None).cast("string")
    for prefix, name in sorted(((initial, "initial"), (final, "final")), key=lambda pair: len(pair[0])):
        has = F.startswith(F.col("name"), F.lit(prefix + "_"))
        phase = F.when(has, name).otherwise(phase)
        stem = F.when(has, F.substring("name", len(prefix) + 2, 2**31 - 1)).otherwise(stem)
    tables = metrics.withColumns({"_phase": phase, "metric": stem}).where(F.col("metric") != "")
    compared = tables.groupBy(*groups, "metric").agg(
        *[F.max(F.when(F.col("_phase") == name, F.col("value"))).alias(name) for name in ("initial", "final")]
    )
    return compared.withColumn("change", F.col("final") - F.col("initial"))


def parse_run_name(run_name: Column) -> Column:
    """struct<task, method, scenario, num_generations> of a run name; NULL if it has another form."""
    whole = f"^(?:{RUN_NAME_REGEX})$"
    parts = [F.regexp_extract(run_name, whole, i) for i in range(1, 5)]
    return F.when(
        F.regexp_like(run_name, F.lit(whole)),
        F.struct(
            parts[0].alias("task"),
            parts[1].alias("method"),
            parts[2].alias("scenario"),
            parts[3].try_cast("bigint").alias("num_generations"),
        ),
    )


def method_comparison(
    results: DataFrame,
    methods: Sequence[str],
    groups: Sequence[str] = ("task", "scenario", "num_generations"),
    run_name: str = "run_name",
) -> DataFrame:
    """One column per method with the mean result of its runs. The method names are given,
    so the pivot needs no extra pass to find them."""
    parsed = results.withColumn("_run", parse_run_name(F.col(run_name))).where(F.col("_run").isNotNull())
    parsed = parsed.select("value", "_run.*")
    return parsed.groupBy(*groups).agg(
        *[F.avg(F.when(F.col("method") == method, F.col("value"))).alias(method) for method in methods]
    )
