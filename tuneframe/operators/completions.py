"""Completion statistics per batch of generated sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tuneframe.functions.arrays import is_truncated

BATCH = ["run_id", "mode", "step", "batch_id"]


def completion_stats(
    rows: DataFrame, eos: int, pad: int, groups: Sequence[str] = tuple(BATCH), ids: str = "completion_ids"
) -> DataFrame:
    """Lengths, share of cut-off sequences and lengths of the finished ones, in one pass.

    An empty completion has no last token: it is neither cut off nor finished and is
    counted in ``n_empty``. Without a finished sequence the finished lengths are 0.
    """
    sizes = rows.select(
        *groups,
        F.size(ids).alias("_len"),
        is_truncated(F.col(ids), eos, pad).alias("_cut"),
    )
    finished = F.when(~F.col("_cut"), F.col("_len"))
    return sizes.groupBy(*groups).agg(
        F.avg("_len").alias("mean_length"),
        F.min("_len").alias("min_length"),
        F.max("_len").alias("max_length"),
        F.avg(F.col("_cut").cast("double")).alias("clipped_ratio"),
        F.coalesce(F.avg(finished), F.lit(0.0)).alias("mean_terminated_length"),
        F.coalesce(F.min(finished), F.lit(0)).alias("min_terminated_length"),
        F.coalesce(F.max(finished), F.lit(0)).alias("max_terminated_length"),
        F.count_if(F.col("_cut").isNull()).alias("n_empty"),
        F.count(F.lit(1)).alias("n_sequences"),
    )


def completion_lengths(rows: DataFrame, eos: int, pad: int, **kw) -> DataFrame:
    return completion_stats(rows, eos, pad, **kw).drop(
        "clipped_ratio", "mean_terminated_length", "min_terminated_length", "max_terminated_length", "n_empty"
    )


def clipped_ratio(rows: DataFrame, eos: int, pad: int, **kw) -> DataFrame:
    return completion_stats(rows, eos, pad, **kw).select(
        *kw.get("groups", BATCH), "clipped_ratio", "n_empty", "n_sequences"
    )


def terminated_lengths(rows: DataFrame, eos: int, pad: int, **kw) -> DataFrame:
    return completion_stats(rows, eos, pad, **kw).select(
        *kw.get("groups", BATCH), "mean_terminated_length", "min_terminated_length", "max_terminated_length"
    )


def token_totals(rows: DataFrame, prompt_ids: str = "prompt_ids", completion_ids: str = "completion_ids") -> DataFrame:
    """Prompt and completion tokens per (run, mode, step) and the running total of a run.

    Only training steps add to the total; an evaluation row shows the total reached before
    it. The window runs over one row per step, not over sequences.
    """
    per_step = (
        rows.select("run_id", "mode", "step", F.size(prompt_ids).alias("_p"), F.size(completion_ids).alias("_c"))
        .groupBy("run_id", "mode", "step")
        .agg(F.sum("_p").alias("prompt_tokens"), F.sum("_c").alias("completion_tokens"))
    )
    spent = F.when(F.col("mode") == "train", F.col("prompt_tokens") + F.col("completion_tokens")).otherwise(0)
    # Evaluation of a step reads the total after the step's training rows: "train" first.
    order = Window.partitionBy("run_id").orderBy("step", F.col("mode") != "train")
    return per_step.withColumn(
        "num_tokens", F.sum(spent).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )


def mean_reward(rows: DataFrame, groups: Sequence[str], reward: str = "reward", mask: str = "mask") -> DataFrame:
    """Mean reward over unmasked completion tokens (one row per token), 0 when there is none."""
    kept = F.when(F.col(mask) == 1, F.col(reward))
    return rows.groupBy(*groups).agg(F.coalesce(F.avg(kept), F.lit(0.0)).alias("mean_reward"))
