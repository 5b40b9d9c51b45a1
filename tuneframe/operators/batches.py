"""Batch plans as tables: which row stands where, in which batch, how often."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tuneframe.functions import arrays
from tuneframe.operators.ordering import shuffle_key


# Batches whose plan one row stands for until it is expanded.
BATCH_RUN = 4096
# Rows of whole batches that a task of by_batch takes, about.
TASK_ROWS = 1 << 18


@dataclass(frozen=True)
class BatchPlan:
    """Sizes of a batch plan. Use :func:`batch_plan` to derive and check them."""

    generation_batch_size: int
    steps_per_generation: int
    num_generations: int = 1
    num_iterations: int = 1
    num_processes: int = 1

    @property
    def per_device_batch(self) -> int:
        """Rows that one process takes at once."""
        return self.generation_batch_size // (self.steps_per_generation * self.num_processes)

    @property
    def chunk(self) -> int:
        """Distinct prompts per generation batch."""
        return self.generation_batch_size // self.num_generations

    @property
    def repeats(self) -> int:
        """Times each chunk is emitted."""
        return self.num_iterations * self.steps_per_generation

    @property
    def rows_per_chunk(self) -> int:
        return self.chunk * self.num_generations * self.repeats


def batch_plan(
    per_device_batch: int,
    accumulation_steps: int,
    num_generations: int = 1,
    num_iterations: int = 1,
    num_processes: int = 1,
    generation_batch_size: int | None = None,
    steps_per_generation: int | None = None,
) -> BatchPlan:
    """Derive the sizes that are not given and reject combinations that do not fit."""
    global_batch = per_device_batch * num_processes
    if global_batch <= 0 or num_generations < 1 or num_iterations < 1:
        raise ValueError("batch size, processes, generations and iterations must be positive")
    if generation_batch_size is not None and steps_per_generation is not None:
        raise ValueError("set generation_batch_size or steps_per_generation, not both")
    if generation_batch_size is None:
        steps_per_generation = steps_per_generation or accumulation_steps
        generation_batch_size = global_batch * steps_per_generation
    elif generation_batch_size % global_batch:
        raise ValueError(f"generation_batch_size must be divisible by the global batch size ({global_batch})")
    else:
        steps_per_generation = generation_batch_size // global_batch
    if generation_batch_size % num_generations:
        raise ValueError(f"generation_batch_size must be divisible by num_generations ({num_generations})")
    return BatchPlan(generation_batch_size, steps_per_generation, num_generations, num_iterations, num_processes)


def repeat_sampler(
    rows: DataFrame, plan: BatchPlan, pos: str = "pos", drop_incomplete: bool = True, counted: DataFrame | None = None
) -> DataFrame:
    """One row per (row, repetition, generation) with its ``ordinal`` in the sampling order.

    ``pos`` is a dense 0-based position. Ordinals follow by arithmetic, so the plan is a
    narrow expansion: no sort and no shuffle. Rows of an incomplete last chunk are dropped
    on request; :func:`sampler_summary` reports how many. Their number follows from the row
    count; pass the table before it was numbered as ``counted`` to count that instead.
    """
    chunk, slot = F.floor(F.col(pos) / plan.chunk).cast("bigint"), F.col(pos) % plan.chunk
    size = (rows if counted is None else counted).agg(F.count(F.lit(1))).scalar()
    width = F.lit(plan.chunk)
    if drop_incomplete:
        rows = rows.where(F.col(pos) < size - size % plan.chunk)
    else:  # the last chunk may be smaller; its ordinals are dense too
        width = F.least(width, size - F.col("chunk") * plan.chunk)
    return (
        rows.withColumn("chunk", chunk)
        .withColumn("slot", slot)
        .withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(plan.repeats - 1))))
        .withColumn("generation", F.explode(F.sequence(F.lit(0), F.lit(plan.num_generations - 1))))
        .withColumn(
            "ordinal",
            F.col("chunk") * plan.rows_per_chunk
            + F.col("repeat") * width * plan.num_generations
            + F.col("slot") * plan.num_generations
            + F.col("generation"),
        )
    )


def sampler_summary(rows: DataFrame, plan: BatchPlan) -> DataFrame:
    """Rows kept and dropped by the plan, and the number of plan rows."""
    n = F.count(F.lit(1))
    return rows.agg(
        n.alias("n_rows"),
        (n % plan.chunk).alias("n_dropped"),
        ((n - n % plan.chunk) * (plan.num_generations * plan.repeats)).alias("n_plan_rows"),
    )


def eval_sampler(rows: DataFrame, pos: str = "pos") -> DataFrame:
    """Stored order, every row once."""
    return rows.withColumn("ordinal", F.col(pos))


def generation_batches(
    sampled: DataFrame, per_device_batch: int, steps_per_generation: int, ordinal: str = "ordinal"
) -> DataFrame:
    """Batch a loader hands out: ``per_device_batch * steps_per_generation`` ordinals."""
    size = per_device_batch * steps_per_generation
    return sampled.withColumn("batch_id", F.floor(F.col(ordinal) / size).cast("bigint"))


def by_batch(batched: DataFrame, n_rows: int, batch: str = "batch_id") -> DataFrame:
    """Rows dealt by batch to tasks of about ``TASK_ROWS``, of ``n_rows`` in all. What is grouped by batch afterwards, distinct counts
    too, takes a task's memory for that many rows, however large the plan is."""
    return batched.repartition(max(1, -(-n_rows // TASK_ROWS)), batch)


def microbatch_slices(n_rows: Column, plan: BatchPlan, seed: int | str, spark) -> DataFrame:
    """Shuffle each batch that a process's loader hands out and cut it into equal slices.

    (ordinal, batch_id, process, slice) of all ordinals below ``n_rows``, a one-row number such as
    ``sampled.agg(count).scalar()``. A batch is ``per_device_batch * steps_per_generation``
    ordinals, so its rows follow from its number: each is made, shuffled and cut on its own, and
    plan rows are never exchanged.
    """
    size = plan.per_device_batch * plan.steps_per_generation
    one = spark.range(1).select(F.ceil(n_rows / size).cast("bigint").alias("n"), n_rows.cast("bigint").alias("_rows"))
    # Batches in runs, so that tasks of a few runs share the work.
    runs = one.select("_rows", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / BATCH_RUN))).alias("_run")).where("n > 0")
    runs = runs.repartitionByRange("_run")
    last = F.least((F.col("_run") + 1) * BATCH_RUN, F.col("n")) - 1
    batches = runs.select("_rows", F.explode(F.sequence(F.col("_run") * BATCH_RUN, last)).alias("batch_id"))
    start = F.col("batch_id") * size
    ordinals = F.sequence(start, F.least(start + size, F.col("_rows")) - 1)

    def keyed(ordinal):
        return F.struct(shuffle_key(seed, F.concat_ws(":", F.col("batch_id"), ordinal)).alias("k"), ordinal.alias("o"))

    placed = batches.select("batch_id", F.posexplode(F.array_sort(F.transform(ordinals, keyed))).alias("at", "row"))
    return placed.select(
        F.col("row.o").alias("ordinal"),
        "batch_id",
        (F.col("batch_id") % plan.num_processes).alias("process"),
        F.floor(F.col("at") / plan.per_device_batch).cast("bigint").alias("slice"),
    )


def step_schedule(steps: DataFrame, plan: BatchPlan, step: str = "step") -> DataFrame:
    """Which generation and which slice a training step uses, and whether it generates anew."""
    every = plan.repeats
    return steps.select(
        "*",
        F.floor(F.col(step) / every).cast("bigint").alias("generation_id"),
        (F.col(step) % plan.steps_per_generation).alias("slice"),
        (F.col(step) % every == 0).alias("regenerate"),
    )


def padded_batches(
    rows: DataFrame, batch: str, prompt_ids: str, completion_ids: str, pad: int, eos: int, mask_truncated: bool = False
) -> DataFrame:
    """Fixed-width export of a batch: left-padded prompts, right-padded completions, masks
    and their concatenation, padded to the longest sequence of the batch. A batch is small, so its rows
    meet once, in a window over the batch: one scan and one exchange."""
    own = Window.partitionBy(batch)
    widths = {"_p": F.max(F.size(prompt_ids)).over(own), "_c": F.max(F.size(completion_ids)).over(own)}
    p, c = F.col(prompt_ids), F.col(completion_ids)
    completion_mask = arrays.ones(c)
    if mask_truncated:
        completion_mask = arrays.truncated_mask(completion_mask, c, eos, pad)
    return (
        rows.withColumns(widths)
        .withColumn("prompt_mask", arrays.pad_left(arrays.ones(p), F.col("_p"), 0))
        .withColumn("completion_mask", arrays.pad_right(completion_mask, F.col("_c"), 0))
        .withColumn(prompt_ids, arrays.pad_left(p, F.col("_p"), pad))
        .withColumn(completion_ids, arrays.pad_right(c, F.col("_c"), pad))
        .withColumn("input_ids", F.concat(prompt_ids, completion_ids))
        .withColumn("attention_mask", F.concat("prompt_mask", "completion_mask"))
        .drop("_p", "_c")
    )


def normalize_images(df: DataFrame, batch: str) -> DataFrame:
    """``images`` per row as a list, NULL for a batch without any, and ``num_images``.

    A table with an ``images`` column uses it; one with only ``image`` wraps the single
    reference. A batch in which every list is empty has no images.
    """
    if "images" in df.columns:
        images = F.col("images")
    elif "image" in df.columns:
        images = F.when(F.col("image").isNotNull(), F.array("image"))
    else:
        return df.withColumns({"images": F.lit(None).cast("array<string>"), "num_images": F.lit(None).cast("int")})
    df = df.withColumn("images", images)
    empty = df.groupBy(batch).agg(
        F.min(F.coalesce(F.size("images") == 0, F.lit(False)).cast("int")).alias("_empty")
    )
    kept = F.when(F.col("_empty") == 0, F.col("images"))
    return (
        df.join(empty, batch)
        .withColumn("images", kept)
        .withColumn("num_images", F.when(F.col("images").isNotNull(), F.size("images")))
        .drop("_empty")
    )
