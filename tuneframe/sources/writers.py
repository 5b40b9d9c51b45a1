"""Writers. Each overwrites exactly the partitions it writes, so a retried job replaces
its own output and nothing else."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneframe.functions import labels as L
from tuneframe.operators.ordering import drop_duplicate_prompts


def write_partitions(df: DataFrame, path: str, partitions: Sequence[str]) -> None:
    """Write under ``partitions``. The rebalance hint brings a partition's rows together, so
    it is not scattered over one small file per task, and AQE splits a hot one again."""
    (
        df.hint("rebalance", *partitions)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions)
        .parquet(path)
    )


def _as_logged(df: DataFrame, column: str):
    """Text of a prompt column, which may be a message list."""
    if column not in df.columns:
        return F.lit("")
    kind = df.schema[column].dataType.typeName()
    return F.to_json(column) if kind == "array" else F.coalesce(F.col(column), F.lit(""))


def example_table(aligned: DataFrame) -> DataFrame:
    """Logged evaluation examples of label tasks from ``step, prompt, teacher_prompt,
    prediction, reference, task``."""
    task = L.normalize_task(F.col("task"))
    return aligned.select(
        F.col("step").cast("string").alias("step"),
        _as_logged(aligned, "prompt").alias("student_input"),
        _as_logged(aligned, "teacher_prompt").alias("teacher_input"),
        F.coalesce("prediction", F.lit("")).alias("completion"),
        L.parse_final_label(F.coalesce("prediction", F.lit("")), task).alias("predicted_label"),
        F.col("reference").alias("gold_label"),
    )


def write_examples(aligned: DataFrame, path: str) -> None:
    write_partitions(example_table(aligned), path, ["step"])


def example_table_tooluse(aligned: DataFrame) -> DataFrame:
    return aligned.select(
        F.col("step").cast("string").alias("step"),
        _as_logged(aligned, "prompt").alias("student_input"),
        _as_logged(aligned, "teacher_prompt").alias("teacher_input"),
        F.coalesce("prediction", F.lit("")).alias("completion"),
        F.coalesce(F.to_json("golden_answer"), F.lit("[]")).alias("gold_tool_calls"),
    )


def write_examples_tooluse(aligned: DataFrame, path: str) -> None:
    write_partitions(example_table_tooluse(aligned), path, ["step"])


def completion_table(
    rows: DataFrame,
    rewards: Sequence[str] = (),
    eval_only: bool = True,
    unique_prompts: bool = False,
    order: str = "ordinal",
) -> DataFrame:
    """Logged completions: ``mode, step, prompt, student_input, teacher_input, completion``,
    one column per reward, ``advantage`` and, when present, ``images``."""
    if eval_only:
        rows = rows.where(F.col("mode") == "eval")
    if unique_prompts:
        rows = drop_duplicate_prompts(rows, order)
    columns = [
        "mode",
        F.col("step").cast("string").alias("step"),
        "prompt",
        (F.col("student_input") if "student_input" in rows.columns else F.col("prompt")).alias("student_input"),
        (F.col("teacher_input") if "teacher_input" in rows.columns else F.col("prompt")).alias("teacher_input"),
        "completion",
        *rewards,
        "advantage",
    ]
    if "images" in rows.columns:
        columns.append("images")
    return rows.select(*columns)


def write_completions(rows: DataFrame, path: str, **options) -> None:
    write_partitions(completion_table(rows, **options), path, ["mode", "step"])


def metric_lines(metrics: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Log lines ``[tag] {json}``, one per group and tag, with the metric names in order.
    A group is one evaluation, so it holds a handful of names."""
    entries = F.sort_array(F.collect_list(F.struct("name", "value")))
    return (
        metrics.groupBy(*groups, "tag")
        .agg(F.to_json(F.map_from_entries(entries)).alias("_json"))
        .select(*groups, F.concat(F.lit("["), "tag", F.lit("] "), "_json").alias("value"))
    )


def write_run_log(metrics: DataFrame, path: str, run: str = "run_name") -> None:
    """Write the metric lines of each run to a folder of its own, in place of what the run had there: a
    repeated write leaves the same lines. Other runs' folders stay."""
    lines = metric_lines(metrics, [run]).hint("rebalance", run)
    lines.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run).text(path)


def write_json_arrays(df: DataFrame, path: str) -> None:
    """Rows as JSON arrays, one array file per task that has rows; the rows of a partition keep their order."""

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A row is held back until it is known whether a comma or the closing bracket follows.
        held = None
        for batch in batches:
            lines = []
            for value in batch.column(0).to_pylist():
                lines.append("[" if held is None else f"{held},")
                held = value
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held, "]"], pa.string())], ["value"])

    df.select(F.to_json(F.struct("*")).alias("value")).mapInArrow(framed, "value string").write.text(path)


def land_tooluse(df: DataFrame, path: str) -> None:
    """Tool-use rows as parquet, the splittable form of a JSON array file."""
    df.write.mode("overwrite").parquet(path)


def save_token_table(
    df: DataFrame, table: str, buckets: int, keys: Sequence[str] = ("run_id", "seq_id", "pos"), path: str | None = None
) -> None:
    """Bucketed table of token rows: two tables saved with the same keys and bucket count
    join without shuffling their vectors. Rows that are already partitioned by the keys into ``buckets`` give one sorted file a bucket,
    and then the join does not sort either. ``path`` puts the files elsewhere than the warehouse."""
    writer = df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)
