"""Readers. Every schema is explicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tuneframe import schemas
from tuneframe.constants import METRIC_LINE_REGEX
from tuneframe.sources.json_rows import read_json_rows


def read_tooluse(spark: SparkSession, path: str, multi_line: bool = False, row_idx: str | None = None) -> DataFrame:
    """Tool-use rows, from JSON lines or (``multi_line``) from files that hold one JSON array each. Both are read by many
    tasks a file; see :mod:`.json_rows` for how an array is cut. ``row_idx`` adds the position of a row in its array."""
    if multi_line:
        return read_json_rows(spark, path, schemas.TOOLUSE_RAW, row_idx)
    if row_idx is not None:
        raise ValueError("lines have no position; write them as parquet and use with_row_idx")
    return spark.read.schema(schemas.TOOLUSE_RAW).json(path)


def read_task_splits(spark: SparkSession, path: str, task: str, split: str | None = None) -> DataFrame:
    """Rows of one task (and split) from a table partitioned by ``task, split``; other
    partitions are not listed into the scan."""
    rows = spark.read.parquet(f"{path}").where(F.col("task") == task)
    return rows if split is None else rows.where(F.col("split") == split)


def read_fewshot_manifest(
    spark: SparkSession, path: str, task: str | None = None, multi_line: bool = True, large: bool = False
) -> DataFrame:
    """``task, pos, row_idx`` of a curated index file, or of many as JSON lines. ``large`` files, each an array of such
    entries or entries one after the other, are read by many tasks.

    ``row_idx`` is NULL for an entry that is not an integer (1.0, "1" and true are not).
    Asking for a task the file does not describe is an error.
    """
    if large:
        raw = read_json_rows(spark, path, schemas.FEWSHOT_MANIFEST)
    else:
        raw = spark.read.schema(schemas.FEWSHOT_MANIFEST).json(path, multiLine=multi_line)
    tasks = raw.select(F.explode("tasks").alias("task", "entry"))
    if task is not None:
        tasks = tasks.where(F.col("task") == task)
        kinds = [row["kind"] for row in tasks.select(_kind("entry.train_indices").alias("kind")).limit(2).collect()]
        if not kinds:
            raise ValueError(f"few-shot index file does not contain a task entry for '{task}'")
        if kinds[0] is None or not kinds[0].startswith("ARRAY"):
            raise ValueError(f"task '{task}' must provide 'train_indices' as a list")
    entries = F.try_variant_get("entry.train_indices", "$", "array<variant>")
    indices = tasks.select("task", F.posexplode(entries).alias("pos", "_index"))
    return indices.select(
        "task",
        F.col("pos").cast("bigint").alias("pos"),
        F.when(_kind("_index") == "BIGINT", F.try_variant_get("_index", "$", "bigint")).alias("row_idx"),
    )


def _kind(column: str) -> Column:
    return F.schema_of_variant(F.col(column))


def parse_metric_lines(lines: DataFrame, run: Column) -> DataFrame:
    """``run_name, tag, name, value`` from text lines ``[tag] {json}``; other lines are skipped.

    Works the same on a static and on a streaming DataFrame.
    """
    metrics = F.from_json(F.regexp_extract("value", METRIC_LINE_REGEX, 2), "map<string,string>")
    return (
        lines.where(F.regexp_like("value", F.lit(METRIC_LINE_REGEX)))
        .select(
            run.alias("run_name"), F.regexp_extract("value", METRIC_LINE_REGEX, 1).alias("tag"), F.explode_outer(metrics)
        )
        .where(F.col("key").isNotNull())
        .select("run_name", "tag", F.col("key").alias("name"), F.expr("try_cast(value as double)").alias("value"))
    )


def run_of_path(path: Column, pattern: str = r"([^/]+?)(?:_\d{8}_\d{6})?\.log$") -> Column:
    """Run name from a log file's path; by default the file name without its time stamp."""
    return F.regexp_extract(path, pattern, 1)


def read_run_log(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    run = run_of_path(F.col("_metadata.file_path"), *([pattern] if pattern else []))
    return parse_metric_lines(lines, run)


def with_row_idx(df: DataFrame, path_order: str = "_metadata.file_path") -> DataFrame:
    """Stored order of a parquet table as a dense ``row_idx``, over any number of files.

    The file's own row index is the position inside it; the files' sizes, added up in path
    order, are the offsets. Whole paths, because the files of one job have the same name in every
    partition folder. The sizes, one row per file, meet in one task.
    """
    placed = df.select("*", F.col(path_order).alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = placed.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"), F.lit(0).alias("_all"))
    before = Window.partitionBy("_all").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        placed.join(offsets, "_file")
        .withColumn("row_idx", F.col("_offset") + F.col("_row"))
        .drop("_file", "_row", "_offset")
    )
