"""Few-shot subsets and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuneframe.functions.text import as_text, strip


def fewshot_subset(rows: DataFrame, manifest: DataFrame, row_id: str = "row_idx") -> DataFrame:
    """Rows named by the manifest ``(row_idx, pos)``; ``pos`` carries the manifest's order."""
    return rows.join(manifest.select(row_id, "pos"), row_id)


def join_manifest(rows: DataFrame, manifest: DataFrame, task: str = "task", row_id: str = "row_idx") -> DataFrame:
    """All tasks at once: rows named by the manifest ``(task, row_idx, pos)``."""
    return rows.join(manifest.select(task, row_id, "pos"), [task, row_id])


def check_indices(
    manifest: DataFrame, rows: DataFrame, groups: list[str], expected: Column | int | None = None, row_id: str = "row_idx"
) -> DataFrame:
    """One row per (group, check): ``check, ok, detail``.

    Checks: the index list is not empty, holds integers only (NULL marks another type),
    has no duplicates, lies within ``[0, n-1]`` of its group's rows and, when ``expected``
    is given, has that many entries. Groups come from the rows, so a group without any
    index is reported too.
    """
    sizes = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_rows"))
    # Per distinct index first: repeats of one index collapse before the shuffle.
    per_index = manifest.groupBy(*groups, row_id).agg(F.count(F.lit(1)).alias("n"))
    lists = per_index.groupBy(*groups).agg(
        F.sum("n").alias("n_index"),
        F.sum(F.when(F.col(row_id).isNull(), F.col("n")).otherwise(0)).alias("n_other"),
        F.sum(F.when(F.col(row_id).isNotNull(), F.col("n") - 1).otherwise(0)).alias("n_repeat"),
        F.min(row_id).alias("low"),
        F.max(row_id).alias("high"),
    )
    joined = sizes.join(lists, groups, "left").fillna(0, ["n_index", "n_other", "n_repeat"])
    outside = (F.col("low") < 0) | (F.col("high") >= F.col("n_rows"))
    checks = {
        "non_empty": (F.col("n_index") > 0, F.col("n_index")),
        "integers": (F.col("n_other") == 0, F.col("n_other")),
        "no_duplicates": (F.col("n_repeat") == 0, F.col("n_repeat")),
        "in_range": (~F.coalesce(outside, F.lit(False)), F.col("n_rows") - 1),
    }
    if expected is not None:
        expected = expected if isinstance(expected, Column) else F.lit(expected)
        checks["expected_count"] = (F.col("n_index") == expected, F.col("n_index"))
    report = F.array(
        *[
            F.struct(F.lit(name).alias("check"), ok.alias("ok"), detail.cast("bigint").alias("detail"))
            for name, (ok, detail) in checks.items()
        ]
    )
    return joined.select(*groups, F.inline(report))


INDEX_ERRORS = {
    "non_empty": "the manifest is there but names no row; it has to be non-empty",
    "integers": "{detail} entries of the manifest are no integers",
    "no_duplicates": "the manifest holds duplicates: {detail} entries repeat another",
    "in_range": "every manifest entry has to lie within [0, {detail}]",
    "expected_count": "the manifest names {detail} rows, not the expected number",
}


def require_indices(report: DataFrame) -> None:
    """Raise on the first failed check of a :func:`check_indices` report, in the order of the checks."""
    failed = report.where(~F.col("ok")).groupBy("check").agg(F.max("detail").alias("detail")).collect()
    details = {row["check"]: row["detail"] for row in failed}
    for check, message in INDEX_ERRORS.items():
        if check in details:
            raise ValueError(message.format(detail=details[check]))


def require_manifest(rows: DataFrame, manifest: DataFrame, row_id: str = "row_idx") -> None:
    """Raise unless the manifest ``(row_idx, pos)`` names distinct existing rows, one at least."""
    whole = F.lit(0).alias("_all")
    require_indices(check_indices(manifest.select(whole, row_id), rows.select(whole), ["_all"], row_id=row_id))


def one_per_name(rows: DataFrame, name: str = "name", row_id: str = "row_idx") -> DataFrame:
    """First row index of every non-blank trimmed name.

    The name is the order column of the selection: rename it to ``pos`` to use the result
    as the manifest of :func:`fewshot_subset`.
    """
    trimmed = strip(as_text(F.col(name)))
    return (
        rows.select(trimmed.alias(name), row_id)
        .where(F.col(name) != "")
        .groupBy(name)
        .agg(F.min(row_id).alias(row_id))
    )


def count_prototypes(rows: DataFrame, groups: list[str], name: str = "name") -> DataFrame:
    """Distinct non-blank names per group."""
    trimmed = strip(as_text(F.col(name)))
    return (
        rows.select(*groups, trimmed.alias(name))
        .where(F.col(name) != "")
        .groupBy(*groups)
        .agg(F.countDistinct(name).alias("n_prototypes"))
    )


def resolve_fewshot(
    task: str, indices_file: str | None, one_per_name_flag: bool, supported: tuple[str, ...]
) -> str | None:
    """Which few-shot source the options select: ``manifest``, ``one_per_name`` or none."""
    if one_per_name_flag:
        if task != "tooluse":
            raise ValueError("one example per name is only defined for the tooluse task")
        if indices_file is not None:
            raise ValueError("use either an index file or one example per name, not both")
        return "one_per_name"
    if indices_file is None:
        return None
    if task not in supported:
        raise ValueError(f"an index file is only supported for: {', '.join(supported)}")
    return "manifest"
