"""One evaluation from audit to metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneframe.operators import leakage, scoring


def task_kind(eval_table: DataFrame) -> str:
    """``labels`` or ``tool``, from the columns of the table."""
    columns = set(eval_table.columns)
    if {"eval_label", "eval_task"} <= columns:
        return "labels"
    if "golden_answer" in columns:
        return "tool"
    raise ValueError("an evaluation table needs eval_label and eval_task, or golden_answer")


def evaluate(
    eval_table: DataFrame,
    predictions: DataFrame,
    groups: Sequence[str] = ("run_id", "step"),
    prefix: str = "eval",
    key: str = "example_id",
    audit: bool = True,
    complete: bool = True,
) -> DataFrame:
    """Metrics per group of ``predictions`` (``key, prediction`` and the groups).

    The audit raises before anything is scored when a prompt gives its answer away. With
    ``complete`` every group must predict every example exactly once, else this raises;
    :func:`scoring.evaluation_gaps` shows what is amiss. Without it each example counts once per
    prediction row. Predictions are parsed and gold columns picked
    before the join, so neither prompts nor answer texts are shuffled.
    """
    kind = task_kind(eval_table)
    if audit:
        leakage.assert_no_leaks(eval_table, key)
    if complete:
        scoring.require_complete(scoring.evaluation_gaps(predictions, eval_table, groups, key))
    if kind == "labels":
        gold = eval_table.select(key, F.col("eval_label").alias("reference"), F.col("eval_task").alias("task"))
        scored = scoring.score_cls(scoring.pair_predictions(scoring.with_answers(predictions), gold, [key]))
        return scoring.eval_cls(scored, groups, prefix)
    gold = scoring.parse_gold(eval_table.select(key, "golden_answer")).drop("golden_answer")
    scored = scoring.score_tool(scoring.pair_predictions(scoring.with_calls(predictions), gold, [key]))
    return scoring.eval_tool(scored, groups, prefix)
