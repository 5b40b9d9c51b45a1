"""Scoring of predictions and the roll-up of scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuneframe.functions import labels as L
from tuneframe.functions import toolcalls
from tuneframe.functions.text import as_text

CLS_METRICS = ["accuracy", "parse_success"]
TOOL_METRICS = ["strict_match", "parse_success", "action_name_match"]


def pair_predictions(
    predictions: DataFrame, references: DataFrame, keys: Sequence[str] = ("example_id",)
) -> DataFrame:
    """Every prediction with its reference, by key. A prediction without one keeps NULLs, on
    which strict scoring fails. AQE splits a hot key of the prediction side. A task hashes its references and does not sort
    its predictions, which are many more."""
    return predictions.join(references.hint("shuffle_hash"), list(keys), "left")


def align_predictions(
    predictions: DataFrame, references: DataFrame, keys: Sequence[str] = ("example_id",)
) -> DataFrame:
    """:func:`pair_predictions` plus the references nobody predicted. ``status`` is ``ok``,
    ``missing_reference`` or ``missing_prediction``; no row of either side is lost.

    A left join and an anti join instead of one full outer join, because a hot key of a full
    outer join cannot be split.
    """
    keys = list(keys)
    paired = pair_predictions(predictions, references.withColumn("_found", F.lit(True)), keys).withColumn(
        "status", F.when(F.col("_found"), "ok").otherwise("missing_reference")
    )
    unused = references.join(predictions.select(*keys).distinct().hint("shuffle_hash"), keys, "left_anti")
    return paired.drop("_found").unionByName(
        unused.withColumn("status", F.lit("missing_prediction")), allowMissingColumns=True
    )


def require_aligned(aligned: DataFrame) -> None:
    """Raise unless every prediction has its reference and the other way round."""
    bad = aligned.where(F.col("status") != "ok").groupBy("status").count().collect()
    if bad:
        counts = ", ".join(f"{row['status']}: {row['count']}" for row in bad)
        raise ValueError(f"every prediction needs one reference: both sides must be of the same length ({counts})")


def evaluation_gaps(
    predictions: DataFrame, references: DataFrame, groups: Sequence[str] = ("run_id", "step"), key: str = "example_id"
) -> DataFrame:
    """Per group of predictions: ``n_missing`` references without a prediction, ``n_repeated`` predictions of an
    example beyond the first, ``n_unknown`` predicted examples without a reference.

    Only keys are read. A group that predicted nothing at all has no row.
    """
    known = references.select(key).distinct()
    per_key = predictions.groupBy(*groups, key).agg(F.count(F.lit(1)).alias("_n"))
    found = per_key.join(known.withColumn("_found", F.lit(True)), key, "left")
    hit = F.sum(F.when(F.col("_found"), 1).otherwise(0))
    return found.groupBy(*groups).agg(
        (known.agg(F.count(F.lit(1))).scalar() - hit).alias("n_missing"),
        F.sum(F.col("_n") - 1).alias("n_repeated"),
        (F.count(F.lit(1)) - hit).alias("n_unknown"),
    )


def require_complete(gaps: DataFrame) -> None:
    """Raise unless every group predicted every example exactly once."""
    bad = gaps.where("n_missing > 0 OR n_repeated > 0 OR n_unknown > 0")
    counts = bad.agg(
        F.count(F.lit(1)).alias("groups"), *[F.sum(c).alias(c) for c in ("n_missing", "n_repeated", "n_unknown")]
    ).first()
    if counts["groups"]:
        shown = ", ".join(f"{name}: {value}" for name, value in counts.asDict().items())
        raise ValueError(f"each group must give predictions of the same length as the references ({shown})")


def mixed_tasks(tables: dict[str, DataFrame]) -> DataFrame:
    """Per-task tables as one table with a ``task`` column; missing columns become NULL."""
    whole = None
    for task, table in tables.items():
        table = table.withColumn("task", F.lit(task))
        whole = table if whole is None else whole.unionByName(table, allowMissingColumns=True)
    return whole


def _score(flag: Column) -> Column:
    return F.when(flag, 1.0).otherwise(0.0)


def with_answers(predictions: DataFrame) -> DataFrame:
    """Replace ``prediction`` by its marked ``answers``. Done before the join with the
    references, so that whole texts are not shuffled."""
    return predictions.withColumn("answers", L.final_answers(F.col("prediction"))).drop("prediction")


def with_calls(predictions: DataFrame, engine: str = "arrow") -> DataFrame:
    """Replace ``prediction`` by its parsed ``calls``, before the join for the same reason."""
    return toolcalls.with_parsed_calls(predictions, engine=engine).drop("prediction")


def score_cls(aligned: DataFrame, strict: bool = True) -> DataFrame:
    """Add ``predicted_label, accuracy, parse_success`` to ``reference, task`` and either the
    ``prediction`` or its ``answers`` (:func:`with_answers`).

    Unknown tasks and unreadable references are errors; with ``strict=False`` such rows
    are kept with NULL scores, and the averages skip them.
    """
    task = L.normalize_task(F.col("task"), strict)
    gold = L.or_raise(
        L.normalize_label(F.col("reference"), F.col("_task")),
        F.concat(F.lit("invalid reference label: "), as_text(F.col("reference"))),
        strict,
    )
    answers = F.col("answers") if "answers" in aligned.columns else L.final_answers(F.col("prediction"))
    scored = (
        aligned.withColumn("_task", task)
        .withColumn("_gold", gold)
        .withColumn("predicted_label", L.pick_label(answers, F.col("_task")))
    )
    valid = F.col("_gold").isNotNull()
    return scored.withColumns(
        {
            "accuracy": F.when(valid, _score(F.col("predicted_label") == F.col("_gold"))),
            "parse_success": F.when(valid, _score(F.col("predicted_label").isNotNull())),
        }
    ).drop("_task", "_gold", "answers")


def parse_gold(references: DataFrame, golden_answer: str = "golden_answer", engine: str = "arrow") -> DataFrame:
    """Add the gold names and comparable arguments. Done on the reference table, so each
    gold answer is parsed once however many predictions refer to it."""
    steps = F.col(golden_answer)
    named = references.withColumn("gold_names", F.coalesce(toolcalls.expected_names(steps), F.array().cast("array<string>")))
    return toolcalls.with_expected_inputs(named, golden_answer, engine=engine)


def argument_routes(predictions: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """``groups, n, n_python``: predictions, and those of them that built-in expressions cannot read."""
    plain = toolcalls.plain_calls(F.coalesce("prediction", F.lit("")))
    return predictions.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(plain.isNull(), 1)).alias("n_python"))


def score_tool(aligned: DataFrame, strict: bool = True) -> DataFrame:
    """Add ``strict_match, parse_success, action_name_match``. A prediction without a reference raises, or has
    NULL scores with ``strict=False``.

    Takes the prediction as text or as ``calls`` (:func:`with_calls`) and gold as raw
    ``golden_answer`` steps or parsed (:func:`parse_gold`).
    """
    if "gold_names" not in aligned.columns:
        aligned = parse_gold(aligned)
    if "calls" not in aligned.columns:
        aligned = toolcalls.with_parsed_calls(aligned)
    has_gold = F.col("gold_names").isNotNull()
    if strict:
        has_gold = has_gold | F.raise_error(F.lit("a prediction has no reference")).cast("boolean")
    names = F.transform("calls.calls", lambda call: call["action"]) == F.col("gold_names")
    inputs = F.transform("calls.calls", lambda call: call["input"]) == F.col("gold_inputs")
    return aligned.withColumns(
        {
            "strict_match": F.when(has_gold, _score(names & inputs)),
            "parse_success": F.when(has_gold, _score(F.col("calls.ok"))),
            "action_name_match": F.when(has_gold, _score(names)),
        }
    ).drop("calls", "gold_names", "gold_inputs")


def roll_up(scored: DataFrame, metrics: Sequence[str], groups: Sequence[str], total_over: str | None = None) -> DataFrame:
    """Mean of each metric and row count per group; ``total_over`` adds rows that average
    over all values of that column (marked ``all``) in the same aggregation."""
    if total_over is not None:
        both = F.array(F.coalesce(F.col(total_over), F.lit("none")), F.lit("all"))
        scored = scored.withColumn(total_over, F.explode(both))
        groups = [*groups, total_over]
    return scored.groupBy(*groups).agg(
        *[F.avg(metric).alias(metric) for metric in metrics], F.count(F.lit(1)).alias("n")
    )


def eval_cls(scored: DataFrame, groups: Sequence[str] = (), prefix: str = "eval", task: str = "task") -> DataFrame:
    """Means per group and task and over all tasks, named ``<prefix>_small_data_<metric>``."""
    means = roll_up(scored, CLS_METRICS, groups, total_over=task)
    return means.withColumnsRenamed({m: f"{prefix}_small_data_{m}" for m in CLS_METRICS})


def eval_tool(scored: DataFrame, groups: Sequence[str], prefix: str = "eval") -> DataFrame:
    """Means per group, named ``<prefix>_tooluse_<metric>``."""
    means = roll_up(scored, TOOL_METRICS, groups)
    return means.withColumnsRenamed({m: f"{prefix}_tooluse_{m}" for m in TOOL_METRICS})
