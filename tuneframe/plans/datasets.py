"""Training and evaluation tables.

Each builder is one narrow job: raw rows in, finished rows out, no shuffle except the join
with a few-shot manifest, which is checked first. The order of a training split is the column ``shuffle_key`` (with
``row_idx`` as tie-breaker); sort or number by it only where an order is really consumed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuneframe.constants import SIGNATURE_COLUMNS, TASK_LABELS
from tuneframe.functions import labels as L
from tuneframe.functions import prompts as P
from tuneframe.functions.text import as_text
from tuneframe.operators.ordering import shuffle_key
from tuneframe.operators.subset import fewshot_subset, require_manifest

DEFAULT_SEED = 42


def known_task(task: str) -> str:
    name = task.strip().lower()
    if name not in TASK_LABELS:
        raise ValueError(f"unsupported task '{task}', expected one of {sorted(TASK_LABELS)}")
    return name


def prune_columns(df: DataFrame) -> DataFrame:
    """Only the columns a training step reads."""
    return df.select(*[name for name in SIGNATURE_COLUMNS if name in df.columns])


def _order(seed: int | None) -> dict[str, Column]:
    columns = {"row_idx": F.col("row_idx")}
    if seed is not None:
        columns["shuffle_key"] = shuffle_key(seed, F.col("row_idx"))
    return columns


def _select(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.select(*[column.alias(name) for name, column in columns.items()])


def _split_pair(train: DataFrame, evaluation: DataFrame, manifest: DataFrame | None):
    if manifest is None:
        return train, evaluation
    require_manifest(train, manifest)
    return fewshot_subset(train, manifest).drop("pos"), evaluation


def _label_columns(task: str, messages: bool) -> tuple[dict[str, Column], dict[str, Column]]:
    prompt = P.render_prompt(task)
    label = L.label_name(F.lit(task), F.col("label"))
    teacher = P.teacher_prompt_label(prompt, label)
    train = {
        "prompt": P.user_message(prompt) if messages else prompt,
        **({} if messages else {"completion": P.gold_completion(label)}),
        "teacher_prompt": P.user_message(teacher) if messages else teacher,
    }
    return train, {**train, "eval_label": label, "eval_task": F.lit(task)}


def _tool_columns(messages: bool) -> tuple[dict[str, Column], dict[str, Column]]:
    prompt = as_text(F.col("prompt"))
    call = P.render_tool_call(F.col("golden_answer"), F.col("golden_response"))
    teacher = P.teacher_prompt_tool(prompt, call)
    train = {
        "prompt": P.user_message(prompt) if messages else prompt,
        **({} if messages else {"completion": call}),
        "teacher_prompt": P.user_message(teacher) if messages else teacher,
    }
    return train, {**train, "golden_answer": F.col("golden_answer")}


def _build(train, evaluation, manifest, seed, columns):
    train, evaluation = _split_pair(train, evaluation, manifest)
    train_columns, eval_columns = columns
    return _select(train, {**_order(seed), **train_columns}), _select(evaluation, {**_order(None), **eval_columns})


def build_distil_cls(task: str, train: DataFrame, evaluation: DataFrame, seed: int = DEFAULT_SEED, manifest=None):
    """(train, eval) with message-list prompts and teacher prompts for self-distillation."""
    return _build(train, evaluation, manifest, seed, _label_columns(known_task(task), messages=True))


def build_sft_cls(task: str, train: DataFrame, evaluation: DataFrame, seed: int = DEFAULT_SEED, manifest=None):
    """(train, eval) with text prompts and gold completions for supervised fine-tuning."""
    return _build(train, evaluation, manifest, seed, _label_columns(known_task(task), messages=False))


def build_distil_tool(train: DataFrame, evaluation: DataFrame, seed: int = DEFAULT_SEED, manifest=None):
    return _build(train, evaluation, manifest, seed, _tool_columns(messages=True))


def build_sft_tool(train: DataFrame, evaluation: DataFrame, seed: int = DEFAULT_SEED, manifest=None):
    return _build(train, evaluation, manifest, seed, _tool_columns(messages=False))


def split_union(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Both splits in one table with a ``split`` column, to be partitioned by it."""
    return train.withColumn("split", F.lit("train")).unionByName(
        evaluation.withColumn("split", F.lit("validation")), allowMissingColumns=True
    )
