"""Fine-tuning data, evaluation and token analytics as Spark jobs.

The dataset builders and scorers most users need are importable from here; the full surface
is in ``tuneframe.operators``, ``tuneframe.sources``, ``tuneframe.functions``,
``tuneframe.plans`` and ``tuneframe.streaming``.
"""

from tuneframe.operators.leakage import assert_no_leaks, leak_cross, leak_report
from tuneframe.operators.scoring import (
    align_predictions,
    eval_cls,
    eval_tool,
    mixed_tasks,
    pair_predictions,
    score_cls,
    score_tool,
)
from tuneframe.operators.subset import one_per_name
from tuneframe.plans.datasets import build_distil_cls, build_distil_tool, build_sft_cls, build_sft_tool
from tuneframe.plans.evaluation import evaluate
from tuneframe.session import build_session

__all__ = [
    "align_predictions",
    "assert_no_leaks",
    "build_distil_cls",
    "build_distil_tool",
    "build_session",
    "build_sft_cls",
    "build_sft_tool",
    "eval_cls",
    "eval_tool",
    "evaluate",
    "leak_cross",
    "leak_report",
    "mixed_tasks",
    "one_per_name",
    "pair_predictions",
    "score_cls",
    "score_tool",
]
