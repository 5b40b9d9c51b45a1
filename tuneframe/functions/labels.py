"""Task names and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tuneframe.constants import FINAL_LABEL_REGEX, TASK_LABELS
from tuneframe.functions.text import as_text, strip


def _by_task(task: Column, value_of) -> Column:
    """One branch per known task; NULL for any other."""
    branches = None
    for name, labels in TASK_LABELS.items():
        value = value_of(labels)
        branches = F.when(task == name, value) if branches is None else branches.when(task == name, value)
    return branches


def or_raise(value: Column, message: Column, strict: bool) -> Column:
    """The value, or an error at run time when it is NULL and ``strict`` is set."""
    return F.coalesce(value, F.raise_error(message)) if strict else value


def normalize_task(task: Column, strict: bool = False) -> Column:
    name = F.lower(strip(task))
    known = F.when(name.isin(*TASK_LABELS), name)
    return or_raise(known, F.concat(F.lit("unsupported task: "), as_text(task)), strict)


def label_name(task: Column, label_id: Column, strict: bool = True) -> Column:
    """Label text of an id; an id outside the task's range is an error (NULL if not strict)."""
    position = label_id.cast("int")
    name = _by_task(
        task,
        lambda labels: F.when(
            position.between(0, len(labels) - 1),
            F.element_at(F.array(*[F.lit(label) for label in labels]), position + 1),
        ),
    )
    message = F.concat(F.lit("invalid label id "), as_text(label_id), F.lit(" for task "), as_text(task))
    return or_raise(name, message, strict)


def normalize_label(text: Column, task: Column) -> Column:
    """Label meant by a free text, else NULL.

    Everything but ``a-z0-9_`` separates words and all labels are single words, so the
    label is decided by the first word of the lower-cased text.
    """
    word = F.regexp_extract(F.lower(text), "[a-z0-9_]+", 0)

    def match(labels):
        hit = None
        for label in labels:
            condition = word == label.lower()
            hit = F.when(condition, F.lit(label)) if hit is None else hit.when(condition, F.lit(label))
        return hit

    return _by_task(task, match)


def final_answers(prediction: Column) -> Column:
    """Texts behind the answer markers of a prediction, in order."""
    return F.regexp_extract_all(prediction, F.lit(FINAL_LABEL_REGEX), F.lit(1))


def pick_label(answers: Column, task: Column) -> Column:
    """The last answer that is a label of the task."""
    labels = F.filter(F.transform(answers, lambda a: normalize_label(a, task)), lambda label: label.isNotNull())
    return F.try_element_at(labels, F.lit(-1))


def parse_final_label(prediction: Column, task: Column) -> Column:
    """The last marked answer that is a label of the task; no fallback to free mentions."""
    return pick_label(final_answers(prediction), task)
