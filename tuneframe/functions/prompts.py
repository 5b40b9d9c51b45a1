"""Prompt, completion and teacher-prompt texts and message lists."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tuneframe import constants as C
from tuneframe.functions.text import as_text, fill, strip


def render_prompt(task: str) -> Column:
    """Task prompt from the raw columns of that task."""
    template = C.PROMPT_TEXT[task]
    fields = {field for _, field, _, _ in Formatter().parse(template) if field}
    return fill(template, **{field: as_text(F.col(field)) for field in fields})


def gold_completion(label: Column) -> Column:
    return fill(C.COMPLETION_TEXT, label=label)


def teacher_prompt_label(prompt: Column, label: Column) -> Column:
    return fill(C.TEACHER_TEXT_LABEL, prompt=prompt, label=label)


def teacher_prompt_tool(prompt: Column, tool_call: Column) -> Column:
    return fill(C.TEACHER_TEXT_TOOL, prompt=prompt, tool_call=tool_call)


def render_tool_call(golden_answer: Column, golden_response: Column) -> Column:
    """Gold steps as text; rows without steps fall back to their response lines."""
    steps = F.transform(
        golden_answer,
        lambda step: fill(
            C.TOOL_CALL_TEXT,
            action=strip(as_text(step["Action"])),
            action_input=strip(as_text(step["Action_Input"])),
        ),
    )
    response = F.transform(golden_response, as_text)
    return F.when(F.size(golden_answer) > 0, F.array_join(steps, "\n")).otherwise(
        F.coalesce(F.array_join(response, "\n"), F.lit(""))
    )


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def user_message(content: Column) -> Column:
    return F.array(message("user", content))


def normalize_messages(df, column: str = "prompt") -> Column:
    """Message list of a prompt column: text becomes one user message, lists stay."""
    if isinstance(df.schema[column].dataType, T.ArrayType):
        return F.col(column)
    return user_message(as_text(F.col(column)))


def merge_bootstrap(messages: Column, completion: Column) -> tuple[Column, Column]:
    """(prompt messages, completion messages) after moving a trailing assistant turn of the
    prompt to the front of the completion."""
    last = F.try_element_at(messages, F.lit(-1))
    opened = F.coalesce(last["role"] == "assistant", F.lit(False))
    prompt = F.when(opened, F.slice(messages, F.lit(1), F.size(messages) - 1)).otherwise(messages)
    bootstrap = F.when(opened, F.coalesce(last["content"], F.lit(""))).otherwise(F.lit(""))
    return prompt, F.array(message("assistant", F.concat(bootstrap, completion)))


def select_prompt_by_mode(
    mode: Column, prompt: Column, teacher_prompt: Column, generate_from_teacher: bool | Column
) -> Column:
    """Evaluation always generates from the student prompt."""
    flag = generate_from_teacher if isinstance(generate_from_teacher, Column) else F.lit(generate_from_teacher)
    return F.when((mode != "eval") & flag, teacher_prompt).otherwise(prompt)
