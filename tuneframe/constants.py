"""Fixed values.

Texts, label lists, patterns and column lists in this module are part of the data
contract: results only agree with other producers of the same tables when these values
are exactly the ones below.
"""

# Task -> label names, in label-id order.
TASK_LABELS = {
    "copa": ["choice1", "choice2"],
    "cb": ["entailment", "contradiction", "neutral"],
    "wsc": ["False", "True"],
}

# Task -> prompt text with the raw columns as placeholders.
PROMPT_TEXT = {
    "copa": (
        "Task: Choose the better alternative for the requested causal relation.\n"
        "Give your reasoning, then end with exactly one final line in this format:\n"
        "Final Label: choice1 OR Final Label: choice2\n\n"
        "Premise: {premise}\n"
        "Question type: {question}\n"
        "choice1: {choice1}\n"
        "choice2: {choice2}"
    ),
    "cb": (
        "Task: Natural language inference.\n"
        "Decide whether the hypothesis is entailed by the premise, contradicts it, or is neutral.\n"
        "Give your reasoning, then end with exactly one final line in this format:\n"
        "Final Label: entailment OR contradiction OR neutral\n\n"
        "Premise: {premise}\n"
        "Hypothesis: {hypothesis}"
    ),
    "wsc": (
        "Task: Coreference resolution.\n"
        "Decide whether span2 refers to span1.\n"
        "Give your reasoning, then end with exactly one final line in this format:\n"
        "Final Label: True OR Final Label: False\n\n"
        "Text: {text}\n"
        "span1: {span1_text}\n"
        "span2: {span2_text}"
    ),
}

COMPLETION_TEXT = "Final Label: {label}"

TEACHER_TEXT_LABEL = (
    "{prompt}\n\n"
    "Reference for this example:\n"
    "The correct label is: {label}\n\n"
    "Write your own response with a clear reasoning process.\n"
    "Use this exact output structure:\n"
    "Reasoning: <your reasoning>\n"
    "Final Label: {label}"
)

TEACHER_TEXT_TOOL = (
    "{prompt}\n\n"
    "Reference for this example:\n"
    "The correct tool call is:\n"
    "{tool_call}\n\n"
    "Write your own response with a clear reasoning process, then provide the final tool call "
    "in the same Action / Action Input format."
)

TOOL_CALL_TEXT = "Action: {action}\nAction Input: {action_input}"

# Lower-cased sentences that give the answer away when a prompt contains one of them.
LEAK_MARKERS = [
    "reference for this example:",
    "the correct label is:",
    "the correct tool call is:",
]

# Columns a training table keeps, in this order.
SIGNATURE_COLUMNS = [
    "prompt",
    "teacher_prompt",
    "golden_answer",
    "eval_label",
    "eval_task",
    "image",
    "images",
]

# White space as Python's str.strip() and the re class \s see it.
PY_SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a Java regex class; use it under (?U).
PY_SPACE_CLASS = r"[\s\x1c-\x1f]"
# Line boundaries of Python's str.splitlines().
LINE_BREAK_REGEX = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

# The same boundaries without the line feed.
OTHER_LINE_BREAKS = ["\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]

# Marker of the final answer; the answer is the rest of the line.
FINAL_LABEL_REGEX = rf"(?iU)final{PY_SPACE_CLASS}*label{PY_SPACE_CLASS}*:{PY_SPACE_CLASS}*([^\n\r]+)"
# A line that names a tool (no "Input" word) or carries its argument (python re, ignore case).
TOOL_LINE_REGEX = r"\s*Action(\s*Input)?\s*:(.*)$"
CODE_FENCE = "```"

# Log line of an evaluation: [tag] {json object}
METRIC_LINE_REGEX = r"^\[([^\]\s]+)\] (\{.*\})\s*$"
# <task>_<method>_<full|fewshot>_ng<generations>
RUN_NAME_REGEX = r"([A-Za-z0-9]+)_([A-Za-z0-9]+)_(full|fewshot)_ng(\d+)"

# Metric that picks the best checkpoint of a task.
BEST_METRIC = {
    "copa": "eval_small_data_accuracy",
    "cb": "eval_small_data_accuracy",
    "wsc": "eval_small_data_accuracy",
    "tooluse": "eval_tooluse_strict_match",
}

# Defaults of the token-level analytics.
SKIP_FIRST_TOKENS = 3
IMPORTANCE_CAP = 2.0
LEAK_REPORT_IDS = 10
