"""Readers and writers."""

from tuneframe.sources.json_rows import json_elements, read_json_rows
from tuneframe.sources.readers import (
    parse_metric_lines,
    read_fewshot_manifest,
    read_run_log,
    read_task_splits,
    read_tooluse,
    run_of_path,
    with_row_idx,
)
from tuneframe.sources.writers import (
    completion_table,
    example_table,
    example_table_tooluse,
    land_tooluse,
    metric_lines,
    save_token_table,
    write_completions,
    write_examples,
    write_examples_tooluse,
    write_json_arrays,
    write_run_log,
)

__all__ = [
    "completion_table",
    "example_table",
    "example_table_tooluse",
    "json_elements",
    "land_tooluse",
    "metric_lines",
    "parse_metric_lines",
    "read_fewshot_manifest",
    "read_json_rows",
    "read_run_log",
    "read_task_splits",
    "read_tooluse",
    "run_of_path",
    "save_token_table",
    "with_row_idx",
    "write_completions",
    "write_examples",
    "write_examples_tooluse",
    "write_json_arrays",
    "write_run_log",
]
