"""Queries for scoring and the leakage audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from tuneframe.constants import TASK_LABELS
from tuneframe.functions import labels as L
from tuneframe.functions import toolcalls
from tuneframe.functions.text import contains_line_block
from tuneframe.operators import leakage, scoring
from tuneframe.plans import datasets, evaluation
from tuneframe.plans import derived as D
from tuneframe.plans.derived import r6, r6_sql, with_tables
from tuneframe.plans.registry import Tables, query

ALL_PRED = "all_pred AS (" + " UNION ALL ".join(f"SELECT * FROM pred_{task}" for task in TASK_LABELS) + ")"
ALL_SCORED = (
    with_tables("pred_copa", "pred_cb", "pred_wsc")
    + f", {ALL_PRED}, scored AS (SELECT *, CASE WHEN parsed = reference THEN 1.0 ELSE 0.0 END::DOUBLE AS accuracy, "
    "CASE WHEN parsed IS NOT NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS parse_success FROM all_pred) "
)


def _paired_cls(t: Tables):
    """Predictions and references as two tables, paired by key."""
    whole = D.all_cls_predictions(t)
    predictions = whole.select("task", "example_id", "prediction")
    references = whole.select("task", "example_id", "reference")
    return scoring.pair_predictions(scoring.with_answers(predictions), references, ["task", "example_id"])


@query(
    "align_predictions",
    "SELECT coalesce(l.l_orderkey, o.example_id) AS example_id, l.l_linenumber AS prediction, o.reference, "
    "CASE WHEN o.example_id IS NULL THEN 'missing_reference' WHEN l.l_orderkey IS NULL THEN 'missing_prediction' ELSE 'ok' END "
    "AS status FROM lineitem l FULL OUTER JOIN (SELECT o_orderkey + 50 AS example_id, o_orderstatus AS reference FROM orders) o "
    "ON l.l_orderkey = o.example_id",
)
def align_predictions(t: Tables):
    """Line items against orders whose keys are shifted, so both sides have unmatched rows."""
    predictions = t.lineitem.select(F.col("l_orderkey").alias("example_id"), F.col("l_linenumber").alias("prediction"))
    references = t.orders.select(
        (F.col("o_orderkey") + 50).alias("example_id"), F.col("o_orderstatus").alias("reference")
    )
    return scoring.align_predictions(predictions, references)


@query("mixed_tasks", ALL_SCORED + "SELECT task, example_id, reference, parsed AS predicted_label FROM scored")
def mixed_tasks(t: Tables):
    return scoring.score_cls(D.all_cls_predictions(t)).select("task", "example_id", "reference", "predicted_label")


@query(
    "parse_final_label",
    with_tables("pred_cb") + "SELECT example_id, prediction, parsed AS predicted_label FROM pred_cb",
)
def parse_final_label(t: Tables):
    rows = D.cls_predictions(D.cls_cb(t), "cb")
    return rows.select(
        "example_id", "prediction", L.parse_final_label(F.col("prediction"), F.col("task")).alias("predicted_label")
    )


@query("score_cls", ALL_SCORED + "SELECT task, example_id, accuracy, parse_success FROM scored")
def score_cls(t: Tables):
    return scoring.score_cls(_paired_cls(t)).select("task", "example_id", "accuracy", "parse_success")


@query(
    "eval_cls",
    ALL_SCORED
    + f"SELECT coalesce(task, 'all') AS task, {r6_sql('avg(accuracy)')} AS eval_small_data_accuracy, "
    f"{r6_sql('avg(parse_success)')} AS eval_small_data_parse_success, count(*) AS n FROM scored GROUP BY ROLLUP (task)",
)
def eval_cls(t: Tables):
    means = scoring.eval_cls(scoring.score_cls(_paired_cls(t)))
    return means.select(
        "task",
        r6("eval_small_data_accuracy").alias("eval_small_data_accuracy"),
        r6("eval_small_data_parse_success").alias("eval_small_data_parse_success"),
        "n",
    )


@query(
    "parse_tool_calls",
    "SELECT event_id AS example_id, CASE WHEN event_id % 8 = 7 THEN 0 ELSE 1 END AS n_calls, event_id % 8 <= 4 AS ok, "
    "CASE event_id % 8 WHEN 4 THEN 'other' WHEN 7 THEN NULL ELSE event_type END AS first_action FROM events",
)
def parse_tool_calls(t: Tables):
    parsed = toolcalls.with_parsed_calls(D.tool_predictions(t), name="p")
    return parsed.select(
        "example_id",
        F.size("p.calls").alias("n_calls"),
        F.col("p.ok").alias("ok"),
        F.try_element_at("p.calls", F.lit(1))["action"].alias("first_action"),
    )


@query(
    "argument_routes",
    "SELECT run_id, count(*) AS n, count(*) FILTER (event_id % 8 IN (3, 5)) AS n_python FROM (SELECT *, 'run_' || (user_id % 12) AS run_id FROM events) GROUP BY run_id",
)
def argument_routes(t: Tables):
    """Fenced and broken arguments go to Python, the other six kinds of answers do not."""
    return scoring.argument_routes(D.tool_predictions(t), ["run_id"])


@query(
    "parse_tool_calls_both",
    "SELECT event_id AS example_id, CASE WHEN event_id % 8 = 7 THEN 0 ELSE 1 END AS n_calls, true AS same FROM events",
)
def parse_tool_calls_both(t: Tables):
    """Both engines on every prediction and every gold argument."""
    rows = D.tool_predictions(t).join(D.tool_gold(t), "example_id")
    rows = rows.withColumn("arrow", toolcalls.parse_tool_calls(F.col("prediction"))).withColumn("arrow_gold", toolcalls.expected_inputs(F.col("golden_answer")))
    rows = toolcalls.with_expected_inputs(toolcalls.with_parsed_calls(rows, name="p", engine="variant"), engine="variant")
    same = F.col("p").eqNullSafe(F.col("arrow")) & F.col("gold_inputs").eqNullSafe(F.col("arrow_gold"))
    return rows.select("example_id", F.size("p.calls").alias("n_calls"), same.alias("same"))


def _scored_tool(t: Tables):
    references = scoring.parse_gold(D.tool_gold(t)).drop("golden_answer")
    return scoring.score_tool(scoring.pair_predictions(scoring.with_calls(D.tool_predictions(t)), references))


@query(
    "score_tool",
    with_tables("tool_scores") + "SELECT example_id, strict_match, parse_success, action_name_match FROM tool_scores",
)
def score_tool(t: Tables):
    return _scored_tool(t).select("example_id", *scoring.TOOL_METRICS)


@query(
    "eval_tool",
    with_tables("tool_scores")
    + "SELECT run_id, step, "
    + ", ".join(f"{r6_sql(f'avg({m})')} AS eval_tooluse_{m}" for m in scoring.TOOL_METRICS)
    + ", count(*) AS n FROM tool_scores GROUP BY run_id, step",
)
def eval_tool(t: Tables):
    means = scoring.eval_tool(_scored_tool(t), ["run_id", "step"])
    names = [f"eval_tooluse_{m}" for m in scoring.TOOL_METRICS]
    return means.select("run_id", "step", *[r6(name).alias(name) for name in names], "n")


@query(
    "evaluate_cls",
    with_tables("pred_wsc")
    + ", s AS (SELECT r AS run_id, CASE WHEN parsed = reference AND (example_id + r) % 5 <> 0 THEN 1.0 ELSE 0.0 END AS a, "
    "CASE WHEN parsed IS NOT NULL AND (example_id + r) % 5 <> 0 THEN 1.0 ELSE 0.0 END AS p FROM pred_wsc, range(3) x(r)), "
    f"m AS (SELECT run_id, {r6_sql('avg(a)')} AS eval_init_small_data_accuracy, {r6_sql('avg(p)')} "
    "AS eval_init_small_data_parse_success, count(*) AS n FROM s GROUP BY 1) "
    "SELECT *, 'wsc' AS task FROM m UNION ALL SELECT *, 'all' FROM m",
)
def evaluate_cls(t: Tables):
    """Builder, leakage audit, scoring and means in one go."""
    examples = D.cls_wsc(t)
    _, table = datasets.build_sft_cls("wsc", examples, examples)
    every_run = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("run_id")
    predictions = D.cls_predictions(examples, "wsc").select("example_id", "prediction", every_run)
    silent = (F.col("example_id") + F.col("run_id")) % 5 == 0
    predictions = predictions.withColumn("prediction", F.when(silent, "no answer").otherwise(F.col("prediction")))
    table = table.withColumnRenamed("row_idx", "example_id")
    means = evaluation.evaluate(table, predictions, ["run_id"], prefix="eval_init")
    names = [f"eval_init_small_data_{m}" for m in scoring.CLS_METRICS]
    return means.select("run_id", "task", *[r6(name).alias(name) for name in names], "n")


@query(
    "evaluate_tool",
    with_tables("tool_scores")
    + "SELECT step, "
    + ", ".join(f"{r6_sql(f'avg({m})')} AS eval_final_tooluse_{m}" for m in scoring.TOOL_METRICS)
    + ", count(*) AS n FROM tool_scores GROUP BY step",
)
def evaluate_tool(t: Tables):
    table = D.tool_gold(t).withColumn("prompt", F.concat(F.lit("Question "), F.col("example_id").cast("string")))
    means = evaluation.evaluate(table, D.tool_predictions(t), ["step"], prefix="eval_final", complete=False)
    names = [f"eval_final_tooluse_{m}" for m in scoring.TOOL_METRICS]
    return means.select("step", *[r6(name).alias(name) for name in names], "n")


@query(
    "evaluation_gaps",
    "WITH p AS (SELECT user_id % 12 AS run_id, event_id % 40 AS example_id, count(*) AS n FROM events GROUP BY 1, 2) "
    "SELECT run_id, 37 - count(*) FILTER (example_id < 37) AS n_missing, CAST(sum(n - 1) AS BIGINT) AS n_repeated, "
    "count(*) FILTER (example_id >= 37) AS n_unknown FROM p GROUP BY 1",
)
def evaluation_gaps(t: Tables):
    """Events as predictions of forty examples; references of the last three are missing."""
    predictions = t.events.select((F.col("user_id") % 12).alias("run_id"), (F.col("event_id") % 40).alias("example_id"))
    references = t.events.select((F.col("event_id") % 37).alias("example_id"))
    return scoring.evaluation_gaps(predictions, references, ["run_id"])


# ------------------------------------------------------------------ leakage

MARKER_SQL = (
    "(contains(lower(prompt), 'reference for this example:') OR contains(lower(prompt), 'the correct label is:') "
    "OR contains(lower(prompt), 'the correct tool call is:'))"
)
BLOCK_SQL = (
    f"(len({D.lines_sql('completion')}) > 0 AND contains({D.block_sql('prompt')}, {D.block_sql('completion')}))"
)
TEACHER_SQL = f"(trim(teacher_prompt, {D.SPACE_SQL}) <> '' AND trim(teacher_prompt, {D.SPACE_SQL}) = prompt)"


@query("leak_marker", with_tables("leak_rows") + f"SELECT example_id, {MARKER_SQL} AS marker FROM leak_rows")
def leak_marker(t: Tables):
    return D.leak_rows(t).select("example_id", leakage.marker_leak(F.col("prompt")).alias("marker"))


@query(
    "leak_completion_block",
    with_tables("leak_rows") + f"SELECT example_id, {BLOCK_SQL} AS completion_block FROM leak_rows",
)
def leak_completion_block(t: Tables):
    flag = leakage.completion_block_leak(F.col("prompt"), F.col("completion"))
    return D.leak_rows(t).select("example_id", flag.alias("completion_block"))


@query(
    "contains_line_block",
    f"SELECT doc_id, contains({D.block_sql('text')}, {D.block_sql('source || chr(10) || lang')}) AS inside FROM documents",
)
def contains_line_block_query(t: Tables):
    needle = F.concat("source", F.lit("\n"), "lang")
    return t.documents.select("doc_id", contains_line_block(F.col("text"), needle).alias("inside"))


@query(
    "leak_teacher_equal",
    with_tables("leak_rows") + f"SELECT example_id, {TEACHER_SQL} AS teacher_equal FROM leak_rows",
)
def leak_teacher_equal(t: Tables):
    flag = leakage.teacher_equal_leak(F.col("prompt"), F.col("teacher_prompt"))
    return D.leak_rows(t).select("example_id", flag.alias("teacher_equal"))


HITS_SQL = (
    with_tables("leak_rows")
    + f", hits AS (SELECT 'marker' AS detector, example_id FROM leak_rows WHERE {MARKER_SQL} UNION ALL "
    f"SELECT 'completion_block', example_id FROM leak_rows WHERE {BLOCK_SQL} UNION ALL "
    f"SELECT 'teacher_equal', example_id FROM leak_rows WHERE {TEACHER_SQL}) "
)


@query(
    "leak_report",
    HITS_SQL
    + "SELECT detector, count(*) AS n, array_to_string(list(example_id ORDER BY example_id)[1:10], ',') AS first_ids "
    "FROM hits GROUP BY detector",
)
def leak_report(t: Tables):
    report = leakage.leak_report(D.leak_rows(t), "example_id")
    return report.select("detector", "n", F.array_join(F.col("first_ids").cast("array<string>"), ",").alias("first_ids"))


@query(
    "leak_top10",
    HITS_SQL
    + "SELECT detector, (rn - 1)::INT AS rank, example_id FROM (SELECT detector, example_id, row_number() OVER "
    "(PARTITION BY detector ORDER BY example_id) AS rn FROM hits) WHERE rn <= 10",
)
def leak_top10(t: Tables):
    return leakage.leak_top10(D.leak_rows(t), "example_id")


CROSS_SQL = (
    with_tables("leak_docs")
    + f", passages AS (SELECT item_id, {D.lines_sql('text')} AS lines, {D.block_sql('text')} AS block FROM benchmark), "
    f"docs AS (SELECT doc_id, {D.block_sql('text')} AS body FROM leak_docs), "
    "pairs AS (SELECT item_id, len(lines)::INT AS n_lines, block, doc_id FROM passages JOIN docs ON contains(body, block) "
    "WHERE len(lines) > 0) "
)


@query(
    "leak_cross",
    CROSS_SQL
    + "SELECT item_id, n_lines, count(*) AS n_docs, array_to_string(list(doc_id ORDER BY doc_id)[1:10], ',') AS first_docs "
    "FROM pairs GROUP BY item_id, n_lines",
)
def leak_cross(t: Tables):
    report = leakage.leak_cross(D.leak_cross_documents(t), t.benchmark)
    return report.withColumn("first_docs", F.array_join(F.col("first_docs").cast("array<string>"), ","))


@query("leak_cross_documents", CROSS_SQL + "SELECT doc_id, count(DISTINCT block) AS n_blocks FROM pairs GROUP BY doc_id")
def leak_cross_documents(t: Tables):
    return leakage.leak_cross_documents(D.leak_cross_documents(t), t.benchmark)
