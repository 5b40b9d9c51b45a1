"""Queries for sources, sinks, projections and subsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tuneframe import schemas
from tuneframe.constants import TASK_LABELS
from tuneframe.functions import labels as L
from tuneframe.functions import prompts as P
from tuneframe.functions.text import non_empty_lines
from tuneframe.operators import batches, scoring, subset
from tuneframe.plans import datasets
from tuneframe.plans import derived as D
from tuneframe.plans.derived import with_tables
from tuneframe.plans.registry import Tables, query
from tuneframe.session import run_folder
from tuneframe.sources import readers, writers
from tuneframe.sources.json_rows import read_json_rows

# ------------------------------------------------------------------ sources


@query(
    "read_tooluse",
    with_tables("tool_rows")
    + "SELECT 'User ' || user_id || ' reports: ' || event_type AS prompt, name, n_steps, split, tool_call FROM tool_rows",
)
def read_tooluse(t: Tables):
    """Write both splits as JSON lines, read them back through the reader."""
    path = run_folder(t.spark, "tooluse-json")
    raw = D.tool_rows(t).drop("row_idx")
    raw.write.partitionBy("split").json(path)
    splits = [
        readers.read_tooluse(t.spark, f"{path}/split={split}").withColumn("split", F.lit(split))
        for split in ("train", "validation")
    ]
    return splits[0].unionByName(splits[1]).select(
        "prompt",
        F.trim("name").alias("name"),
        F.size("golden_answer").alias("n_steps"),
        "split",
        P.render_tool_call(F.col("golden_answer"), F.col("golden_response")).alias("tool_call"),
    )


# Texts full of what a lexer could trip over.
ODD_TEXT_SQL = "'\"User\" ' || user_id || ' \\ reports: [{' || event_type || '}, \\\" ]' || chr(10) || '},{'"


@query(
    "read_tooluse_array",
    with_tables("tool_rows")
    + f"SELECT {ODD_TEXT_SQL} AS prompt, name, n_steps, tool_call, row_number() OVER (ORDER BY tool_rows.row_idx) - 1 AS row_idx FROM tool_rows",
)
def read_tooluse_array(t: Tables):
    """All rows as JSON arrays, cut into rows by ranges of 64 KB; the position in the arrays is the order of the rows."""
    path = run_folder(t.spark, "tooluse-array")
    user = F.element_at(F.split("prompt", " "), 2)
    event = F.element_at(F.split("prompt", " "), 4)
    odd = F.concat(F.lit('"User" '), user, F.lit(" \\ reports: [{"), event, F.lit('}, \\" ]\n},{'))
    rows = D.tool_rows(t).withColumn("prompt", odd).repartitionByRange("row_idx").sortWithinPartitions("row_idx")
    writers.write_json_arrays(rows.drop("row_idx", "split"), path)
    read = read_json_rows(t.spark, path, schemas.TOOLUSE_RAW, row_idx="row_idx", range_bytes=1 << 16)
    return read.select(
        "prompt",
        F.trim("name").alias("name"),
        F.size("golden_answer").alias("n_steps"),
        P.render_tool_call(F.col("golden_answer"), F.col("golden_response")).alias("tool_call"),
        "row_idx",
    )


@query(
    "read_task_splits",
    with_tables("cls_copa", "cls_cb", "cls_wsc")
    + "SELECT example_id, split, label, premise AS body FROM cls_copa UNION ALL "
    "SELECT example_id, split, label, premise FROM cls_cb UNION ALL SELECT example_id, split, label, text FROM cls_wsc",
)
def read_task_splits(t: Tables):
    path = run_folder(t.spark, "task-splits")
    whole = scoring.mixed_tasks({"copa": D.cls_copa(t), "cb": D.cls_cb(t), "wsc": D.cls_wsc(t)})
    whole.write.partitionBy("task", "split").parquet(path)
    parts = [
        readers.read_task_splits(t.spark, path, task, split).select(
            "example_id", F.lit(split).alias("split"), "label", F.col(D.CLS_BODY[task]).alias("body")
        )
        for task in TASK_LABELS
        for split in ("train", "validation")
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


# Every labelled document is listed under its language and thousand of ids, in id order.
MANIFEST_SQL = (
    "manifest AS (SELECT d.lang || '_' || (l.doc_id // 1000) AS task, row_number() OVER (PARTITION BY d.lang, l.doc_id // 1000 "
    "ORDER BY l.doc_id) - 1 AS pos, l.doc_id AS row_idx FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"
)


def manifest(t: Tables):
    """The index lists a manifest holds; no list is longer than a thousand entries."""
    listed = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id")
    thousand = F.floor(F.col("doc_id") / 1000).cast("string")
    return listed.select(F.concat("lang", F.lit("_"), thousand).alias("task"), F.col("doc_id").alias("row_idx"))


@query("read_fewshot_manifest", f"WITH {MANIFEST_SQL} SELECT task, pos, row_idx FROM manifest")
def read_fewshot_manifest(t: Tables):
    """Write the lists as manifest objects, one JSON object per line, and read them back."""
    path = run_folder(t.spark, "manifest")
    (
        manifest(t)
        .groupBy("task")
        .agg(F.sort_array(F.collect_list("row_idx")).alias("train_indices"))
        .select(
            F.lit(1).alias("version"),
            F.lit("labelled documents").alias("description"),
            F.create_map("task", F.struct("train_indices", F.lit("labelled").alias("rationale"))).alias("tasks"),
        )
        .write.json(path)
    )
    return readers.read_fewshot_manifest(t.spark, path, multi_line=False).select("task", "pos", "row_idx")


# ------------------------------------------------------------------ sinks


@query("read_manifest_array", f"WITH {MANIFEST_SQL} SELECT task, pos, row_idx FROM manifest")
def read_manifest_array(t: Tables):
    """The lists as array files of manifest objects, read in ranges."""
    path = run_folder(t.spark, "manifest-array")
    lists = manifest(t).groupBy("task").agg(F.sort_array(F.collect_list("row_idx")).alias("train_indices"))
    entry = F.struct("train_indices", F.lit('labelled "twice" {so]').alias("rationale"))
    rows = lists.select(F.lit(1).alias("version"), F.lit("lists").alias("description"), F.create_map("task", entry).alias("tasks"))
    writers.write_json_arrays(rows, path)
    return readers.read_fewshot_manifest(t.spark, path, large=True).select("task", "pos", "row_idx")


@query(
    "write_examples",
    with_tables("pred_copa", "pred_wsc")
    + ", both_tasks AS (SELECT p.*, e.prompt, e.teacher FROM pred_copa p JOIN (SELECT example_id, "
    f"{D.prompt_sql('copa')} AS prompt, {D.teacher_sql('copa')} AS teacher FROM cls_copa) e USING (example_id)) "
    "SELECT CAST(example_id % 10 AS VARCHAR) AS step, prompt AS student_input, teacher AS teacher_input, "
    "prediction AS completion, parsed AS predicted_label, reference AS gold_label FROM both_tasks",
)
def write_examples(t: Tables):
    path = run_folder(t.spark, "examples")
    examples = D.cls_copa(t)
    _, shown = datasets.build_sft_cls("copa", examples, examples)
    rows = (
        D.cls_predictions(examples, "copa")
        .join(shown.withColumnRenamed("row_idx", "example_id"), "example_id")
        .withColumn("step", F.col("example_id") % 10)
    )
    writers.write_examples(rows, path)
    return t.spark.read.parquet(path).select(
        F.col("step").cast("string").alias("step"),
        "student_input",
        "teacher_input",
        "completion",
        "predicted_label",
        "gold_label",
    )


@query(
    "write_examples_tooluse",
    "SELECT CAST(event_id % 50 AS VARCHAR) AS step, 'User ' || user_id || ' reports: ' || event_type AS student_input, "
    "'T ' || event_type AS teacher_input, length(props) AS props_length, "
    "'[{\"Action\":\"' || event_type || '\",\"Action_Input\":\"' || replace(props, '\"', '\\\"') || '\"}]' AS gold_tool_calls "
    "FROM events",
)
def write_examples_tooluse(t: Tables):
    path = run_folder(t.spark, "examples-tooluse")
    shown = t.events.select(
        F.col("event_id").alias("example_id"),
        F.concat(F.lit("User "), F.col("user_id").cast("string"), F.lit(" reports: "), "event_type").alias("prompt"),
        F.concat(F.lit("T "), "event_type").alias("teacher_prompt"),
    )
    rows = D.tool_predictions(t).join(D.tool_gold(t), "example_id").join(shown, "example_id")
    writers.write_examples_tooluse(rows, path)
    return t.spark.read.parquet(path).select(
        F.col("step").cast("string").alias("step"),
        "student_input",
        "teacher_input",
        F.length(F.get_json_object(F.col("gold_tool_calls"), "$[0].Action_Input")).cast("bigint").alias("props_length"),
        "gold_tool_calls",
    )


@query(
    "write_completions",
    "SELECT CASE WHEN lang = 'en' THEN 'train' ELSE 'eval' END AS mode, CAST((doc_id // 40) % 50 AS VARCHAR) AS step, text AS prompt, "
    f"'answer ' || source AS completion, {D.r6_sql('n_chars / 1000.0')} AS main, CAST(0.0 AS DOUBLE) AS advantage FROM documents "
    "QUALIFY row_number() OVER (PARTITION BY lang = 'en', (doc_id // 40) % 50, text ORDER BY doc_id) = 1",
)
def write_completions(t: Tables):
    """The first row of each prompt per log event; a prompt that comes back at a later step stays there."""
    path = run_folder(t.spark, "completions")
    rows = t.documents.select(
        F.when(F.col("lang") == "en", "train").otherwise("eval").alias("mode"),
        (F.floor(F.col("doc_id") / 40) % 50).cast("bigint").alias("step"),
        F.col("doc_id").alias("ordinal"),
        F.col("text").alias("prompt"),
        F.concat(F.lit("answer "), "source").alias("completion"),
        D.r6(F.col("n_chars") / 1000.0).alias("main"),
        F.lit(0.0).alias("advantage"),
    )
    writers.write_completions(rows, path, rewards=["main"], eval_only=False, unique_prompts=True)
    return t.spark.read.parquet(path).select(
        "mode", F.col("step").cast("string").alias("step"), "prompt", "completion", "main", "advantage"
    )


# ------------------------------------------------------------------ projections


def _prompt_query(task: str, source):
    @query(
        f"render_prompt_{task}",
        with_tables(f"cls_{task}") + f"SELECT example_id, {D.prompt_sql(task)} AS prompt FROM cls_{task}",
    )
    def run(t: Tables):
        return source(t).select("example_id", P.render_prompt(task).alias("prompt"))


for _task, _source in {"copa": D.cls_copa, "cb": D.cls_cb, "wsc": D.cls_wsc}.items():
    _prompt_query(_task, _source)


@query(
    "label_name",
    with_tables("cls_copa", "cls_cb", "cls_wsc")
    + " UNION ALL ".join(f"SELECT example_id, task, {D.label_sql(k)} AS label_text FROM cls_{k}" for k in TASK_LABELS),
)
def label_name(t: Tables):
    whole = scoring.mixed_tasks({"copa": D.cls_copa(t), "cb": D.cls_cb(t), "wsc": D.cls_wsc(t)})
    return whole.select("example_id", "task", L.label_name(F.col("task"), F.col("label")).alias("label_text"))


@query(
    "gold_completion",
    with_tables("cls_cb") + f"SELECT example_id, {D.completion_sql('cb')} AS completion FROM cls_cb",
)
def gold_completion(t: Tables):
    return D.cls_cb(t).select("example_id", P.gold_completion(L.label_name(F.lit("cb"), F.col("label"))).alias("completion"))


@query(
    "teacher_prompt_cls",
    with_tables("cls_cb") + f"SELECT example_id, {D.teacher_sql('cb')} AS teacher_prompt FROM cls_cb",
)
def teacher_prompt_cls(t: Tables):
    label = L.label_name(F.lit("cb"), F.col("label"))
    return D.cls_cb(t).select("example_id", P.teacher_prompt_label(P.render_prompt("cb"), label).alias("teacher_prompt"))


@query("render_tool_call", with_tables("tool_rows") + "SELECT row_idx, tool_call FROM tool_rows")
def render_tool_call(t: Tables):
    call = P.render_tool_call(F.col("golden_answer"), F.col("golden_response"))
    return D.tool_rows(t).select("row_idx", call.alias("tool_call"))


@query(
    "teacher_prompt_tool",
    with_tables("tool_rows") + f"SELECT row_idx, {D.teacher_tool_sql()} AS teacher_prompt FROM tool_rows",
)
def teacher_prompt_tool(t: Tables):
    call = P.render_tool_call(F.col("golden_answer"), F.col("golden_response"))
    return D.tool_rows(t).select("row_idx", P.teacher_prompt_tool(F.col("prompt"), call).alias("teacher_prompt"))


def _splits(rows):
    return rows.where(F.col("split") == "train"), rows.where(F.col("split") == "validation")


def _flat_messages(df, *columns):
    """Message lists as role, text and length columns, comparable with SQL."""
    for column in columns:
        df = df.withColumns(
            {
                f"{column}_role": F.col(column)[0]["role"],
                f"{column}_text": F.col(column)[0]["content"],
                f"{column}_size": F.size(column),
            }
        ).drop(column)
    return df


SHUFFLE_SQL = "CASE WHEN split = 'train' THEN md5('42:' || row_idx) END"


@query(
    "build_distil_cls",
    with_tables("cls_cb")
    + f"SELECT row_idx, split, {SHUFFLE_SQL} AS shuffle_key, 'user' AS prompt_role, {D.prompt_sql('cb')} AS prompt_text, "
    f"1 AS prompt_size, 'user' AS teacher_prompt_role, {D.teacher_sql('cb')} AS teacher_prompt_text, 1 AS teacher_prompt_size, "
    f"CASE WHEN split <> 'train' THEN {D.label_sql('cb')} END AS eval_label, "
    "CASE WHEN split <> 'train' THEN 'cb' END AS eval_task FROM cls_cb",
)
def build_distil_cls(t: Tables):
    both = datasets.split_union(*datasets.build_distil_cls("cb", *_splits(D.cls_cb(t))))
    return _flat_messages(both, "prompt", "teacher_prompt")


@query(
    "build_sft_cls",
    with_tables("cls_wsc")
    + f"SELECT row_idx, split, {SHUFFLE_SQL} AS shuffle_key, {D.prompt_sql('wsc')} AS prompt, {D.completion_sql('wsc')} "
    f"AS completion, {D.teacher_sql('wsc')} AS teacher_prompt, CASE WHEN split <> 'train' THEN {D.label_sql('wsc')} END "
    "AS eval_label, CASE WHEN split <> 'train' THEN 'wsc' END AS eval_task FROM cls_wsc",
)
def build_sft_cls(t: Tables):
    return datasets.split_union(*datasets.build_sft_cls("wsc", *_splits(D.cls_wsc(t))))


@query(
    "build_distil_tool",
    with_tables("tool_rows")
    + f"SELECT row_idx, split, {SHUFFLE_SQL} AS shuffle_key, 'user' AS prompt_role, prompt AS prompt_text, 1 AS prompt_size, "
    f"'user' AS teacher_prompt_role, {D.teacher_tool_sql()} AS teacher_prompt_text, 1 AS teacher_prompt_size, "
    "CASE WHEN split <> 'train' THEN n_steps END AS n_steps FROM tool_rows",
)
def build_distil_tool(t: Tables):
    both = datasets.split_union(*datasets.build_distil_tool(*_splits(D.tool_rows(t))))
    flat = _flat_messages(both, "prompt", "teacher_prompt")
    steps = F.when(F.col("golden_answer").isNotNull(), F.size("golden_answer"))
    return flat.withColumn("n_steps", steps).drop("golden_answer")


@query(
    "build_sft_tool",
    with_tables("tool_rows")
    + f"SELECT row_idx, split, {SHUFFLE_SQL} AS shuffle_key, prompt, tool_call AS completion, "
    f"{D.teacher_tool_sql()} AS teacher_prompt, CASE WHEN split <> 'train' THEN n_steps END AS n_steps FROM tool_rows",
)
def build_sft_tool(t: Tables):
    both = datasets.split_union(*datasets.build_sft_tool(*_splits(D.tool_rows(t))))
    steps = F.when(F.col("golden_answer").isNotNull(), F.size("golden_answer"))
    return both.withColumn("n_steps", steps).drop("golden_answer")


@query(
    "split_union",
    with_tables("cls_copa")
    + "SELECT split, count(*) AS n, count(CASE WHEN split <> 'train' THEN 1 END) AS n_labels FROM cls_copa GROUP BY split",
)
def split_union(t: Tables):
    both = datasets.split_union(*datasets.build_sft_cls("copa", *_splits(D.cls_copa(t))))
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count("eval_label").alias("n_labels"))


@query(
    "prune_columns",
    with_tables("cls_copa")
    + f"SELECT {D.prompt_sql('copa')} AS prompt, {D.teacher_sql('copa')} AS teacher_prompt, {D.label_sql('copa')} AS eval_label, "
    "'copa' AS eval_task FROM cls_copa",
)
def prune_columns(t: Tables):
    examples = D.cls_copa(t)
    _, evaluation = datasets.build_sft_cls("copa", examples, examples)
    return datasets.prune_columns(evaluation)


@query(
    "normalize_messages",
    "SELECT conv_id, turn, 1 AS n_messages, 'user' AS role, text AS content FROM conversations",
)
def normalize_messages(t: Tables):
    rows = t.conversations.select("conv_id", "turn", F.col("text").alias("prompt"))
    messages = rows.select("conv_id", "turn", P.normalize_messages(rows).alias("messages"))
    return messages.select(
        "conv_id",
        "turn",
        F.size("messages").alias("n_messages"),
        F.col("messages")[0]["role"].alias("role"),
        F.col("messages")[0]["content"].alias("content"),
    )


@query(
    "merge_bootstrap",
    "WITH last_turn AS (SELECT conv_id, count(*) AS n, arg_max(role, turn) AS role, arg_max(text, turn) AS text "
    "FROM conversations GROUP BY conv_id) SELECT conv_id, n - CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS n_prompt_messages, "
    "'assistant' AS role, CASE WHEN role = 'assistant' THEN text ELSE '' END || ' answer ' || conv_id AS content FROM last_turn",
)
def merge_bootstrap(t: Tables):
    """Long form, one row per message: only the last turn decides, so no conversation is collected."""
    last = t.conversations.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max_by(F.struct("role", F.col("text").alias("content")), "turn").alias("last"),
    )
    answer = F.concat(F.lit(" answer "), F.col("conv_id").cast("string"))
    rest, completion = P.merge_bootstrap(F.array("last"), answer)
    return last.select(
        "conv_id",
        (F.col("n") - 1 + F.size(rest)).alias("n_prompt_messages"),
        completion[0]["role"].alias("role"),
        completion[0]["content"].alias("content"),
    )


@query(
    "select_prompt_by_mode",
    "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text WHEN lang = 'en' THEN 'T ' || text ELSE text END AS prompt FROM documents",
)
def select_prompt_by_mode(t: Tables):
    mode = F.when(F.col("doc_id") % 5 == 0, "eval").otherwise("train")
    chosen = P.select_prompt_by_mode(mode, F.col("text"), F.concat(F.lit("T "), "text"), F.col("lang") == "en")
    return t.documents.select("doc_id", chosen.alias("prompt"))


@query(
    "normalize_images",
    "WITH p AS (SELECT page_id, page_id // 2 AS batch_id, CASE page_id % 4 WHEN 0 THEN [] WHEN 1 THEN [] WHEN 2 THEN [url] "
    "ELSE [url, html] END AS images FROM pages) SELECT page_id, "
    "CASE WHEN max(len(images)) OVER (PARTITION BY batch_id) > 0 THEN len(images) END::INT AS num_images, "
    "CASE WHEN max(len(images)) OVER (PARTITION BY batch_id) > 0 THEN images[1] END AS first_image FROM p",
)
def normalize_images(t: Tables):
    """Page references as images; a batch in which no page has one has none."""
    kind = F.col("page_id") % 4
    pages = t.pages.select(
        "page_id",
        F.floor(F.col("page_id") / 2).cast("bigint").alias("batch_id"),
        F.when(kind <= 1, F.array().cast("array<string>"))
        .when(kind == 2, F.array("url"))
        .otherwise(F.array("url", "html"))
        .alias("images"),
    )
    out = batches.normalize_images(pages, "batch_id")
    return out.select("page_id", "num_images", F.try_element_at("images", F.lit(1)).alias("first_image"))


# ------------------------------------------------------------------ subsets


@query(
    "fewshot_subset",
    "SELECT l.doc_id AS row_idx, l.doc_id * 2 AS pos, d.text FROM labels l JOIN documents d ON d.doc_id = l.doc_id",
)
def fewshot_subset(t: Tables):
    listed = t.labels.select(F.col("doc_id").alias("row_idx"), (F.col("doc_id") * 2).alias("pos"))
    rows = t.documents.select(F.col("doc_id").alias("row_idx"), "text")
    return subset.fewshot_subset(rows, listed)


@query(
    "join_manifest",
    f"WITH {MANIFEST_SQL} SELECT task, row_idx, row_idx AS pos, n_chars FROM manifest JOIN documents ON doc_id = row_idx",
)
def join_manifest(t: Tables):
    thousand = F.floor(F.col("doc_id") / 1000).cast("string")
    rows = t.documents.select(
        F.concat("lang", F.lit("_"), thousand).alias("task"), F.col("doc_id").alias("row_idx"), "n_chars"
    )
    return subset.join_manifest(rows, manifest(t).withColumn("pos", F.col("row_idx")))


# Lists with faults on purpose: order keys of line items per line number repeat and pass the
# number of rows of some groups; discounts of 0 stand for entries that are not integers.
FAULTY_SQL = (
    "idx AS (SELECT l_linestatus AS grp, CASE WHEN l_discount > 0 THEN l_orderkey END AS row_idx FROM lineitem), "
    "lists AS (SELECT grp, count(*) AS n_index, count(*) - count(row_idx) AS n_other, "
    "count(row_idx) - count(DISTINCT row_idx) AS n_repeat, min(row_idx) AS low, max(row_idx) AS high FROM idx GROUP BY grp), "
    "sizes AS (SELECT o_orderstatus AS grp, count(*) AS n_rows FROM orders GROUP BY 1), "
    "j AS (SELECT s.grp, n_rows, coalesce(n_index, 0) AS n_index, coalesce(n_other, 0) AS n_other, "
    "coalesce(n_repeat, 0) AS n_repeat, low, high FROM sizes s LEFT JOIN lists l ON s.grp = l.grp)"
)


@query(
    "validate_indices",
    f"WITH {FAULTY_SQL} "
    "SELECT grp, 'non_empty' AS \"check\", n_index > 0 AS ok, n_index AS detail FROM j UNION ALL "
    "SELECT grp, 'integers', n_other = 0, n_other FROM j UNION ALL "
    "SELECT grp, 'no_duplicates', n_repeat = 0, n_repeat FROM j UNION ALL "
    "SELECT grp, 'in_range', coalesce(NOT (low < 0 OR high >= n_rows), true), n_rows - 1 FROM j",
)
def validate_indices(t: Tables):
    lists = t.lineitem.select(
        F.col("l_linestatus").alias("grp"), F.when(F.col("l_discount") > 0, F.col("l_orderkey")).alias("row_idx")
    )
    rows = t.orders.select(F.col("o_orderstatus").alias("grp"))
    return subset.check_indices(lists, rows, ["grp"])


@query(
    "check_fewshot_count",
    f"WITH {MANIFEST_SQL} SELECT task, count(*) = 46 AS ok, count(*) AS detail FROM manifest GROUP BY 1",
)
def check_fewshot_count(t: Tables):
    thousand = F.floor(F.col("doc_id") / 1000).cast("string")
    rows = t.documents.select(F.concat("lang", F.lit("_"), thousand).alias("task"))
    report = subset.check_indices(manifest(t), rows, ["task"], expected=46)
    return report.where(F.col("check") == "expected_count").select("task", "ok", "detail")


@query(
    "one_per_name",
    "SELECT trim(event_type) || '_' || user_id AS name, min(event_id) AS row_idx FROM events GROUP BY 1",
)
def one_per_name(t: Tables):
    return subset.one_per_name(D.tool_rows(t))


@query(
    "count_prototypes",
    with_tables("tool_rows") + "SELECT split, count(DISTINCT name) AS n_prototypes FROM tool_rows GROUP BY split",
)
def count_prototypes(t: Tables):
    return subset.count_prototypes(D.tool_rows(t), ["split"])


@query(
    "non_empty_lines",
    f"SELECT doc_id, len(l)::INT AS n_lines, array_to_string(l, '|') AS joined FROM (SELECT doc_id, {D.lines_sql('text')} AS l FROM documents)",
)
def non_empty_lines_query(t: Tables):
    lines = t.documents.select("doc_id", non_empty_lines(F.col("text")).alias("lines"))
    return lines.select("doc_id", F.size("lines").alias("n_lines"), F.array_join("lines", "|").alias("joined"))


@query(
    "row_idx_partitioned",
    "SELECT lang, count(*) AS n, count(*) AS n_distinct FROM documents GROUP BY lang UNION ALL "
    "SELECT 'all', count(*), count(*) FROM documents",
)
def row_idx_partitioned(t: Tables):
    """Stored order over a table partitioned by language: a task writes to all folders, so each holds several files, and files
    of different folders share their names. Dense, no number twice."""
    path = run_folder(t.spark, "by-language")
    t.documents.select("doc_id", "lang", "text").repartition(5, "doc_id").write.partitionBy("lang").parquet(path)
    numbered = readers.with_row_idx(t.spark.read.parquet(path))
    dense = numbered.where(F.col("row_idx").between(0, t.documents.agg(F.count(F.lit(1)) - 1).scalar()))
    group = F.explode(F.array(F.col("lang"), F.lit("all"))).alias("lang")
    return dense.select("row_idx", group).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("row_idx").alias("n_distinct"))
