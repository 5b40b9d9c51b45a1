"""Inputs of the operators, derived by Spark from the given tables.

Every table covers all rows and whole texts of its source. ``SQL`` holds the same tables
as common table expressions for the oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuneframe.constants import COMPLETION_TEXT, PROMPT_TEXT, TASK_LABELS, TEACHER_TEXT_LABEL, TEACHER_TEXT_TOOL
from tuneframe.functions import labels as L
from tuneframe.functions.arrays import cut_after_eos
from tuneframe.plans.registry import Tables

EOS, PAD, VOCAB = 3, 0, 64
NL = "\n"


def lit_sql(text: str) -> str:
    """SQL string expression of a text with line feeds."""
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in text.split("\n"))


def fill_sql(template: str, **values: str) -> str:
    """SQL concatenation for a text with placeholders."""
    from string import Formatter

    parts = []
    for literal, field, _, _ in Formatter().parse(template):
        if literal:
            parts.append(lit_sql(literal))
        if field:
            parts.append(values[field])
    return " || ".join(parts)


def r6(column: Column | str, places: int = 6) -> Column:
    """Rounded to six places, never negative zero."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, places) + F.lit(0.0)


def r6_sql(expression: str, places: int = 6) -> str:
    return f"(round({expression}, {places}) + 0.0)"


# ------------------------------------------------------------------ label tasks


def cls_copa(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_partkey").alias("example_id"),
        F.col("p_partkey").alias("row_idx"),
        F.lit("copa").alias("task"),
        F.when(F.col("p_size") <= 40, "train").otherwise("validation").alias("split"),
        F.col("p_name").alias("premise"),
        F.col("p_brand").alias("choice1"),
        F.col("p_type").alias("choice2"),
        F.when(F.col("p_size") % 2 == 0, "cause").otherwise("effect").alias("question"),
        (F.col("p_partkey") % 2).cast("int").alias("label"),
    )


def cls_cb(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id").select(
        F.col("doc_id").alias("example_id"),
        F.col("doc_id").alias("row_idx"),
        F.lit("cb").alias("task"),
        F.when(F.col("lang") == "en", "train").otherwise("validation").alias("split"),
        F.col("text").alias("premise"),
        F.concat(F.lit("The language is "), "lang").alias("hypothesis"),
        (F.col("quality") + F.col("toxic")).cast("int").alias("label"),
        "lang",
    )


def cls_wsc(t: Tables) -> DataFrame:
    return t.customer.select(
        F.col("c_custkey").alias("example_id"),
        F.col("c_custkey").alias("row_idx"),
        F.lit("wsc").alias("task"),
        F.when(F.col("c_acctbal") > 0, "train").otherwise("validation").alias("split"),
        F.concat("c_name", F.lit(" is in "), "c_mktsegment").alias("text"),
        F.col("c_name").alias("span1_text"),
        F.col("c_mktsegment").alias("span2_text"),
        (F.col("c_custkey") % 2).cast("int").alias("label"),
    )


def label_sql(task: str) -> str:
    arms = " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(TASK_LABELS[task]))
    return f"(CASE label {arms} END)"


def prompt_sql(task: str) -> str:
    fields = {
        "copa": ["premise", "question", "choice1", "choice2"],
        "cb": ["premise", "hypothesis"],
        "wsc": ["text", "span1_text", "span2_text"],
    }[task]
    return "(" + fill_sql(PROMPT_TEXT[task], **{f: f"coalesce({f}, 'None')" for f in fields}) + ")"


def completion_sql(task: str) -> str:
    return "(" + fill_sql(COMPLETION_TEXT, label=label_sql(task)) + ")"


def teacher_sql(task: str) -> str:
    return "(" + fill_sql(TEACHER_TEXT_LABEL, prompt=prompt_sql(task), label=label_sql(task)) + ")"


CLS_BODY = {"copa": "premise", "cb": "premise", "wsc": "text"}


def cls_predictions(examples: DataFrame, task: str) -> DataFrame:
    """``example_id, task, reference, prediction``; six kinds of answers by example id."""
    gold = L.label_name(F.lit(task), F.col("label"))
    body = F.col(CLS_BODY[task])
    names = TASK_LABELS[task]
    kind = F.col("example_id") % 6
    prediction = (
        F.when(kind == 0, F.concat(F.lit("Reasoning: "), body, F.lit("\nFinal Label: "), gold))
        .when(kind == 1, F.concat(F.lit(f"Final Label: {names[1]}\nFINAL LABEL : **"), F.upper(gold), F.lit("**.")))
        .when(kind == 2, body)
        .when(kind == 3, F.concat(body, F.lit("\nFinal Label: " + " OR ".join(names))))
        .when(kind == 4, F.concat(F.lit("Final Label:\n"), gold, F.lit("\nFinal Label: unsure")))
        .otherwise(F.concat(body, F.lit("\nFinal Label: maybe")))
    )
    return examples.select("example_id", "task", gold.alias("reference"), prediction.alias("prediction"))


def cls_predictions_sql(task: str) -> str:
    """Same table; ``parsed`` is worked out by SQL string functions."""
    names, body, gold = TASK_LABELS[task], CLS_BODY[task], label_sql(task)
    options = " OR ".join(names)
    prediction = (
        f"CASE example_id % 6 WHEN 0 THEN 'Reasoning: ' || {body} || chr(10) || 'Final Label: ' || {gold} "
        f"WHEN 1 THEN 'Final Label: {names[1]}' || chr(10) || 'FINAL LABEL : **' || upper({gold}) || '**.' "
        f"WHEN 2 THEN {body} "
        f"WHEN 3 THEN {body} || chr(10) || 'Final Label: {options}' "
        f"WHEN 4 THEN 'Final Label:' || chr(10) || {gold} || chr(10) || 'Final Label: unsure' "
        f"ELSE {body} || chr(10) || 'Final Label: maybe' END"
    )
    known = ", ".join(f"'{name.lower()}'" for name in names)
    shown = " ".join(f"WHEN '{name.lower()}' THEN '{name}'" for name in names)
    return f"""
      SELECT example_id, task, reference, prediction, CASE list_filter(list_transform(
               regexp_extract_all(prediction, '(?i)final\\s*label\\s*:\\s*([^\\n\\r]+)', 1),
               lambda a: regexp_extract(lower(a), '[a-z0-9_]+')), lambda w: w IN ({known}))[-1] {shown} END AS parsed
      FROM (SELECT example_id, task, {gold} AS reference, {prediction} AS prediction FROM cls_{task})"""


def all_cls_predictions(t: Tables) -> DataFrame:
    from tuneframe.operators.scoring import mixed_tasks

    tables = {"copa": cls_copa(t), "cb": cls_cb(t), "wsc": cls_wsc(t)}
    return mixed_tasks({task: cls_predictions(table, task) for task, table in tables.items()})


# ------------------------------------------------------------------ tool use


def tool_rows(t: Tables) -> DataFrame:
    """Raw tool-use rows: two steps, one step, or none with response lines."""

    def step(action: Column, argument: Column) -> Column:
        return F.struct(action.alias("Action"), argument.alias("Action_Input"))

    first = step(F.concat(F.lit(" "), "event_type"), F.col("props"))
    second = step(F.lit("log  entry"), F.concat(F.lit('{"user": '), F.col("user_id").cast("string"), F.lit("}")))
    kind = F.col("user_id") % 3
    return t.events.select(
        F.col("event_id").alias("row_idx"),
        F.concat(F.lit("User "), F.col("user_id").cast("string"), F.lit(" reports: "), "event_type").alias("prompt"),
        F.concat(F.lit(" "), "event_type", F.lit("_"), F.col("user_id").cast("string"), F.lit(" ")).alias("name"),
        F.when(F.col("event_type") == "error", F.array().cast("array<struct<Action:string,Action_Input:string>>"))
        .when(kind == 0, F.array(first, second))
        .otherwise(F.array(first))
        .alias("golden_answer"),
        F.array(F.concat(F.lit("Action: "), "event_type"), "props").alias("golden_response"),
        F.when(F.col("value") < 20, "train").otherwise("validation").alias("split"),
    )


TOOL_CALL_SQL = (
    "CASE WHEN event_type = 'error' THEN 'Action: error' || chr(10) || props "
    "ELSE 'Action: ' || event_type || chr(10) || 'Action Input: ' || props || CASE WHEN user_id % 3 = 0 THEN "
    "chr(10) || 'Action: log  entry' || chr(10) || 'Action Input: {\"user\": ' || user_id || '}' ELSE '' END END"
)


def teacher_tool_sql() -> str:
    return "(" + fill_sql(TEACHER_TEXT_TOOL, prompt="prompt", tool_call="tool_call") + ")"


def tool_gold(t: Tables) -> DataFrame:
    call = F.struct(F.col("event_type").alias("Action"), F.col("props").alias("Action_Input"))
    return t.events.select(F.col("event_id").alias("example_id"), F.array(call).alias("golden_answer"))


def tool_predictions(t: Tables) -> DataFrame:
    """Eight kinds of answers by event id."""
    kind = F.col("event_id") % 8
    name, props = F.col("event_type"), F.col("props")
    call = F.concat(F.lit("Action: "), name, F.lit("\nAction Input: "))
    prediction = (
        F.when(kind == 0, F.concat(call, props))
        .when(kind == 1, F.concat(call, F.replace(props, F.lit(" "), F.lit(""))))
        .when(kind == 2, F.concat(F.lit("Thought: x\naction :  "), name, F.lit("\nACTION INPUT : "), props))
        .when(kind == 3, F.concat(call, F.lit("```json\n"), props, F.lit("\n```")))
        .when(kind == 4, F.concat(F.lit("Action: other\nAction Input: "), props))
        .when(kind == 5, F.concat(call, F.lit("{broken")))
        .when(kind == 6, F.concat(call, props, F.lit("\nAction: extra")))
        .otherwise("I will not call a tool.")
    )
    return t.events.select(
        F.col("event_id").alias("example_id"),
        F.concat(F.lit("run_"), (F.col("user_id") % 12).cast("string")).alias("run_id"),
        (F.col("event_id") % 50).alias("step"),
        prediction.alias("prediction"),
    )


# ------------------------------------------------------------------ token tables


def student_tokens(t: Tables) -> DataFrame:
    seq = F.floor(F.col("vec_id") / 8).cast("bigint")
    return t.embeddings.select(
        F.concat(F.lit("run_"), (seq % 4).cast("string")).alias("run_id"),
        F.floor(seq / 8).cast("bigint").alias("batch_id"),
        seq.alias("seq_id"),
        (F.col("vec_id") % 8).alias("pos"),
        ((F.col("vec_id") * 7) % VOCAB).alias("token_id"),
        F.when(F.col("vec_id") % 8 <= seq % 8, 1).otherwise(0).alias("mask"),
        F.col("embedding").alias("student_logits"),
        "label",
    )


def teacher_tokens(t: Tables) -> DataFrame:
    """The teacher's logits are the vector rotated by one place."""
    seq = F.floor(F.col("vec_id") / 8).cast("bigint")
    rotated = F.concat(F.slice("embedding", 2, VOCAB - 1), F.slice("embedding", 1, 1))
    return t.embeddings.select(
        F.concat(F.lit("run_"), (seq % 4).cast("string")).alias("run_id"),
        seq.alias("seq_id"),
        (F.col("vec_id") % 8).alias("pos"),
        rotated.alias("teacher_logits"),
    )


# ------------------------------------------------------------------ runs and completions


def run_metrics(t: Tables) -> DataFrame:
    return t.events.select(
        F.concat(F.lit("run_"), (F.col("user_id") % 12).cast("string")).alias("run_id"),
        F.when(F.col("event_type").isin("signup", "purchase"), "eval").otherwise("train").alias("mode"),
        F.lit("eval").alias("prefix"),
        (F.col("event_id") % 50).alias("step"),
        F.col("event_id").alias("batch_id"),
        F.col("event_type").alias("name"),
        "value",
    )


def run_names() -> Column:
    """Run name of an events row: 4 tasks x 2 methods x 2 scenarios x 2 sizes."""
    task = F.element_at(F.array(*[F.lit(x) for x in ["copa", "cb", "wsc", "tooluse"]]), (F.col("user_id") % 4 + 1).cast("int"))
    method = F.when(F.floor(F.col("user_id") / 4) % 2 == 0, "sft").otherwise("distil")
    scenario = F.when(F.floor(F.col("user_id") / 8) % 2 == 0, "full").otherwise("fewshot")
    size = F.when(F.floor(F.col("user_id") / 16) % 2 == 0, "1").otherwise("8")
    return F.concat(task, F.lit("_"), method, F.lit("_"), scenario, F.lit("_ng"), size)


RUN_NAME_SQL = (
    "((CASE user_id % 4 WHEN 0 THEN 'copa' WHEN 1 THEN 'cb' WHEN 2 THEN 'wsc' ELSE 'tooluse' END) || '_' || "
    "(CASE WHEN (user_id // 4) % 2 = 0 THEN 'sft' ELSE 'distil' END) || '_' || "
    "(CASE WHEN (user_id // 8) % 2 = 0 THEN 'full' ELSE 'fewshot' END) || '_ng' || "
    "(CASE WHEN (user_id // 16) % 2 = 0 THEN '1' ELSE '8' END))"
)


def completions(t: Tables) -> DataFrame:
    """A completion is a document's words by length, up to the end token; the prompt is its
    source and language. Words of length 3 end a sequence, empty words are padding."""

    def ids(text: Column) -> Column:
        return F.transform(F.split(text, " "), lambda word: F.length(word))

    return t.documents.select(
        F.col("doc_id").alias("example_id"),
        F.concat(F.lit("run_"), "lang").alias("run_id"),
        F.when(F.col("doc_id") % 5 == 0, "eval").otherwise("train").alias("mode"),
        F.floor(F.col("doc_id") / 40).cast("bigint").alias("step"),
        F.floor(F.col("doc_id") / 8).cast("bigint").alias("batch_id"),
        ids(F.concat("source", F.lit(" "), "lang")).alias("prompt_ids"),
        ids(F.col("text")).alias("raw_ids"),
    )


def cut_completions(t: Tables) -> DataFrame:
    return completions(t).withColumn("completion_ids", cut_after_eos(F.col("raw_ids"), EOS)).drop("raw_ids")


# ------------------------------------------------------------------ leakage


def leak_rows(t: Tables) -> DataFrame:
    """Audit rows: markers, equal teacher prompts and completion blocks are planted."""
    text = F.col("text")
    doc = F.col("doc_id")
    return t.documents.select(
        doc.alias("example_id"),
        F.when(doc % 11 == 0, F.concat(text, F.lit("\nThe Correct Label is: x"))).otherwise(text).alias("prompt"),
        F.when(doc % 13 == 0, text).otherwise(F.concat(F.lit("Final Label: "), F.col("source"))).alias("completion"),
        F.when(doc % 7 == 0, text).otherwise(F.concat(F.lit("T "), text)).alias("teacher_prompt"),
    )


def leak_cross_documents(t: Tables) -> DataFrame:
    """All documents; benchmark passages are planted as whole line blocks."""
    n_items = t.benchmark.agg(F.count(F.lit(1))).scalar()
    spot = F.floor(F.col("doc_id") / 10) % n_items
    docs = t.documents.select("doc_id", "text", F.when(F.col("doc_id") % 10 == 0, spot).alias("item_id"))
    items = t.benchmark.select("item_id", F.col("text").alias("passage"))
    planted = F.concat("text", F.lit("\n"), "passage", F.lit("\nend"))
    return docs.join(items, "item_id", "left").select(
        "doc_id", F.coalesce(planted, F.col("text")).alias("text")
    )


SQL = {
    "cls_copa": (
        "SELECT p_partkey AS example_id, p_partkey AS row_idx, 'copa' AS task, "
        "CASE WHEN p_size <= 40 THEN 'train' ELSE 'validation' END AS split, p_name AS premise, p_brand AS choice1, "
        "p_type AS choice2, CASE WHEN p_size % 2 = 0 THEN 'cause' ELSE 'effect' END AS question, "
        "CAST(p_partkey % 2 AS INT) AS label FROM part"
    ),
    "cls_cb": (
        "SELECT d.doc_id AS example_id, d.doc_id AS row_idx, 'cb' AS task, "
        "CASE WHEN d.lang = 'en' THEN 'train' ELSE 'validation' END AS split, d.text AS premise, "
        "'The language is ' || d.lang AS hypothesis, CAST(l.quality + l.toxic AS INT) AS label, d.lang "
        "FROM documents d JOIN labels l ON d.doc_id = l.doc_id"
    ),
    "cls_wsc": (
        "SELECT c_custkey AS example_id, c_custkey AS row_idx, 'wsc' AS task, "
        "CASE WHEN c_acctbal > 0 THEN 'train' ELSE 'validation' END AS split, "
        "c_name || ' is in ' || c_mktsegment AS text, c_name AS span1_text, c_mktsegment AS span2_text, "
        "CAST(c_custkey % 2 AS INT) AS label FROM customer"
    ),
    "pred_copa": cls_predictions_sql("copa"),
    "pred_cb": cls_predictions_sql("cb"),
    "pred_wsc": cls_predictions_sql("wsc"),
    "tool_rows": (
        "SELECT event_id AS row_idx, 'User ' || user_id || ' reports: ' || event_type AS prompt, "
        "event_type || '_' || user_id AS name, event_type, user_id, props, "
        f"{TOOL_CALL_SQL} AS tool_call, CASE WHEN event_type = 'error' THEN 0 WHEN user_id % 3 = 0 THEN 2 ELSE 1 END "
        "AS n_steps, CASE WHEN value < 20 THEN 'train' ELSE 'validation' END AS split FROM events"
    ),
    "tool_scores": (
        "SELECT event_id AS example_id, 'run_' || (user_id % 12) AS run_id, event_id % 50 AS step, "
        "CASE WHEN event_id % 8 IN (0,1,2,3,6) THEN 1.0 ELSE 0.0 END::DOUBLE AS strict_match, "
        "CASE WHEN event_id % 8 <= 4 THEN 1.0 ELSE 0.0 END::DOUBLE AS parse_success, "
        "CASE WHEN event_id % 8 IN (0,1,2,3,5,6) THEN 1.0 ELSE 0.0 END::DOUBLE AS action_name_match FROM events"
    ),
    "tokens": (
        "SELECT *, list_transform(sl, lambda x: x - s_norm) AS s, list_transform(tl, lambda x: x - t_norm) AS t FROM ("
        "SELECT *, ln(list_sum(list_transform(sl, lambda x: exp(x)))) AS s_norm, "
        "ln(list_sum(list_transform(tl, lambda x: exp(x)))) AS t_norm FROM ("
        "SELECT 'run_' || ((vec_id // 8) % 4) AS run_id, vec_id // 64 AS batch_id, vec_id // 8 AS seq_id, vec_id % 8 AS pos, "
        f"(vec_id * 7) % {VOCAB} AS token_id, CASE WHEN vec_id % 8 <= (vec_id // 8) % 8 THEN 1 ELSE 0 END AS mask, label, "
        "CAST(embedding AS DOUBLE[]) AS sl, "
        f"list_concat(CAST(embedding AS DOUBLE[])[2:{VOCAB}], CAST(embedding AS DOUBLE[])[1:1]) AS tl FROM embeddings))"
    ),
    "token_values": (
        "SELECT run_id, batch_id, seq_id, pos, token_id, mask, label, s[token_id + 1] AS student_logp, "
        "t[token_id + 1] AS teacher_logp, -list_sum(list_transform(s, lambda x: exp(x) * x)) AS entropy, "
        "list_sum(list_transform(list_zip(s, t), lambda z: exp(z[2]) * (z[2] - z[1]))) AS forward_kl, "
        "list_sum(list_transform(list_zip(s, t), lambda z: exp(z[1]) * (z[1] - z[2]))) AS reverse_kl FROM tokens"
    ),
    "run_metrics": (
        "SELECT 'run_' || (user_id % 12) AS run_id, CASE WHEN event_type IN ('signup','purchase') THEN 'eval' "
        "ELSE 'train' END AS mode, 'eval' AS prefix, event_id % 50 AS step, event_id AS batch_id, "
        "event_type AS name, value FROM events"
    ),
    "completions": (
        "SELECT *, CASE WHEN list_position(raw_ids, 3) > 0 THEN raw_ids[1:list_position(raw_ids, 3)] ELSE raw_ids END "
        "AS ids FROM (SELECT doc_id AS example_id, 'run_' || lang AS run_id, CASE WHEN doc_id % 5 = 0 THEN 'eval' "
        "ELSE 'train' END AS mode, doc_id // 40 AS step, doc_id // 8 AS batch_id, "
        "list_transform(string_split(source || ' ' || lang, ' '), lambda w: length(w)) AS prompt_ids, "
        "list_transform(string_split(text, ' '), lambda w: length(w)) AS raw_ids FROM documents)"
    ),
    "leak_rows": (
        "SELECT doc_id AS example_id, CASE WHEN doc_id % 11 = 0 THEN text || chr(10) || 'The Correct Label is: x' "
        "ELSE text END AS prompt, CASE WHEN doc_id % 13 = 0 THEN text ELSE 'Final Label: ' || source END AS completion, "
        "CASE WHEN doc_id % 7 = 0 THEN text ELSE 'T ' || text END AS teacher_prompt FROM documents"
    ),
    "leak_docs": (
        "SELECT d.doc_id, coalesce(d.text || chr(10) || b.text || chr(10) || 'end', d.text) AS text FROM documents d "
        "LEFT JOIN benchmark b ON d.doc_id % 10 = 0 AND b.item_id = (d.doc_id // 10) % (SELECT count(*) FROM benchmark)"
    ),
}


# Python white space as an SQL string, and a text's stripped non-empty lines.
SPACE_SQL = "(" + " || ".join(
    f"chr({code})"
    for code in [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
) + ")"


def lines_sql(text: str) -> str:
    breaks = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
    return (
        f"list_filter(list_transform(string_split_regex({text}, '{breaks}'), lambda x: trim(x, {SPACE_SQL})), "
        "lambda x: x <> '')"
    )


def block_sql(text: str) -> str:
    return f"(chr(10) || array_to_string({lines_sql(text)}, chr(10)) || chr(10))"


_NEEDS = {"pred_copa": ["cls_copa"], "pred_cb": ["cls_cb"], "pred_wsc": ["cls_wsc"], "token_values": ["tokens"]}


def with_tables(*names: str) -> str:
    """``WITH`` clause for the named derived tables and what they build on."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    return "WITH " + ", ".join(f"{name} AS ({SQL[name]})" for name in ordered) + " "
