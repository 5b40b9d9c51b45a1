import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_of
from tuneframe import sources
from tuneframe.functions import prompts as P
from tuneframe.operators import ordering, subset
from tuneframe.plans import datasets

COPA = "row_idx bigint, premise string, choice1 string, choice2 string, question string, idx int, label int"


@pytest.fixture
def copa(rows):
    train = rows(COPA, [(i, f"p{i}", f"a{i}", f"b{i}", "cause", i, i % 2) for i in range(6)])
    evaluation = rows(COPA, [(i, f"e{i}", f"a{i}", f"b{i}", "effect", i, i % 2) for i in range(2)])
    return train, evaluation


def order(train):
    return [r["row_idx"] for r in train.orderBy("shuffle_key", "row_idx").collect()]


def test_schemas(copa):
    train, evaluation = datasets.build_distil_cls(" COPA", *copa)
    assert datasets.prune_columns(train).columns == ["prompt", "teacher_prompt"]
    assert datasets.prune_columns(evaluation).columns == ["prompt", "teacher_prompt", "eval_label", "eval_task"]
    assert train.count() == 6 and evaluation.count() == 2
    first = evaluation.where("row_idx = 1").first()
    assert first["prompt"][0]["role"] == "user" and first["eval_label"] == "choice2" and first["eval_task"] == "copa"
    train, evaluation = datasets.build_sft_cls("copa", *copa)
    assert train.columns == ["row_idx", "shuffle_key", "prompt", "completion", "teacher_prompt"]
    assert evaluation.where("row_idx = 0").first()["completion"] == "Final Label: choice1"


def test_texts(copa):
    _, evaluation = datasets.build_sft_cls("copa", *copa)
    row = evaluation.where("row_idx = 0").first()
    assert row["prompt"] == (
        "Task: Choose the better alternative for the requested causal relation.\n"
        "Give your reasoning, then end with exactly one final line in this format:\n"
        "Final Label: choice1 OR Final Label: choice2\n\n"
        "Premise: e0\nQuestion type: effect\nchoice1: a0\nchoice2: b0"
    )
    assert row["teacher_prompt"].startswith(row["prompt"] + "\n\nReference for this example:\nThe correct label is: choice1\n\n")
    assert row["teacher_prompt"].endswith("Reasoning: <your reasoning>\nFinal Label: choice1")


def test_values_are_not_reinterpreted(rows):
    text = "costs $5 \\1 {label} %s"
    df = rows("prompt string", [(text,)]).select(P.teacher_prompt_label(F.col("prompt"), F.lit("True")).alias("t"))
    assert df.first()["t"].startswith(text + "\n")


def test_missing_field_reads_none(rows):
    df = rows("premise string, hypothesis string", [(None, "h")]).select(P.render_prompt("cb").alias("p"))
    assert "Premise: None\n" in df.first()["p"]


def test_shuffle_is_deterministic_and_seeded(copa):
    orders = [order(datasets.build_sft_cls("copa", *copa, seed=s)[0]) for s in (42, 42, 7)]
    assert orders[0] == orders[1] and sorted(orders[2]) == list(range(6)) and orders[0] != orders[2]


def test_subset_keeps_the_given_order(copa, rows):
    manifest = rows("row_idx bigint, pos bigint", [(5, 0), (0, 1), (3, 2)])
    picked = subset.fewshot_subset(copa[0], manifest).orderBy("pos")
    assert [r["premise"] for r in picked.collect()] == ["p5", "p0", "p3"]
    train, _ = datasets.build_sft_cls("copa", *copa, manifest=manifest)
    assert train.count() == 3


def test_unknown_task(copa):
    with pytest.raises(ValueError, match="unsupported task"):
        datasets.build_sft_cls("rte", *copa)


@pytest.mark.parametrize(
    "indices, message", [([], "non-empty"), ([1, 1, 2], "duplicates"), ([0, 7], "within"), ([-1], "within"), ([None, 1], "integers")]
)
def test_index_checks(copa, rows, indices, message):
    manifest = rows("task string, row_idx bigint", [("copa", i) for i in indices])
    report = subset.check_indices(manifest, copa[0].withColumn("task", F.lit("copa")), ["task"])
    with pytest.raises(ValueError, match=message):
        subset.require_indices(report)


def test_good_indices_and_count(copa, rows):
    manifest = rows("task string, row_idx bigint", [("copa", 0), ("copa", 5)])
    base = copa[0].withColumn("task", F.lit("copa"))
    subset.require_indices(subset.check_indices(manifest, base, ["task"], expected=2))
    with pytest.raises(ValueError, match="expected number"):
        subset.require_indices(subset.check_indices(manifest, base, ["task"], expected=5))


def test_fewshot_options():
    choose = subset.resolve_fewshot
    tasks = ("tooluse", "copa", "cb", "wsc")
    assert choose("tooluse", None, True, tasks) == "one_per_name"
    assert choose("copa", "f.json", False, tasks) == "manifest"
    assert choose("copa", None, False, tasks) is None
    for arguments in (("copa", None, True), ("tooluse", "f", True), ("rte", "f", False)):
        with pytest.raises(ValueError):
            choose(*arguments, tasks)


TOOL = "row_idx bigint, prompt string, name string, golden_answer array<struct<Action:string,Action_Input:string>>, golden_response array<string>"


@pytest.fixture
def tool(rows):
    return rows(
        TOOL,
        [
            (0, "p0", " zeta ", [(" a ", ' {"x": 1} '), ("b", None)], ["r"]),
            (1, "p1", "alpha", [], ["line 1", None]),
            (2, "p2", "zeta", None, None),
            (3, "p3", "  ", [("c", "1")], []),
            (4, "p4", None, [("c", "1")], []),
        ],
    )


def test_tool_call_text(tool):
    got = {r[0]: r[1] for r in tool.select("row_idx", P.render_tool_call(F.col("golden_answer"), F.col("golden_response"))).collect()}
    assert got[0] == 'Action: a\nAction Input: {"x": 1}\nAction: b\nAction Input: None'
    assert got[1] == "line 1\nNone" and got[2] == "" and got[3] == "Action: c\nAction Input: 1"


def test_tool_tables(tool):
    train, evaluation = datasets.build_distil_tool(tool, tool)
    assert datasets.prune_columns(evaluation).columns == ["prompt", "teacher_prompt", "golden_answer"]
    content = train.where("row_idx = 3").first()["teacher_prompt"][0]["content"]
    assert "The correct tool call is:\nAction: c\nAction Input: 1\n\nWrite your own response" in content
    train, _ = datasets.build_sft_tool(tool, tool)
    assert train.columns == ["row_idx", "shuffle_key", "prompt", "completion", "teacher_prompt"]


def test_one_per_name(tool):
    firsts = subset.one_per_name(tool).orderBy("name")
    assert [tuple(r) for r in firsts.collect()] == [("None", 4), ("alpha", 1), ("zeta", 0)]
    split = tool.withColumn("split", F.lit("train"))
    assert subset.count_prototypes(split, ["split"]).first()["n_prototypes"] == 3
    train, _ = datasets.build_sft_tool(tool, tool, manifest=subset.one_per_name(tool).withColumnRenamed("name", "pos"))
    assert train.count() == 3


def test_messages(rows):
    flat = rows("prompt string", [("hi",)])
    assert flat.select(P.normalize_messages(flat).alias("m")).first()["m"][0].asDict() == {"role": "user", "content": "hi"}
    lists = rows(
        "prompt array<struct<role:string,content:string>>",
        [([("user", "q"), ("assistant", "So ")],), ([("user", "q")],)],
    )
    prompt, completion = P.merge_bootstrap(P.normalize_messages(lists), F.lit("done"))
    got = [(len(r["p"]), r["c"][0]["content"]) for r in lists.select(prompt.alias("p"), completion.alias("c")).collect()]
    assert got == [(1, "So done"), (1, "done")]


@pytest.mark.parametrize("mode, flag, want", [("eval", True, "s"), ("train", True, "t"), ("train", False, "s")])
def test_prompt_by_mode(rows, mode, flag, want):
    df = rows("mode string", [(mode,)])
    assert df.select(P.select_prompt_by_mode(F.col("mode"), F.lit("s"), F.lit("t"), flag)).first()[0] == want


def test_builders_do_not_shuffle(copa):
    for table in (*datasets.build_distil_cls("copa", *copa), *datasets.build_sft_cls("copa", *copa)):
        assert "Exchange" not in plan_of(table)


def test_manifest_file(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"version": 1, "description": "d", "tasks": {
        "copa": {"train_indices": [293, 340, 1], "rationale": "r"},
        "odd": {"train_indices": [1, True, 2.0, "3", None], "rationale": "r"},
        "bad": {"train_indices": "1,2", "rationale": "r"}}}, indent=2))
    read = sources.read_fewshot_manifest
    got = read(spark, str(path), "copa").orderBy("pos").collect()
    assert [(r["pos"], r["row_idx"]) for r in got] == [(0, 293), (1, 340), (2, 1)]
    odd = read(spark, str(path), "odd").orderBy("pos").collect()
    assert [r["row_idx"] for r in odd] == [1, None, None, None, None]
    for task, message in (("wsc", "does not contain"), ("bad", "as a list")):
        with pytest.raises(ValueError, match=message):
            read(spark, str(path), task)


def test_tooluse_files(spark, tmp_path):
    record = {"prompt": "p", "name": "n", "golden_answer": [{"Action": "a", "Action_Input": "{}"}], "golden_response": ["r"]}
    (tmp_path / "array.json").write_text(json.dumps([record, record], indent=1))
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(record) for _ in range(3)))
    assert sources.read_tooluse(spark, str(tmp_path / "array.json"), multi_line=True).count() == 2
    rows = sources.read_tooluse(spark, str(tmp_path / "lines.json")).collect()
    assert len(rows) == 3 and rows[0]["golden_answer"][0]["Action"] == "a"


def test_row_idx_over_several_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000, numPartitions=4).write.parquet(path)
    got = sources.with_row_idx(spark.read.parquet(path)).orderBy("row_idx").collect()
    assert [r["row_idx"] for r in got] == list(range(1000)) and [r["id"] for r in got] == list(range(1000))


def test_positions(spark):
    shuffled = ordering.seeded_shuffle(spark.range(500).withColumnRenamed("id", "row_idx"), 1).collect()
    assert sorted(r["pos"] for r in shuffled) == list(range(500))
    import hashlib

    want = sorted(range(500), key=lambda i: (hashlib.md5(f"1:{i}".encode()).hexdigest(), i))
    assert [r["row_idx"] for r in sorted(shuffled, key=lambda r: r["pos"])] == want
