import pandas as pd
import pytest
from pyspark.sql import functions as F

from tuneframe import sources
from tuneframe.operators import rewards, runs
from tuneframe.streaming import jobs


def test_rollup(rows):
    df = rows(
        "run_id string, mode string, prefix string, step int, name string, value double",
        [("r", "train", "eval", 1, "foo", 1.0), ("r", "train", "eval", 1, "foo", 3.0),
         ("r", "eval", "eval", 1, "bar", 2.0), ("r", "eval", "eval", 1, "bar", 4.0), ("r", "eval", "eval_init", 0, "bar", 5.0)],
    )
    got = {r["name"]: r["value"] for r in runs.metric_rollup(df).collect()}
    assert got == {"foo": 2.0, "eval_bar": 3.0, "eval_init_bar": 5.0}


def test_mode_from_names(rows):
    df = rows("run_id string, step int, name string", [("r", 1, "loss"), ("r", 1, "eval_loss"), ("r", 2, "loss"), ("r", 3, "my_eval_x")])
    got = {(r["step"], r["name"]): r["mode"] for r in runs.with_mode(df).collect()}
    assert got == {(1, "loss"): "eval", (1, "eval_loss"): "eval", (2, "loss"): "train", (3, "my_eval_x"): "train"}


def test_best_and_comparison(rows):
    df = rows("run_id string, step int, value double", [("a", 10, 0.5), ("a", 20, 0.7), ("a", 30, 0.7), ("a", 40, None)])
    assert tuple(runs.best_checkpoint(df).first()) == ("a", 20, 0.7)
    metrics = rows("run_id string, name string, value double", [("a", "eval_init_acc", 0.25), ("a", "eval_final_acc", 0.75), ("a", "loss", 1.0)])
    assert tuple(runs.init_vs_final(metrics).first()) == ("a", "acc", 0.25, 0.75, 0.5)
    results = rows("run_name string, value double", [("copa_sft_full_ng1", 0.5), ("copa_distil_full_ng1", 0.75), ("junk", 9.0), ("wsc_sft_fewshot_ng8", 0.1)])
    got = sorted(tuple(r) for r in runs.method_comparison(results, ["sft", "distil"]).collect())
    assert got == [("copa", "full", 1, 0.5, 0.75), ("wsc", "fewshot", 8, 0.1, None)]
    assert rows("task string", [("tooluse",)]).select(runs.best_metric_name(F.col("task"))).first()[0] == "eval_tooluse_strict_match"


def test_rewards(rows):
    @F.pandas_udf("double")
    def blank_is_missing(prompt: pd.Series, completion: pd.Series) -> pd.Series:
        return completion.map(lambda c: float(len(c)) if c else float("nan"))

    df = rows("prompt string, completion string", [("p", "abc"), ("p", "")])
    scored = rewards.apply_rewards(df, {"n": blank_is_missing, "hit": lambda p, c: F.when(c == "abc", 1.0)})
    got = [tuple(r) for r in rewards.mark_unrewarded(scored, ["n", "hit"]).select("n", "hit", "all_missing").collect()]
    assert got == [(3.0, 1.0, False), (None, None, True)]
    long = rows("example_id int, func string, value double", [(1, "a", 1.0), (1, "b", None), (2, "a", None)])
    got = sorted(tuple(r) for r in rewards.reward_matrix(long, ["a", "b"]).collect())
    assert got == [(1, 1.0, None, False), (2, None, None, True)]


LOG = """start
[eval_init] {"eval_init_small_data_accuracy": 0.5, "eval_init_runtime": 3, "note": "x"}
{'loss': 1.0}
[eval_final] {"eval_final_small_data_accuracy": 1.0}
[broken] {not json}
 [eval_init] {"indented": 1}
"""


def test_run_log(spark, tmp_path):
    (tmp_path / "copa_sft_full_ng1_20250101_120000.log").write_text(LOG)
    got = {(r["run_name"], r["tag"], r["name"]): r["value"] for r in sources.read_run_log(spark, str(tmp_path)).collect()}
    run = "copa_sft_full_ng1"
    assert got == {
        (run, "eval_init", "eval_init_small_data_accuracy"): 0.5,
        (run, "eval_init", "eval_init_runtime"): 3.0,
        (run, "eval_init", "note"): None,
        (run, "eval_final", "eval_final_small_data_accuracy"): 1.0,
    }


def test_run_log_stream_picks_up_new_files_once(spark, tmp_path):
    logs, sink, state = tmp_path / "logs", str(tmp_path / "sink"), str(tmp_path / "state")
    logs.mkdir()
    (logs / "a.log").write_text('[eval_10] {"acc": 0.25}\n[eval_20] {"acc": 0.5}\n')
    run = lambda: jobs.stream_run_log(spark, str(logs), sink, state).awaitTermination()
    run()
    run()
    (logs / "b.log").write_text('[eval_10] {"acc": 0.75}\n')
    run()
    got = sorted(tuple(r) for r in jobs.latest_from_sink(spark, sink).collect())
    assert got == [("a", "acc", 20, 0.5), ("b", "acc", 10, 0.75)]
    assert spark.read.parquet(sink).count() == 3


def test_score_stream(spark, rows, tmp_path):
    source, sink, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    schema = "ts timestamp, run_id string, step int, example_id int, prediction string"
    data = rows(
        "s string, run_id string, step int, example_id int, prediction string",
        [("2024-01-01 00:00:00", "r", 1, 1, "Final Label: True"), ("2024-01-01 00:01:00", "r", 1, 1, "Final Label: True"),
         ("2024-01-01 00:02:00", "r", 1, 2, "Final Label: False"), ("2024-01-01 02:00:00", "r", 1, 3, "none")],
    ).selectExpr("cast(s as timestamp) ts", "run_id", "step", "example_id", "prediction")
    data.write.parquet(source)
    references = rows("example_id int, task string, reference string", [(i, "wsc", "True") for i in (1, 2, 3)])
    stream = spark.readStream.schema(schema).parquet(source)
    scored = jobs.scored_stream(stream, references)
    jobs.stream_score(scored, sink, state).awaitTermination()
    got = sorted((r["example_id"], r["accuracy"], r["parse_success"]) for r in spark.read.parquet(sink).collect())
    assert got == [(1, 1.0, 1.0), (2, 0.0, 1.0), (3, 0.0, 0.0)]
    live = jobs.windowed_scores(jobs.scored_stream(spark.readStream.schema(schema).parquet(source), references))
    query = live.writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "s2")).trigger(availableNow=True).start()
    query.awaitTermination()
    first = spark.table("live").orderBy("window").first()
    assert first["n"] == 2 and first["accuracy"] == 0.5


def test_writers(spark, rows, tmp_path):
    path = str(tmp_path / "examples")
    df = rows(
        "step int, prompt string, teacher_prompt string, prediction string, reference string, task string",
        [(1, "p", None, "Final Label: True", "True", "wsc"), (2, "p", "t", None, "False", "wsc")],
    )
    sources.write_examples(df, path)
    sources.write_examples(df.where("step = 2").withColumn("prompt", F.lit("q")), path)
    got = sorted((r["step"], r["student_input"], r["teacher_input"], r["completion"], r["predicted_label"], r["gold_label"]) for r in spark.read.parquet(path).collect())
    assert got == [(1, "p", "", "Final Label: True", "True", "True"), (2, "q", "t", "", None, "False")]

    rows_ = rows(
        "mode string, step int, prompt string, completion string, main double, advantage double, ordinal int",
        [("train", 1, "p", "c", 0.0, 0.0, 0), ("eval", 1, "p", "first", 0.0, 0.0, 1), ("eval", 1, "p", "second", 0.0, 0.0, 2)],
    )
    table = sources.completion_table(rows_, rewards=["main"], unique_prompts=True)
    assert table.columns == ["mode", "step", "prompt", "student_input", "teacher_input", "completion", "main", "advantage"]
    assert [r["completion"] for r in table.collect()] == ["first"]
    assert sources.completion_table(rows_, eval_only=False).count() == 3


def test_written_run_log_reads_back(spark, rows, tmp_path):
    path = str(tmp_path / "logs")
    metrics = rows("run_name string, tag string, name string, value double", [("r1", "eval_init", "b", 0.5), ("r1", "eval_init", "a", 1.0), ("r2", "eval_final", "a", 2.0)])
    lines = {r["run_name"]: r["value"] for r in sources.metric_lines(metrics, ["run_name"]).collect()}
    assert lines["r1"] == '[eval_init] {"a":1.0,"b":0.5}'
    sources.write_run_log(metrics, path)
    got = sorted(tuple(r) for r in sources.read_run_log(spark, path, r"/run_name=([^/]+)/").collect())
    assert got == [("r1", "eval_init", "a", 1.0), ("r1", "eval_init", "b", 0.5), ("r2", "eval_final", "a", 2.0)]


def test_latest_metric_of_several_values_at_a_step(rows):
    nan = float("nan")
    data = [("a", "m", 1, 9.0), ("a", "m", 2, nan), ("a", "m", 2, 3.0), ("a", "m", 2, 4.0), ("a", "m", 2, None), ("b", "m", 1, nan)]
    got = {r["run_id"]: (r["step"], r["value"]) for r in runs.latest_metric(rows("run_id string, name string, step int, value double", data)).collect()}
    assert got["a"] == (2, 4.0) and got["b"][0] == 1
