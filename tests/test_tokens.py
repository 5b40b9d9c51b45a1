import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_of
from tuneframe import sources
from tuneframe.functions import tokens as K
from tuneframe.operators import completions, distill

T = [2.0, 1.0, 0.0]
S1 = [0.0, 1.0, 2.0]
S2 = [0.5, 0.0, 0.0]
PAIR = "run_id string, batch_id int, seq_id int, pos int, token_id int, mask int, student_logits array<float>, teacher_logits array<float>"


@pytest.mark.parametrize("engine", ["arrow", "sql"])
@pytest.mark.parametrize(
    "student, alpha, want",
    [(S1, 0.0, 1.1504207652), (S1, 1.0, 1.1504207652), (S2, 0.0, 0.1293607097), (S2, 1.0, 0.1613664331),
     (S2, 0.25, 0.0251111694), (S2, 0.5, 0.0350313236), (S2, 0.75, 0.0278865127)],
)
def test_divergences(rows, engine, student, alpha, want):
    df = rows(PAIR, [("r", 0, 0, 0, 1, 1, student, T)])
    row = distill.token_metrics(df, alpha, engine=engine).first()
    assert row["divergence"] == pytest.approx(want, abs=1e-9)


def test_entropy_and_temperature(rows):
    df = rows(PAIR, [("r", 0, 0, 0, 0, 1, T, S2)])
    assert distill.token_metrics(df).first()["entropy"] == pytest.approx(0.8323955818, abs=1e-9)
    for engine in ("arrow", "sql"):
        cooled = distill.token_metrics(df, temperature=2.0, engine=engine).first()
        assert cooled["student_logp"] == pytest.approx(1.0 - math.log(sum(math.exp(x / 2) for x in T)), abs=1e-9)


def test_engines_agree_on_ragged_batches(rows):
    rng = random.Random(1)
    data = []
    for i in range(300):
        n = rng.randint(1, 40)
        data.append(("r", 0, 0, i, rng.randrange(n), 1, [rng.uniform(-30, 30) for _ in range(n)], [rng.uniform(-30, 30) for _ in range(n)]))
    df = rows(PAIR, data)
    for alpha in (0.0, 0.3, 1.0):
        arrow = {r["pos"]: r for r in distill.token_metrics(df, alpha).collect()}
        sql = {r["pos"]: r for r in distill.token_metrics(df, alpha, engine="sql").collect()}
        for pos, row in arrow.items():
            for name in ("student_logp", "teacher_logp", "entropy", "divergence"):
                assert row[name] == pytest.approx(sql[pos][name], rel=1e-9, abs=1e-9)


def test_k3_and_ratio(rows):
    df = rows("s double, t double", [(-1.0, -0.5), (-0.5, -1.0), (-1.0, -3.0)])
    got = [r[0] for r in df.select(K.k3(F.col("s"), F.col("t"))).collect()]
    assert got == pytest.approx([0.1487212707, 0.1065306597, 1.1353352832], abs=1e-9)
    df = rows("old_logp double, sampling_logp double", [(-0.5, 0.0), (0.5, 0.0), (2.0, 0.0)])
    got = [r["ratio"] for r in distill.importance_ratio(df).collect()]
    assert got == pytest.approx([0.6065306597, 1.6487212707, 2.0], abs=1e-9)


def test_sequence_loss_and_skip(rows):
    data = [("r", 0, 0, pos, 0, 1, S1 if pos == 0 else T, T) for pos in range(3)]
    tokens = distill.token_metrics(rows(PAIR, data))
    keys = ["run_id", "batch_id", "seq_id"]
    loss = lambda df: distill.sequence_loss(distill.sequence_means(df, keys), ["run_id"]).first()["loss"]
    assert loss(tokens) == pytest.approx(0.3834735884, abs=1e-9)
    assert loss(tokens.withColumn("mask", distill.skip_first_tokens(1))) == pytest.approx(0.0, abs=1e-12)
    halved = distill.sequence_loss(distill.sequence_means(tokens, keys), ["run_id"], 2).first()["loss"]
    assert halved == pytest.approx(0.3834735884 / 2, abs=1e-9)
    for unset in (None, 0, -1):
        assert distill.sequence_loss(distill.sequence_means(tokens, keys), ["run_id"], unset).first()["loss"] == pytest.approx(0.3834735884, abs=1e-9)


def test_all_masked_sequence_is_zero_and_batch_mean_null(rows):
    df = rows(
        "run_id string, batch_id int, seq_id int, pos int, mask int, divergence double, kl_approx double",
        [("r", 0, 0, 0, 0, 5.0, 1.0), ("r", 1, 1, 0, 1, 2.0, 3.0)],
    )
    means = {r["seq_id"]: r["loss"] for r in distill.sequence_means(df, ["run_id", "seq_id"]).collect()}
    assert means == {0: 0.0, 1: 2.0}
    got = distill.kl_approx_mean(df, ["run_id", "batch_id"], ["run_id"]).first()["kl_approx"]
    assert got == 3.0
    assert distill.masked_batch_mean(df, ["divergence"], ["run_id"]).first()["divergence"] == 2.0
    assert distill.masked_batch_mean(df, ["divergence"], ["run_id"], single_column=True).first()["divergence"] == 3.5


ENTROPY = "run_id string, seq_id int, pos int, entropy double, mask int"


def entropy_rows(masks):
    values = [[0.1, 0.9, 0.2], [0.8, 0.3, 0.4]]
    return [("r", s, p, values[s][p], masks[s][p]) for s in range(2) for p in range(3)]


def test_entropy_mask(rows):
    df = rows(ENTROPY, entropy_rows([[1, 1, 0], [1, 0, 0]]))
    assert distill.entropy_quantile(df, 0.5, ["run_id"]).first()["threshold"] == pytest.approx(0.8)
    kept = distill.high_entropy_mask(df, 0.5, ["run_id"]).where("entropy_mask").collect()
    assert sorted((r["seq_id"], r["pos"]) for r in kept) == [(0, 1), (1, 0)]
    none = distill.high_entropy_mask(rows(ENTROPY, entropy_rows([[0] * 3] * 2)), 0.5, ["run_id"])
    assert none.count() == 6 and none.where("entropy_mask").count() == 0


def test_exact_quantile_with_hot_values(rows):
    rng = random.Random(5)
    groups = {
        "flat": [0.0] * 400 + [rng.uniform(0, 11) for _ in range(200)],
        "spread": [rng.uniform(0, 11) for _ in range(777)],
        "one": [3.25],
        "two": [1.0, 2.0],
        "close": [1.0 + i * 1e-7 for i in range(101)],
        "tiny": [rng.uniform(-1e-16, 1e-16) for _ in range(300)] + [0.0] * 50,
        "signs": [rng.uniform(-5, 5) for _ in range(333)],
    }
    df = rows("g string, v double", [(g, v) for g, values in groups.items() for v in values])
    for q in (0.0, 0.2, 0.5, 0.8, 0.999, 1.0):
        got = {r["g"]: r["threshold"] for r in distill.exact_quantile(df, "v", q, ["g"]).collect()}
        for g, values in groups.items():
            assert got[g] == pytest.approx(np.quantile(values, q), abs=1e-12), (g, q)


def test_importance(rows):
    df = rows(
        "run_id string, batch_id int, seq_id int, mask int, divergence double, ratio double, old_logp double, sampling_logp double",
        [("r", 0, 0, 1, 1.0, 2.0, -1.0, -2.0), ("r", 0, 0, 1, 3.0, 1.0, -1.0, -1.0), ("r", 1, 1, 0, 9.0, 9.0, -1.0, -5.0)],
    )
    by_seq = {r["seq_id"]: r for r in distill.sequence_means(df, ["seq_id"], importance=True).collect()}
    assert by_seq[0]["importance_weight"] == 1.5 and by_seq[0]["loss"] == 3.0 and by_seq[1]["loss"] == 0.0
    stats = distill.importance_stats(df, ["run_id", "batch_id"], ["run_id"]).first()
    assert (stats["ratio_min"], stats["ratio_mean"], stats["ratio_max"]) == (0.0, 0.75, 2.0)
    assert (stats["logp_difference_mean"], stats["logp_difference_max"]) == (0.25, 1.0)


def test_shift_and_keep(rows):
    tokens = rows("seq_id int, pos int, x int", [(0, i, i) for i in range(6)])
    lengths = rows("seq_id int, n_positions int, n_completion int", [(0, 6, 3)])
    got = distill.shift_and_keep(tokens, lengths, ["seq_id"]).orderBy("pos").collect()
    assert [(r["pos"], r["x"]) for r in got] == [(0, 2), (1, 3), (2, 4)]


def test_blend(rows):
    model, ref = rows("key string, value array<double>", [("w", [2.0, 4.0])]), rows("key string, value array<double>", [("w", [10.0, 20.0])])
    assert distill.blend_vectors(model, ref, 0.25).first()["value"] == [8.0, 16.0]
    steps = rows("key string, step int, value array<double>", [("w", 4, [4.0])])
    start = rows("key string, value array<double>", [("w", [0.0]), ("v", [7.0])])
    got = {r["key"]: r["value"] for r in distill.blend_history(steps, start, 0.5, 2).collect()}
    assert got == {"w": [2.0], "v": [7.0]}
    got = {r["key"]: r["value"] for r in distill.blend_history(steps, start, 0.5, 3).collect()}
    assert got == {"w": [0.0], "v": [7.0]}


@pytest.mark.parametrize("alpha", [0.3, 1.0, 0.0])
def test_blend_history_follows_the_recurrence(rows, alpha):
    rng = random.Random(2)
    vectors = {s: [rng.uniform(-1, 1) for _ in range(3)] for s in range(12)}
    want = [1.0, 2.0, 3.0]
    for s in sorted(vectors):
        if s % 3 == 0:
            want = [alpha * m + (1 - alpha) * r for m, r in zip(vectors[s], want)]
    steps = rows("key string, step int, value array<double>", [("w", s, v) for s, v in vectors.items()])
    start = rows("key string, value array<double>", [("w", [1.0, 2.0, 3.0])])
    assert distill.blend_history(steps, start, alpha, 3).first()["value"] == pytest.approx(want, abs=1e-12)


def test_bucketed_tables_join_without_shuffle(spark, rows):
    student = rows("run_id string, seq_id int, pos int, student_logits array<float>", [("r", i, 0, T) for i in range(50)])
    teacher = rows("run_id string, seq_id int, pos int, teacher_logits array<float>", [("r", i, 0, T) for i in range(50)])
    sources.save_token_table(student, "student_tokens", 4)
    sources.save_token_table(teacher, "teacher_tokens", 4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        pairs = distill.pair_student_teacher(spark.table("student_tokens"), spark.table("teacher_tokens"))
        assert "Exchange" not in plan_of(pairs) and pairs.count() == 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_completion_stats(rows):
    df = rows(
        "run_id string, mode string, step int, batch_id int, completion_ids array<int>, prompt_ids array<int>",
        [("r", "train", 0, 0, [5, 3], [1]), ("r", "train", 0, 0, [5, 6, 7], [1, 1]), ("r", "train", 0, 0, [], [1]),
         ("r", "train", 1, 1, [9], [1]), ("r", "eval", 1, 2, [4, 0], [1, 2])],
    )
    got = {r["batch_id"]: r for r in completions.completion_stats(df, 3, 0).collect()}
    assert got[0]["clipped_ratio"] == 0.5 and got[0]["n_empty"] == 1 and got[0]["mean_length"] == pytest.approx(5 / 3)
    assert got[0]["mean_terminated_length"] == 2.0 and got[0]["max_length"] == 3
    assert got[1]["clipped_ratio"] == 1.0 and got[1]["min_terminated_length"] == 0 and got[1]["mean_terminated_length"] == 0.0
    totals = {(r["step"], r["mode"]): r["num_tokens"] for r in completions.token_totals(df).collect()}
    assert totals == {(0, "train"): 9, (1, "train"): 11, (1, "eval"): 11}


def test_unusable_rows_are_null_and_leave_neighbours_alone(rows):
    good = ("r", 0, 0, 9, 1, 1, S1, T)
    bad = [
        ("r", 0, 0, 1, 3, 1, S1, T), ("r", 0, 0, 2, 0, 1, S1, T[:2]), ("r", 0, 0, 3, 0, 1, [], []), ("r", 0, 0, 4, 0, 1, None, T),
        ("r", 0, 0, 5, -1, 1, S1, T), ("r", 0, 0, 6, None, 1, S1, T), ("r", 0, 0, 7, 0, 1, [1.0, None, 2.0], T),
    ]
    alone = distill.token_metrics(rows(PAIR, [good])).first().asDict()
    for engine in ("arrow", "sql"):
        found = {r["pos"]: r.asDict() for r in distill.token_metrics(rows(PAIR, [*bad, good]).coalesce(1), engine=engine).collect()}
        assert len(found) == 8
        assert {k: found[9][k] for k in ("student_logp", "divergence")} == pytest.approx({k: alone[k] for k in ("student_logp", "divergence")})
        assert all(found[i][k] is None for i in range(1, 8) for k in ("student_logp", "teacher_logp", "entropy", "divergence"))
