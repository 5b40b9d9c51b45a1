import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tuneframe.operators import distill
from tuneframe.session import written

ROWS = "seq_id long, token_id long, student_logits array<float>, teacher_logits array<float>, extra string"


def pairs(spark, n, width, seed, teacher_width=None):
    rng = np.random.default_rng(seed)
    data = []
    for i in range(n):
        s, t = (rng.normal(0, 4, w).astype(np.float32).tolist() for w in (width, teacher_width or width))
        data.append((i, int(rng.integers(0, width)), s, t, f"e{i}"))
    return spark.createDataFrame(data, ROWS)


def both(frame, size, alpha, temperature=1.0):
    student = distill.vector_blocks(frame.select("seq_id", "token_id", "extra", "student_logits"), size, "student_logits")
    teacher = distill.vector_blocks(frame.select("seq_id", "teacher_logits"), size, "teacher_logits")
    blocks = distill.token_metrics_blocks(student, teacher, size, ["seq_id"], alpha, temperature)
    whole = distill.token_metrics(frame, alpha, temperature)
    names = ["student_logp", "teacher_logp", "entropy", "divergence"]
    return [{r["seq_id"]: ([r[c] for c in names], r["token_id"], r["extra"]) for r in x.collect()} for x in (blocks, whole)]


def assert_same(got, want):
    assert got.keys() == want.keys()
    for key, (numbers, *rest) in want.items():
        assert got[key][1:] == tuple(rest)
        for a, b in zip(got[key][0], numbers):
            assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)), (key, got[key], numbers)


@pytest.mark.parametrize("alpha", [0.0, 1.0, 0.3])
def test_a_whole_vocabulary_in_blocks(spark, alpha):
    assert_same(*both(written(pairs(spark, 3, 150_000, 1), "vocabulary"), 4096, alpha))


@pytest.mark.parametrize("size", [1, 3, 64, 1000])
@pytest.mark.parametrize("alpha", [0.0, 0.5])
def test_any_block_size(spark, size, alpha):
    assert_same(*both(pairs(spark, 12, 64, 2), size, alpha, temperature=0.7))


def test_large_logits_and_unusable_tokens(spark):
    big = [1e4, -1e4, 5.0, 9e3] * 3
    data = [
        (1, 0, big, big[::-1], "fine"), (2, 12, big, big, "outside"), (3, -1, big, big, "below"), (4, 0, big, big[:10], "widths differ"),
        (5, 0, [1.0, None, 2.0] * 4, big, "hole"), (6, None, big, big, "no token"), (7, 2, big[:4], big[:4], "one block"), (8, 0, big, big[:4], "blocks differ"),
    ]
    frame = spark.createDataFrame(data, ROWS)
    got, want = both(frame, 5, 0.0)
    assert_same(got, want)
    assert {k for k, v in got.items() if v[0][0] is None} == {2, 3, 4, 5, 6, 8}
    empty = spark.createDataFrame([(1, 0, [], [], "x"), (2, 0, None, [1.0], "x")], ROWS)
    assert both(empty, 5, 0.0)[0] == {}


def test_no_whole_vector_is_moved(spark):
    frame = written(pairs(spark, 2, 40, 3), "narrow")
    student = distill.vector_blocks(frame.select("seq_id", "token_id", "student_logits"), 8, "student_logits")
    teacher = distill.vector_blocks(frame.select("seq_id", "teacher_logits"), 8, "teacher_logits")
    plan = distill.token_metrics_blocks(student, teacher, 8, ["seq_id"])._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("Join")[0]
    assert "ArrowEvalPython" in above and "collect_list(_state" in above


# ------------------------------------------------------------------ sketches


def rank_of(values, x):
    return np.searchsorted(values, x, "left"), np.searchsorted(values, x, "right")


@pytest.mark.parametrize("shape", ["uniform", "near zero", "few values", "rising"])
def test_rank_error_of_merged_sketches(spark, shape):
    """Runs from the stored sketches of 40 steps: ranks stay within the stated error."""
    rng = np.random.default_rng(5)
    n, k = 60_000, 200
    values = {
        "uniform": lambda: rng.random(n), "near zero": lambda: rng.exponential(0.01, n) ** 3, "few values": lambda: rng.integers(0, 6, n).astype(float),
        "rising": lambda: np.arange(n, dtype=float),
    }[shape]()
    frame = spark.createDataFrame([(int(i % 3), int(i % 40), float(v), 1) for i, v in enumerate(values)], "run int, step int, entropy double, mask int")
    sketches = written(distill.entropy_sketches(frame, ["run", "step"], k=k), "test-sketches")
    assert sketches.count() == 120
    merged = distill.merge_sketches(sketches, ["run"])
    for q in (0.01, 0.5, 0.8, 0.99):
        for r in distill.sketch_quantile(merged, q).collect():
            own = np.sort(values[np.arange(n) % 3 == r["run"]])
            low, high = rank_of(own, r["threshold"])
            slack = 1.5 * distill.sketch_rank_error(k) * len(own) + 1
            assert r["n"] == len(own) and low - slack <= q * len(own) <= high + slack
    size = sketches.agg(F.max(F.length("sketch"))).first()[0]
    assert size < 16 * k * 8 and 0.01 < distill.sketch_rank_error(k) < 0.03


def test_small_groups_masks_null_and_nan(spark, rows):
    nan = float("nan")
    data = [("a", x, 1) for x in (3.0, 1.0, 2.0, None, nan)] + [("a", 99.0, 0), ("b", None, 1), ("c", 5.0, 1)]
    sketches = distill.entropy_sketches(rows("g string, entropy double, mask int", data), ["g"])
    got = {r["g"]: (r["n"], r["threshold"]) for r in distill.sketch_quantile(sketches, 0.5).collect()}
    assert got == {"a": (3, 2.0), "c": (1, 5.0)}
    top = {r["g"]: r["threshold"] for r in distill.sketch_quantile(sketches, 1.0).collect()}
    assert top == {"a": 3.0, "c": 5.0}


# ------------------------------------------------------------------ NaN

TOKENS = "run string, step int, old_logp double, sampling_logp double, mask int"


def test_a_batch_with_nan_is_skipped_where_the_mean_skips_nan(rows):
    nan = float("nan")
    data = [
        ("r", 1, -1.0, -1.0, 1), ("r", 1, -1.0, -1.5, 1),
        ("r", 2, nan, -1.0, 1), ("r", 2, -9.0, -1.0, 1),
        ("r", 3, nan, -1.0, 0), ("r", 3, -1.0, -2.0, 1),
        ("r", 4, -1.0, -1.0, 0),
        ("s", 1, nan, -1.0, 1),
        ("t", 1, -1.0, -1.2, 1),
    ]
    tokens = distill.importance_ratio(rows(TOKENS, data))
    assert sum(math.isnan(r["ratio"]) for r in tokens.collect()) == 3
    got = {r["run"]: r for r in distill.importance_stats(tokens, ["run", "step"], ["run"]).collect()}
    r = got["r"]
    # Steps 1, 3 and 4 have numbers; a masked NaN does no harm, a step without unmasked tokens counts as 0.
    assert (r["ratio_min"], r["ratio_max"]) == (0.0, 2.0)
    assert math.isclose(r["ratio_mean"], ((1 + math.exp(0.5)) / 2 + 2.0 + 0.0) / 3)
    assert math.isnan(r["logp_difference_mean"]) and math.isnan(r["logp_difference_max"])
    assert got["s"]["ratio_mean"] is None and math.isnan(got["s"]["logp_difference_max"])
    assert math.isclose(got["t"]["logp_difference_max"], 0.2)


def test_kl_mean_skips_nan_batches(rows):
    nan = float("nan")
    data = [("r", 1, 0.2, 1), ("r", 1, 0.4, 1), ("r", 2, nan, 1), ("r", 2, 9.0, 1), ("r", 3, nan, 0), ("r", 3, 7.0, 1), ("r", 4, 5.0, 0), ("s", 1, nan, 1)]
    tokens = rows("run string, step int, kl_approx double, mask int", data)
    got = {r["run"]: r["kl_approx"] for r in distill.kl_approx_mean(tokens, ["run", "step"], ["run"]).collect()}
    # A masked NaN spoils the sum as well, as zero times NaN is NaN; a fully masked step has no mean.
    assert math.isclose(got["r"], 0.3) and got["s"] is None
    means = rows("run string, entropy double", [("r", 1.0), ("r", nan), ("r", None), ("r", 2.0), ("s", nan)])
    assert {r["run"]: r["entropy"] for r in distill.skip_nan_mean(means, ["entropy"], ["run"]).collect()} == {"r": 1.5, "s": None}
