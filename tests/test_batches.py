from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_of
from tuneframe.operators import batches


def positions(spark, n):
    return spark.range(n).select(F.col("id").alias("row_idx"), F.col("id").alias("pos"))


def brute_force(n, plan):
    out = []
    for start in range(0, n - plan.chunk + 1, plan.chunk):
        for _ in range(plan.repeats):
            for row in range(start, start + plan.chunk):
                out += [row] * plan.num_generations
    return out


@pytest.mark.parametrize("n", [16, 18, 3])
def test_repeat_sampler(spark, n):
    plan = batches.batch_plan(4, 2, num_generations=2, num_iterations=3, generation_batch_size=8)
    assert (plan.chunk, plan.repeats) == (4, 6)
    sampled = batches.repeat_sampler(positions(spark, n), plan)
    got = [r["row_idx"] for r in sampled.orderBy("ordinal").collect()]
    assert got == brute_force(n, plan)
    assert sorted(r["ordinal"] for r in sampled.collect()) == list(range(len(got)))
    if n == 16:
        assert len(got) == 192 and set(Counter(got).values()) == {12}
    summary = batches.sampler_summary(positions(spark, n), plan).first()
    assert (summary["n_dropped"], summary["n_plan_rows"]) == (n % 4, len(got))
    kept = batches.repeat_sampler(positions(spark, n), plan, drop_incomplete=False)
    assert kept.count() == n * 12
    assert "hashpartitioning" not in plan_of(sampled)


def test_sizes():
    assert batches.batch_plan(2, 3, 2) == batches.BatchPlan(6, 3, 2, 1)
    assert batches.batch_plan(2, 3, 2, generation_batch_size=8).steps_per_generation == 4
    assert batches.batch_plan(2, 3, 2, steps_per_generation=5).generation_batch_size == 10
    assert batches.batch_plan(2, 3, 2, num_processes=2).generation_batch_size == 12


@pytest.mark.parametrize(
    "options",
    [
        {"generation_batch_size": 5},
        {"num_generations": 4},
        {"generation_batch_size": 8, "steps_per_generation": 4},
        {"num_generations": 0},
    ],
)
def test_sizes_that_do_not_fit(options):
    with pytest.raises(ValueError):
        batches.batch_plan(2, 3, **{"num_generations": 2, **options})


def test_slices_and_schedule(spark):
    plan = batches.batch_plan(4, 2, num_generations=2)
    sampled = batches.repeat_sampler(positions(spark, 16), plan)
    count = sampled.agg(F.count(F.lit(1))).scalar()
    sliced = batches.microbatch_slices(count, plan, 42, spark)
    sizes = sliced.groupBy("batch_id", "slice").count().collect()
    assert {r["count"] for r in sizes} == {4} and len(sizes) == 16
    again = batches.microbatch_slices(count, plan, 42, spark)
    other = batches.microbatch_slices(count, plan, 43, spark)
    pick = lambda df: {r["ordinal"]: r["slice"] for r in df.collect()}
    assert pick(sliced) == pick(again) != pick(other)
    steps = batches.step_schedule(spark.range(4).withColumnRenamed("id", "step"), plan).orderBy("step").collect()
    assert [(r["generation_id"], r["slice"], r["regenerate"]) for r in steps] == [
        (0, 0, True), (0, 1, False), (1, 0, True), (1, 1, False)
    ]


def test_slices_of_two_processes(spark):
    plan = batches.batch_plan(4, 2, num_generations=2, num_processes=2)
    sliced = batches.microbatch_slices(F.lit(40), plan, 1, spark).collect()
    assert sorted(r["ordinal"] for r in sliced) == list(range(40))
    assert {(r["process"], r["slice"]) for r in sliced} == {(0, 0), (0, 1), (1, 0), (1, 1)}
    assert batches.microbatch_slices(F.lit(0), plan, 1, spark).count() == 0


def test_last_chunk_has_dense_ordinals(spark):
    plan = batches.batch_plan(4, 2, num_generations=2)
    sampled = batches.repeat_sampler(positions(spark, 6), plan, drop_incomplete=False)
    assert sorted(r["ordinal"] for r in sampled.collect()) == list(range(6 * 2 * 2))


def test_padding(rows):
    df = rows(
        "batch_id int, p array<int>, c array<int>", [(0, [5, 6], [7, 3]), (0, [5], [7, 8, 9]), (1, [4], [2])]
    )
    out = batches.padded_batches(df, "batch_id", "p", "c", pad=0, eos=3, mask_truncated=True).orderBy("batch_id", "p").collect()
    assert out[0]["input_ids"] == [0, 5, 7, 8, 9] and out[0]["attention_mask"] == [0, 1, 0, 0, 0]
    assert out[1]["input_ids"] == [5, 6, 7, 3, 0] and out[1]["attention_mask"] == [1, 1, 1, 1, 0]
    assert out[2]["input_ids"] == [4, 2]


def test_images(rows):
    df = rows("batch_id int, id int, images array<string>", [(0, 1, []), (0, 2, ["a", "b"]), (1, 3, []), (1, 4, [])])
    got = {r["id"]: (r["images"], r["num_images"]) for r in batches.normalize_images(df, "batch_id").collect()}
    assert got == {1: ([], 0), 2: (["a", "b"], 2), 3: (None, None), 4: (None, None)}
    single = rows("batch_id int, id int, image string", [(0, 1, "a"), (0, 2, None)])
    got = {r["id"]: r["images"] for r in batches.normalize_images(single, "batch_id").collect()}
    assert got == {1: ["a"], 2: None}
