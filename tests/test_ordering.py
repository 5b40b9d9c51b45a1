import math
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_of
from tuneframe.operators import ordering


def test_position_of_sparse_ids(rows):
    rng = random.Random(3)
    ids = sorted({rng.choice([rng.randrange(50), rng.randrange(1 << 21), rng.randrange(1 << 45)]) for _ in range(800)})
    shuffled = ids[:]
    rng.shuffle(shuffled)
    got = ordering.position_by_id(rows("row_idx bigint", [(i,) for i in shuffled])).collect()
    assert {r["row_idx"]: r["pos"] for r in got} == {i: n for n, i in enumerate(ids)}


def test_latest_n_is_limited_before_the_shuffle(rows):
    df = rows("run string, o int", [("hot", i) for i in range(50)] + [("b", 1)])
    last = ordering.latest_n(df, 3, "o", ["run"])
    assert sorted(tuple(r) for r in last.collect()) == [("b", 1), ("hot", 47), ("hot", 48), ("hot", 49)]
    assert sorted(r["o"] for r in ordering.latest_n(df, 2, "o", []).collect()) == [48, 49]


@pytest.mark.parametrize("heap", [1 << 17, 64])
def test_latest_n_against_sorting(rows, monkeypatch, heap):
    monkeypatch.setattr(ordering, "HEAP_ROWS", heap)
    rng = random.Random(heap)
    nan = float("nan")
    data = [(rng.choice(["a", "a", "a", None, "b"]), rng.choice([2**62 + 1, 2**62 + 2, None]), rng.choice([None, nan, 0.0, -1.5, rng.random(), float("inf")]), i) for i in range(900)]
    df = rows("g string, h long, o double, i int", data).repartition(7)
    for n in (1, 4, 50, 2000):
        got = {}
        for r in ordering.latest_n(df, n, "o", ["g", "h"]).collect():
            got.setdefault((r["g"], r["h"]), []).append(r)
        key = lambda x: (x is not None, x is not None and math.isnan(x), x if x is not None and not math.isnan(x) else 0)
        for group in {(g, h) for g, h, _, _ in data}:
            want = sorted((key(o) for g, h, o, _ in data if (g, h) == group), reverse=True)[:n]
            assert sorted((key(r["o"]) for r in got[group]), reverse=True) == want
            assert len({r["i"] for r in got[group]}) == len(want)


def test_latest_n_of_a_hot_run_with_large_n(spark):
    """More than Spark limits before a shuffle; wide rows move only from the threshold on, also when most values are equal."""
    n = 5000
    df = spark.range(0, 200_000, numPartitions=16).select(
        F.when(F.col("id") % 50 == 0, "cold").otherwise("hot").alias("run"),
        F.when(F.col("id") < 190_000, 7).otherwise(F.col("id")).alias("o"),
        "id",
        F.repeat(F.lit("x"), 50).alias("wide"),
    )
    last = ordering.latest_n(df, n, "o", ["run"])
    got = {}
    for r in last.select("run", "o").collect():
        got.setdefault(r["run"], []).append(r["o"])
    assert len(got["hot"]) == n and len(got["cold"]) == 4000
    assert sorted(got["hot"]) == [i for i in range(190_000, 200_000) if i % 50][-n:]
    assert sorted(got["cold"]) == [7] * 3800 + list(range(190_000, 200_000, 50))
    plan = plan_of(last)
    wide = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert all("_salt" in line or "run" in line for line in wide) and "SinglePartition" not in plan and "MapInArrow" in plan


def test_first_row_per_prompt(rows):
    df = rows("prompt string, o int, x string", [("a", 2, "late"), ("a", 1, "early"), ("b", 3, "only")])
    got = ordering.drop_duplicate_prompts(df, "o").orderBy("prompt").collect()
    assert [tuple(r) for r in got] == [("a", 1, "early"), ("b", 3, "only")]


def test_smallest_ids_of_a_hot_group(spark):
    df = spark.range(0, 20000, numPartitions=40).select(
        F.col("id"), F.when(F.col("id") % 10 == 0, "cold").otherwise("hot").alias("g")
    )
    got = {r["g"]: (r["n"], r["first_ids"]) for r in ordering.smallest_ids(df, ["g"], "id", 4).collect()}
    assert got == {"hot": (18000, [1, 2, 3, 4]), "cold": (2000, [0, 10, 20, 30])}


def test_dedup_expand_runs_once_per_key(rows):
    df = rows("id int, text string", [(i, "same" if i % 3 else f"t{i}") for i in range(30)])
    seen = []

    def work(distinct):
        seen.append(distinct)
        return distinct.select("key_id", F.length("key").alias("n"))

    got = {r["id"]: r["n"] for r in ordering.dedup_expand(df, F.col("text"), work).collect()}
    assert len(got) == 30 and got[1] == 4 and got[12] == 3
    assert seen[0].count() == 11


def test_scratch_goes_with_its_block(spark):
    import glob

    from tuneframe.session import scratch, shared_folder, written

    with scratch(spark):
        kept = written(spark.range(3).toDF("x"), "scratch-test")
        assert kept.count() == 3
        assert glob.glob(f"{shared_folder(spark).removeprefix('file://')}/tuneframe/scratch-test-*")
    assert not glob.glob(f"{shared_folder(spark).removeprefix('file://')}/tuneframe/scratch-test-*")
