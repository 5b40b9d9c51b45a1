"""Plans that keep a task's memory small on large tables."""

from pyspark.sql import functions as F

from tests.conftest import plan_of
from tuneframe.operators import batches, ordering, scoring


def test_rows_of_whole_batches_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(batches, "TASK_ROWS", 100)
    batched = batches.generation_batches(spark.range(1000).withColumnRenamed("id", "ordinal"), 4, 2)
    dealt = batches.by_batch(batched, 1000)
    assert dealt.rdd.getNumPartitions() == 10
    assert dealt.select("batch_id", F.spark_partition_id()).distinct().count() == 125
    # Both steps of a distinct count stay where the rows are.
    assert plan_of(dealt.groupBy("batch_id").agg(F.countDistinct("ordinal"))).count("Exchange ") == 1


def test_positions_do_not_send_all_rows_to_one_task(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(5000).withColumnRenamed("id", "row_idx")
        for placed in (ordering.seeded_shuffle(rows, 1), ordering.position_by_id(rows.select((F.col("row_idx") * 2**19).alias("row_idx")))):
            assert placed.rdd.getNumPartitions() > 1
            assert sorted(r["pos"] for r in placed.collect()) == list(range(5000))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_aligning_sorts_neither_side(rows):
    predictions = rows("example_id long, prediction string", [(1, "a"), (1, "b"), (2, "c"), (None, "d")])
    references = rows("example_id long, reference string", [(1, "x"), (3, "y"), (None, "z")])
    aligned = scoring.align_predictions(predictions, references)
    plan = plan_of(aligned)
    assert "SortMergeJoin" not in plan and "Sort [" not in plan and plan.count("ShuffledHashJoin") == 2
    got = sorted(((r["example_id"], r["prediction"], r["reference"], r["status"]) for r in aligned.collect()), key=str)
    assert got == sorted([(1, "a", "x", "ok"), (1, "b", "x", "ok"), (2, "c", None, "missing_reference"), (None, "d", None, "missing_reference"),
                          (3, None, "y", "missing_prediction"), (None, None, "z", "missing_prediction")], key=str)
