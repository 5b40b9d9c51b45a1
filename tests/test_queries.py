"""Every registered query against its oracle, and the shape of the plans."""

import re

import pytest

import __spark_entry__ as entry
from tuneframe.plans import catalog
from tests.conftest import plan_of
from tools.check import compare, oracle_connection

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_oracle(spark, con, name):
    _, verdict = compare(spark, con, name, SF)
    assert verdict == "ok"


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLES) and set(catalog.QUERIES) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["task", "eval_small_data_accuracy", "eval_small_data_parse_success", "n"] and df.count() == 4


# Written or streamed while the query is built; their result plans are plain scans.
EAGER = {"read_tooluse", "read_tooluse_array", "read_manifest_array", "read_task_splits", "read_fewshot_manifest", "write_examples", "write_examples_tooluse",
         "write_completions", "read_run_log", "stream_run_log", "stream_growing_log", "stream_arrivals", "stream_score"}
# A single partition is fine for one row per bucket, block or statistic.
SMALL = {"sampler_summary", "seeded_shuffle", "eval_sampler"}


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in EAGER])
def test_plan_has_no_pairwise_join(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)
    if name not in SMALL:
        outside = [line for line in plan.splitlines() if "SinglePartition" in line and ":" not in line.split("Exchange")[0]]
        assert len(outside) <= 2, outside


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_bucketed_tables_join_in_place(spark, no_broadcast):
    plan = plan_of(catalog.QUERIES["pair_student_teacher_bucketed"](spark, SF))
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_named_exchanges_without_broadcast(spark, no_broadcast):
    padded = plan_of(catalog.QUERIES["padded_batches"](spark, SF))
    assert padded.count("Exchange") == padded.count("Exchange hashpartitioning(batch_id") == 1 and padded.count("FileScan") == 1
    sliced = plan_of(catalog.QUERIES["microbatch_slices"](spark, SF))
    assert "hashpartitioning" not in sliced and "Exchange rangepartitioning(_run" in sliced  # whole runs of batches, never plan rows
