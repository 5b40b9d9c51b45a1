import hashlib

from tuneframe.llm import exact
from tuneframe.session import run_folder


def test_report_on_odd_rows(odd, empty, clashing):
    got = exact.dedup_report(odd).collect()
    assert len(got) == 10
    blank = [r for r in got if r["doc_id"] in (1, 2)]
    assert {(r["keep_id"], r["group_size"]) for r in blank} == {(2, 2)} and {r["doc_id"]: r["kept"] for r in blank} == {1: False, 2: True}
    same = [r for r in got if r["doc_id"] in (5, None)]
    assert {(r["keep_id"], r["group_size"]) for r in same} == {(5, 3)}
    assert same[0]["text_sha256"] == hashlib.sha256(b"one two three four five six").hexdigest()
    assert [r["keep_id"] for r in got if r["doc_id"] == 3] == [4]
    assert exact.dedup_report(empty).count() == 0
    assert exact.dedup_report(clashing).where("kept").count() == 6


def test_rows_that_stay(odd, clashing, empty):
    ids = sorted(r["doc_id"] for r in exact.dedup(odd).collect())
    assert ids == [2, 4, 5, 7, 8, 9]
    assert exact.dedup(clashing).columns == clashing.columns and exact.dedup(clashing).count() == 6
    assert exact.dedup(empty).count() == 0


def test_index_keeps_its_buckets(spark, rows):
    """Opened with another number of buckets, no known text comes back as new."""
    path = run_folder(spark, "test-index")
    texts = rows("doc_id long, text string", [(i, f"text {i}") for i in range(40)])
    exact.dedup_report(texts, exact.DigestIndex(spark, path, buckets=4), "first").collect()
    spark.sql(f"DROP TABLE {exact.DigestIndex(spark, path).name}")  # as in another session
    again = exact.DigestIndex(spark, path, buckets=8)
    assert again.buckets == 4 and not [r for r in exact.dedup_report(texts, again, "second").collect() if r["kept"]]
    assert exact.DigestIndex(spark, run_folder(spark, "test-index"), buckets=8).name != again.name


def test_index_over_batches(spark, rows):
    index = exact.DigestIndex(spark, run_folder(spark, "test-index"), buckets=4)
    schema = "doc_id long, text string"
    exact.dedup_report(rows(schema, [(1, "A"), (2, "b")]), index, "first").collect()
    second = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact.dedup_report(rows(schema, [(3, "a"), (4, "c")]), index, "second").collect()}
    assert second == {3: (1, False), 4: (4, True)}
    again = exact.dedup_report(rows(schema, [(3, "a"), (4, "c")]), index, "second")
    assert again.count() == 2 and index.read().count() == 3  # a repeated batch adds nothing
    groups = exact.groups_of(exact.digests(rows(schema, [(9, "new")])))
    plan = index.unseen(groups)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1  # the index side is not shuffled
