"""The pipeline and the registered queries, against plain versions on small tables."""

import pytest

import corpus_pipeline
from tests.llm.conftest import DOCS
from tools.check import compare, oracle_connection
from tuneframe.llm import catalog
from tuneframe.llm.text import word_count
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_oracles(spark, name):
    assert compare(spark, oracle_connection(SF), name, SF)[1] == "ok"


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 14))


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, SF).persist()
        seen[name] = kept
        if name != "packing":
            assert kept.columns == corpus_pipeline.COLUMNS
    spoken = seen["language id"]
    assert spoken.count() == docs.count()  # clean documents stay
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    want = {}
    for r in spoken.collect():
        want[lower(r["text"])] = max(r["doc_id"], want.get(lower(r["text"]), -1))
    assert sorted(r["doc_id"] for r in seen["exact dedup"].collect()) == sorted(want.values())
    assert seen["near dedup"].count() < seen["exact dedup"].count()
    mixed, whole = seen["mix sources"], seen["near dedup"]
    words = lambda df: df.agg(F.sum(word_count(F.col("text")))).first()[0]
    assert words(mixed) == pytest.approx(1.5 * words(whole), rel=0.2)
    packed = seen["packing"].groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert packed.where("n > 4096").count() == 0
    assert seen["packing"].where("start = 0").count() == mixed.count()


def ids(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.select("doc_id").collect())


def test_odd_rows_by_stage(spark, odd, empty, clashing):
    some = lambda *x: [(i is None, i or 0) for i in x]
    spoken = ids(corpus_pipeline.language_id(spark, odd, SF))
    assert not {1, 2, 7, 8} & {i for _, i in spoken} and (False, 3) in spoken and (False, 4) in spoken  # no text, no letter
    assert ids(corpus_pipeline.exact_dedup(spark, odd, SF)) == some(2, 4, 5, 7, 8, 9)
    assert ids(corpus_pipeline.near_dedup(spark, odd, SF)) == some(1, 2, 3, 5, 5, 7, 8, 9)
    drawn = [i for _, i in ids(corpus_pipeline.mix_sources(spark, odd, SF))]
    assert not {1, 2, 7} & set(drawn) and 3 in drawn  # no words, never drawn
    pieces = corpus_pipeline.pack_windows(spark, odd, SF).collect()
    assert sorted(r["doc_id"] for r in pieces if r["doc_id"] in (1, 2) and r["length"] == 1) == [1, 2]
    for stage in (s for _, s in corpus_pipeline.STAGES):
        assert stage(spark, empty, SF).count() == 0
    kept = clashing
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, SF)
        assert name == "packing" or kept.columns == corpus_pipeline.COLUMNS
    assert {r["doc_id"] for r in kept.collect()} <= set(range(6))


def test_near_copies_leave_one(rows, spark):
    words = [f"w{i}" for i in range(100)]
    copies = [(i, " ".join([*words[:99], f"z{i}"]), "en", "s", 0) for i in range(5)]
    left = corpus_pipeline.near_dedup(spark, rows(DOCS, [*copies, (9, "something else altogether", "en", "s", 0)]), SF)
    assert sorted(r["doc_id"] for r in left.collect()) == [0, 9]


def test_near_copies_are_told_apart_by_id_and_text(rows, spark):
    words = [f"w{i}" for i in range(100)]
    copy = lambda mark: " ".join([*words[:99], mark])
    data = [(1, copy("a")), (2, copy("b")), (2, "a clean text that shares its id"), (None, copy("c")), *((None, " ".join([*(f"v{i}" for i in range(99)), x])) for x in "de")]
    left = corpus_pipeline.near_dedup(spark, rows(DOCS, [(i, t, "en", "s", 0) for i, t in data]), SF).collect()
    assert sorted((r["doc_id"] or 0, r["text"][:7]) for r in left) == [(0, "v0 v1 v"), (1, "w0 w1 w"), (2, "a clean")]
