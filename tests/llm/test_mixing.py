import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import DOCS
from tuneframe.llm import mixing


def make(rows, n=400):
    data = []
    for i in range(n):
        source = None if i % 11 == 0 else ("hot" if i % 3 == 0 else f"s{i % 5}")
        data.append((i, "w " * (1 + i * 7 % 40), "en", source, 0))
    return rows(DOCS, data)


def test_targets_and_taken(rows):
    got = mixing.mix(make(rows)).collect()
    by = {}
    for r in got:
        assert r["taken"] == sum(d["words"] for d in r["draws"]) <= 2 * r["size"]
        by.setdefault(r["source"], []).append(r)
    for own in by.values():
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1
    sizes = {s: own[0]["source_size"] for s, own in by.items()}
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, fixed = 1.5 * sum(sizes.values()), {}
    while True:  # share by weight, stop at twice the source, share again
        open_ = [s for s in sizes if s not in fixed]
        level = left / sum(weights[s] for s in open_)
        over = [s for s in open_ if level * weights[s] > 2 * sizes[s]]
        if not over:
            fixed |= {s: level * weights[s] for s in open_}
            break
        for s in over:
            fixed[s] = 2 * sizes[s]
            left -= fixed[s]
    assert {s: own[0]["target"] for s, own in by.items()} == pytest.approx(fixed)


def test_reruns_agree_and_shards_are_even(rows):
    docs = make(rows)
    pick = lambda df: sorted((r["doc_id"], str(r["draws"])) for r in df.select("doc_id", "draws").collect())
    first = mixing.mix(docs.repartition(5), shards=3, max_blocks=40)
    assert pick(first) == pick(mixing.mix(docs.coalesce(1), shards=3, max_blocks=40))
    shards = {d["shard"] for r in first.collect() for d in r["draws"]}
    assert shards == {0, 1, 2}
    assert mixing.mixed_rows(first, ["doc_id"]).columns == ["doc_id", "copy", "words", "shard", "shuffle_key"]


def test_whole_documents_are_not_cut(rows):
    for r in mixing.mix(make(rows), whole_documents=True).collect():
        assert all(d["words"] == r["size"] for d in r["draws"])


def test_rows_leave_in_the_order_of_the_mix(rows, spark, tmp_path):
    docs = make(rows, 2000).coalesce(2)
    mixed = mixing.mix(docs, shards=3, whole_documents=True)
    mixing.write_shards(mixed, ["doc_id"], str(tmp_path / "mix"))
    parts = sorted((tmp_path / "mix").glob("shard=*/*.parquet"))
    assert [p.parent.name for p in parts] == ["shard=0", "shard=1", "shard=2"]
    want = {}
    for r in mixing.mixed_rows(mixed, ["doc_id"]).collect():
        want.setdefault(r["shard"], []).append((r["shuffle_key"], r["doc_id"]))
    for shard, part in enumerate(parts):
        assert [(r["shuffle_key"], r["doc_id"]) for r in spark.read.parquet(str(part)).collect()] == sorted(want[shard])
    ids = [r["doc_id"] for r in corpus_pipeline.mix_sources(spark, docs, "").collect()]
    assert len(ids) - len(set(ids)) > 300
    assert sum(a == b for a, b in zip(ids, ids[1:])) < 10


def test_hypergeometric_draws(spark):
    chances = spark.range(4000).select(((F.col("id") * 2654435761 % 4000 + 0.5) / 4000).alias("u"))
    draws = chances.select(mixing.hypergeometric(F.lit(60).cast("long"), F.lit(20).cast("long"), F.lit(30).cast("long"), F.col("u")).alias("x"))
    x = np.array([r["x"] for r in draws.collect()])
    assert abs(x.mean() - 10) < 0.15 and abs(x.var() - 30 / 3 * 2 / 3 * 30 / 59) < 0.35


def test_tree_keeps_quotas(rows):
    units = [300, 50, 0, 1, 77, 1000]
    quotas = mixing.shard_quotas(rows("_m_rank long, _m_units long", list(enumerate(units))), 7).collect()
    table = np.array([r["quotas"] for r in quotas])
    assert table.sum(0).tolist() == units and table.min() >= 0 and table.sum(1).max() - table.sum(1).min() <= 1


def test_odd_rows(odd, empty, clashing):
    got = mixing.mix(odd).collect()
    assert len(got) == 10 and all(r["taken"] <= 2 * r["size"] for r in got)
    assert {r["size"] for r in got if not re.search(r"\S", r["text"] or "")} == {0}
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(clashing).where("taken > 0").count() > 0
