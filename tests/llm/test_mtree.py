import numpy as np

from tuneframe.llm import mtree


def plain(ids, x, k):
    out = []
    for i, q in zip(ids, x):
        if i % 20 == 0:
            best = sorted(((-int(q @ y), j) for j, y in zip(ids, x) if j != i))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def test_against_all_products(rows):
    rng = np.random.default_rng(5)
    centers = rng.normal(0, 40, (4, 6))
    x = np.rint(centers[rng.integers(0, 4, 300)] + rng.normal(0, 6, (300, 6))).astype(int)
    x[50:80] = x[50]  # one very common vector: ties by id
    df = rows("id long, values array<long>", [(i, v.tolist()) for i, v in enumerate(x)])
    pages = mtree.build_pages(df, shard=90)
    assert pages.select("shard").distinct().count() == 4
    got = mtree.top_k(pages, df.where("id % 20 = 0"), 7, block=5)
    assert sorted(map(tuple, got.collect())) == plain(range(300), x, 7)


def test_tree_skips_far_pages(monkeypatch):
    monkeypatch.setattr(mtree, "PAGE", 16)
    import pandas as pd

    rng = np.random.default_rng(6)
    x = np.rint(np.repeat(rng.normal(0, 400, (20, 8)), 40, 0) + rng.normal(0, 3, (800, 8))).astype(np.int64)
    pages = mtree.bulk_load(np.arange(800), x)
    names = ["node", "parent", "leaf", "radius", "to_parent", "pivot", "ids", "members", "distances"]
    table = pd.DataFrame([(*p[:5], p[5].tobytes(), p[6].astype(np.int64).tobytes(), p[7].astype(np.int64).tobytes(), p[8].tobytes()) for p in pages], columns=names)
    tree = mtree.MTree(table, 8)
    found = tree.search(3, x[3], 5)
    want = sorted(((int(x[3] @ y), -j) for j, y in enumerate(x) if j != 3), reverse=True)[:5]
    assert found == want and tree.computed < 500


def test_large_components(rows):
    """Products beyond doubles and near the end of 64 bits are exact."""
    big = 2**31 - 1
    data = [(0, [40_000_000, 1]), (1, [1, 1]), (20, [big, -big]), (2, [40_000_000, 0]), (3, [big, 3]), (4, [big, 2]), (5, [-big, big]), (6, [2**31 + 5, 2**30])]
    df = rows("id long, values array<long>", data)
    got = mtree.top_k(mtree.build_pages(df), df.where("id % 20 = 0"), 5).collect()
    assert sorted(map(tuple, got)) == plain([i for i, _ in data], [np.array(v, object) for _, v in data], 5)
    tree = [(0, [2**62, 1]), (1, [1, 2**62]), (2, [2, -(2**61)])]
    df = rows("id long, values array<long>", tree)
    got = mtree.top_k(mtree.build_pages(df), rows("id long, values array<long>", [(20, [1, 1])]), 5).collect()
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 2**62 + 1), (1, 2**62 + 1), (2, 2 - 2**61)]


def test_odd_vectors(rows):
    data = [(0, [1.0, 2.0]), (20, [float("nan"), 1.0]), (40, None), (60, []), (80, [None, 1.0]), (100, [float("inf"), 1.0]), (None, [1.0, 1.0]), (1, [0.5, 0.5]), (2, [1.0, 2.0, 3.0])]
    vectors = mtree.quantized(rows("vec_id long, embedding array<float>", data))
    got = mtree.top_k(mtree.build_pages(vectors), vectors.where("id % 20 = 0"), 20).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 64 * 32 + 128 * 32)]
    none = vectors.limit(0)
    assert mtree.top_k(mtree.build_pages(none), none, 3).count() == 0
