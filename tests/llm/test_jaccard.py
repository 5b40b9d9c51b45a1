import random

import numpy as np
import pytest

from tests.llm.conftest import DOCS
from tuneframe.llm import jaccard
from tuneframe.llm.components import components


def plain_groups(texts, k, num, den):
    sets = {}
    for d, t in texts:
        w = (t or "").lower().split()
        sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


@pytest.mark.parametrize("k, num, den", [(4, 85, 100), (5, 80, 100)])
def test_against_all_pairs(rows, k, num, den):
    rng = random.Random(k)
    vocabulary = [f"v{i}" for i in range(500)]
    texts = []
    for _ in range(25):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 6, 20, 60, 300]))]
        for copy in range(rng.choice([1, 2, 8])):
            own = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                at = rng.randrange(len(own))
                own[at : at + rng.choice([0, 1])] = [rng.choice(vocabulary)]
            texts.append((len(texts), " ".join(own)))
    boiler = " ".join(f"b{i}" for i in range(60))
    texts += [(len(texts) + i, boiler + " " + " ".join(rng.choice(vocabulary) for _ in range(30))) for i in range(15)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(rows("doc_id long, text string", texts), k, num, den).collect()}
    assert got == plain_groups(texts, k, num, den)


def test_large_group_of_near_copies(rows):
    rng = random.Random(9)
    base = [f"x{i}" for i in range(400)]
    texts = []
    for i in range(200):
        own = list(base)
        own[rng.randrange(400)] = f"y{i}"
        texts.append((i, " ".join(own)))
    got = jaccard.near_duplicates(rows("doc_id long, text string", texts)).collect()
    assert {r["component_id"] for r in got} == {0}


def test_keys_of_similar_sets_meet():
    rng = np.random.default_rng(1)
    rule = jaccard.Rule(85, 100)
    for _ in range(300):
        n = int(rng.integers(1, 700))
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        gone = rule.difference(2 * n) // 2
        b = np.concatenate((a[int(rng.integers(0, gone + 1)) :], rng.integers(0, 2**63, int(rng.integers(0, gone + 1)), dtype=np.uint64)))
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if 100 * both >= 85 * (len(a) + len(b) - both):
            assert len(np.intersect1d(jaccard.sketch_keys(a, rule), jaccard.sketch_keys(b, rule)))
            x, y = (jaccard.parity_bits(s).view(np.uint64) for s in (a, b))
            assert np.bitwise_count(x ^ y).sum() <= len(a) + len(b) - 2 * both


def test_odd_rows(odd, empty, clashing):
    got = jaccard.near_duplicates(odd, 4, 85, 100).collect()
    assert len(got) == 10
    assert {r["component_id"] for r in got if r["doc_id"] in (5, None)} == {5} and {r["component_id"] for r in got if r["doc_id"] in (3, 4)} == {3}
    assert all(r["component_id"] == r["doc_id"] and r["n_shingles"] == 0 for r in got if r["doc_id"] in (1, 2, 7))
    assert jaccard.near_duplicates(empty).count() == 0
    assert jaccard.near_duplicates(clashing).count() == 6


def test_components(rows):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (7, 7)]
    got = {r["node"]: r["component"] for r in components(rows("u long, v long", edges)).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 102: 100}
    assert components(rows("u long, v long", [])).count() == 0


def test_long_text_is_hashed_in_blocks(monkeypatch):
    from tuneframe.llm import text

    data = np.frombuffer(("word and another " * 3000).encode(), np.uint8)
    whole = text.word_hashes(data)
    monkeypatch.setattr(text, "_BLOCK", 100)
    assert np.array_equal(whole, text.word_hashes(data)) and len(np.unique(whole)) == 3
