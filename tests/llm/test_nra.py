import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tuneframe.llm import nra

DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k):
    """Every document scored for every item."""
    held = [(i, Counter(t), len(t)) for i, text in docs if (t := split(text))]
    size = sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c, n in held:
            m = 100 - 25 + 25 * n * len(held) // size
            score = sum(math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in split(text) if c[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -score) for rank, (score, *_, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(rows, docs, items, k):
    got = nra.Index(rows(DOCS, docs)).search(rows(ITEMS, items), k).collect()
    return sorted(map(tuple, got), key=str)


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Ärger", "naïve", "x1y"]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [(i, " ,-\n"[rng.randrange(4)].join(rng.choices(words, weights, k=rng.randrange(1, 60)))) for i in range(n)]


@pytest.mark.parametrize("shard", [1 << 14, 50])
def test_against_every_score(rows, monkeypatch, shard):
    monkeypatch.setattr(nra, "SHARD_DOCUMENTS", shard)
    monkeypatch.setattr(nra, "READ", 4)
    docs = corpus(400, 1)
    docs += [(1000 + i, docs[i][1]) for i in range(30)] + [(5, docs[5][1]), (None, docs[5][1])]  # copies: ties, a repeated and a null id
    items = [(i, text) for i, (_, text) in enumerate(corpus(12, 2))] + [(50, "w0 W0 w0 w1"), (51, "nowhere"), (52, None), (53, ""), (50, "w3"), (None, "w59")]
    assert found(rows, docs, items, 20) == plain(docs, items, 20)


def test_odd_rows(rows, odd, empty, clashing, spark):
    items = rows(ITEMS, [(1, "one TWO words lorem"), (2, "…")])
    data = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = sorted(map(tuple, nra.Index(odd).search(items, 20).collect()), key=str)
    assert got == plain(data, [(1, "one TWO words lorem"), (2, "…")], 20) and len(got) == 6
    assert nra.Index(empty).search(items, 20).count() == 0
    assert nra.Index(odd).search(rows(ITEMS, []), 20).count() == 0
    assert nra.Index(clashing).search(clashing.selectExpr("doc_id as item_id", "text", "score", "size"), 3).count() == 18


def test_blocks_of_long_texts(rows, monkeypatch):
    monkeypatch.setattr(nra, "BLOCK", 7)
    text = "Alpha beta,gamma  éé delta9 " * 5
    assert [t.decode() for block in nra.terms(text.encode()) for t in block] == split(text)
    docs = [(1, text), (2, "beta"), (3, "")]
    assert found(rows, docs, [(1, "BETA gamma")], 5) == plain(docs, [(1, "BETA gamma")], 5)


def test_queries_in_blocks(rows, monkeypatch):
    monkeypatch.setattr(nra, "QUERY_TERMS", 10)
    docs, items = corpus(60, 4), [(i, text) for i, (_, text) in enumerate(corpus(9, 5))]
    assert found(rows, docs, items, 5) == plain(docs, items, 5)


def test_reading_ends_early():
    """Documents far below the best are never read to the end."""

    class Counted(np.ndarray):
        read = 0

        def __getitem__(self, at):
            if isinstance(at, slice):
                Counted.read += len(range(*at.indices(len(self))))
            return np.asarray(super().__getitem__(at))

    n = 20_000
    docs = np.arange(n).view(Counted)
    impacts = np.concatenate((np.full(30, 10**6), np.full(n - 30, 10)))
    best = nra.nra([(docs, impacts, 7), (docs, impacts, 5)], np.arange(n), 20)
    assert best == [(i, 12 * 10**6) for i in range(20)] and Counted.read <= 4 * nra.READ
