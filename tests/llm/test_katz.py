import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import DOCS
from tuneframe.llm import katz


def brute(docs):
    """(score, base) of each text and the probability function, from plain counts."""
    tokens = [[*(t or "").split(), "</s>"] for t, _ in docs]
    uni, follow = collections.Counter(), collections.defaultdict(collections.Counter)
    for w, (_, held) in zip(tokens, docs):
        if not held:
            uni.update(w)
            for a, b in zip(["<s>", *w[:-1]], w):
                follow[a][b] += 1
    n, v = sum(uni.values()), len(uni)
    d1 = katz.discounts(collections.Counter(uni.values()))
    d2 = katz.discounts(collections.Counter(r for f in follow.values() for r in f.values()))
    mass = lambda d, r: d[min(r, katz.CUT + 1)] * r
    used = sum(r - mass(d1, r) for r in uni.values())
    total = n if used > 0 else n + 1
    unknown = (used or 1.0) / total

    def p1(w):
        return mass(d1, uni[w]) / total if w in uni else unknown

    def p(a, w):
        if a not in follow:
            return p1(w)
        f = follow[a]
        t, s = sum(f.values()), sum(mass(d2, r) for r in f.values())
        whole = t if t - s > 1e-9 * t else t + 1
        return mass(d2, f[w]) / whole if w in f else (whole - s) / whole / (1 - sum(map(p1, f))) * p1(w)

    scores = [sum(math.log10(p(a, b)) for a, b in zip(["<s>", *w[:-1]], w)) for w in tokens]
    base = [sum(math.log10((uni[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w) for w in tokens]
    return scores, base, p, uni, follow


@pytest.mark.parametrize("top, part", [(1 << 20, 1 << 19), (8, 60)])
def test_against_plain_counts(rows, monkeypatch, top, part):
    monkeypatch.setattr(katz, "PART_TOKENS", part)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    docs = [(" ".join(rng.choice(words[: rng.choice([3, 60])]) for _ in range(rng.randrange(60))), i % 5 == 1) for i in range(80)]
    docs[7] = (None, False)
    docs[11] = ("never seen these", True)
    df = rows("doc_id int, text string, held_out boolean", [(i, t, h) for i, (t, h) in enumerate(docs)]).repartition(3)
    scores, base, p, uni, follow = brute(docs)
    for a in list(follow)[:20]:
        assert sum(p(a, w) for w in uni) + p(a, "unknown!") == pytest.approx(1)
    got = {r["doc_id"]: r for r in katz.score(df, top).collect()}
    assert len(got) == 80
    for i, (t, h) in enumerate(docs):
        w = [*(t or "").split(), "</s>"]
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["held_out"]) == (len(w), sum(x in uni for x in w), h)
        assert got[i]["score"] == pytest.approx(scores[i]) and got[i]["base_score"] == pytest.approx(base[i])
        assert got[i]["train_tokens"] == sum(uni.values())


def test_a_hot_bigram_is_counted_up_in_its_chunk(rows, monkeypatch):
    rng = random.Random(6)
    docs = [(" ".join(["yes no"] * rng.randrange(40) + ["no"] * rng.randrange(30) + [rng.choice(["yes", "w1", f"x{i}"])]), i % 5 == 1) for i in range(90)]
    plain_batch = katz._batch

    def bounded(made, names, kinds):
        for r in made if names == katz._NAMES else []:
            assert r[2] != katz.TOKENS or len(r[5]) // 4 <= 60  # words of single tokens; "yes no" alone has hundreds a chunk
        return plain_batch(made, names, kinds)

    df = rows("doc_id int, text string, held_out boolean", [(i, t, h) for i, (t, h) in enumerate(docs)]).repartition(3)
    scores, base, *_ = brute(docs)
    monkeypatch.setattr(katz, "PART_TOKENS", 60)
    monkeypatch.setattr(katz, "OFTEN", 4)
    monkeypatch.setattr(katz, "_batch", bounded)
    for top in (1 << 20, 2):
        got = {r["doc_id"]: r for r in katz.score(df, top).collect()}
        for i in range(len(docs)):
            assert got[i]["score"] == pytest.approx(scores[i]) and got[i]["base_score"] == pytest.approx(base[i])
    monkeypatch.setattr(katz, "OFTEN", 1 << 40)
    with pytest.raises(Exception, match="AssertionError"):
        katz.score(df).collect()


def test_odd_rows(odd, rows):
    from pyspark.sql import functions as F

    docs = odd.select("doc_id", "text", F.lit(False).alias("held_out"), F.lit("z").alias("chunk"))
    got = katz.score(docs).collect()
    assert len(got) == 10 and {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 7)} == {1}
    assert {r["score"] for r in katz.score(docs.withColumn("held_out", F.lit(True))).collect()} == {0.0}
    assert katz.score(rows(DOCS + ", held_out boolean", [])).count() == 0


def test_words_of_a_column_are_told_apart_by_arrow():
    texts = ["A b\t\x0ba", None, "", " \r\n\x0c", "\u00c4 \u00e4 \u2003x", "\x1c a\x85 B "]
    tokens, begin, names = katz._named(pa.array(["left out", *texts]).slice(1))
    words = [(t or "").encode().lower().split() for t in texts]
    assert np.diff(begin).tolist() == [len(w) + 1 for w in words] and names[-1] == katz.END
    name = {}
    for i, own in enumerate(words):
        got = tokens[begin[i] : begin[i + 1]]
        assert names[got[-1]] == katz.END
        for w, n in zip(own, names[got[:-1]].tolist()):
            assert name.setdefault(w, n) == n
    assert len(set(name.values())) == len(name) == len(names) - 1


def test_chunks_of_one_document(rows, monkeypatch):
    monkeypatch.setattr(katz, "CHUNK_DOCS", 1)
    data = [(i, f"a b c{i % 3} d", i % 5 == 1) for i in range(40)]
    seen = katz.score(rows("doc_id int, text string, held_out boolean", data)).collect()
    scores, base, *_ = brute([(t, h) for _, t, h in data])
    assert sorted(r["doc_id"] for r in seen) == list(range(40))
    for r in seen:
        assert r["score"] == pytest.approx(scores[r["doc_id"]]) and r["base_score"] == pytest.approx(base[r["doc_id"]])
