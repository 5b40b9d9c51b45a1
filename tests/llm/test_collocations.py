import random
import re
from collections import Counter

import numpy as np
import pytest

from tuneframe.llm import collocations as C
from tuneframe.llm.quotient import Codec, Filter

DOCS = "doc_id long, text string, lang string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, least, n_best=2000, longest=5):
    """All phrases counted in dictionaries."""
    f, n = Counter(), Counter()
    for _, text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    good = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    inside = Counter()
    for (lang, *w), a in good.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, *w[i : i + k]] = max(inside[lang, *w[i : i + k]], a)
    out = {}
    for p, a in good.items():
        lang, *w = p
        if 100 * inside[p] >= 100 * a:
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), " ".join(w), a, f[lang, *w[:k]], f[lang, *w[k:]], n[lang], score))
    return sorted((lang, rank, *row[3:]) for lang, all_ in out.items() for rank, row in enumerate(sorted(all_)[:n_best], 1))


def found(docs, least):
    return sorted(map(tuple, C.best(C.Phrases(docs, least=least).scored()).collect()))


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a", "b", "ß", "é", "x-y", "(z)", "\x01", "\x1c"] + [f"w{i}" for i in range(15)]
    phrases = ["in the middle of", "new york city hall now", "a a a a", "the end"]
    out = []
    for i in range(n):
        parts = [rng.choice(phrases) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randrange(0, 40))]
        text = "".join(p + rng.choice([" "] * 12 + ["\t", "  ", ". ", ",", "\n", "\r\n", "; ", "!?", "\x0b"]) for p in parts)
        out.append((i, text, rng.choice(["en", "en", "en", "de", None, "und"])))
    return out


def test_against_dictionaries(rows, monkeypatch):
    """Also with short blocks, chunks of a few documents and many shards."""
    docs = corpus(300, 3)
    assert found(rows(DOCS, docs), 12) == plain(docs, 12)
    monkeypatch.setattr(C, "BLOCK", 9)
    monkeypatch.setattr(C, "CHUNK_WORDS", 2000)
    monkeypatch.setattr(C, "SHARD_BYTES", 2000)
    assert found(rows(DOCS, docs).repartition(3), 3) == plain(docs, 3)


def test_few_ranks(rows):
    docs = corpus(200, 9)
    frame = rows(DOCS, docs).coalesce(2)
    got = sorted(map(tuple, C.best(C.Phrases(frame, least=3).scored(), n=4, salts=3).collect()))
    assert got == plain(docs, 3, n_best=4)


def test_odd_rows(odd, empty, clashing):
    data = [(r["doc_id"], r["text"], r["lang"]) for r in odd.collect()]
    assert found(odd, 2) == plain(data, 2) and found(odd, 2)
    assert found(empty, 2) == []
    data = [(r["doc_id"], r["text"], r["lang"]) for r in clashing.collect()]
    assert found(clashing, 2) == plain(data, 2)


@pytest.mark.parametrize("bits", [1, 2, 7, 15, 16, 21, 25, 31, 32, 40, 63, 64])
@pytest.mark.parametrize("words", [1, 2, 5])
def test_filters_lose_nothing(bits, words):
    codec = Codec(bits, words)
    rng = np.random.default_rng(bits)
    top = min(2**bits, 2**63) - 1
    columns = [rng.integers(0, min(top, 5) + 1, 500).astype(np.uint64) if i % 2 else rng.integers(0, top, 500, endpoint=True).astype(np.uint64) for i in range(words)]
    columns = [np.concatenate([c, c[:100], np.repeat(c[:1], 400)]) for c in columns]
    want = Counter(zip(*(c.tolist() for c in columns)))
    whole = Filter.count(codec, columns)
    assert dict(zip(zip(*(c.tolist() for c in whole.words())), whole.counts.tolist())) == want
    for prefix_bits in sorted({0, min(3, codec.width), min(codec.width, 9)}):
        parts = [Filter.from_bytes(codec, part.to_bytes(prefix_bits), prefix) for prefix, part in whole.split(prefix_bits)]
        again = Filter.merge(codec, parts)
        assert all((a == b).all() for a, b in zip(again.limbs, whole.limbs)) and (again.counts == whole.counts).all()
    twice = Filter.merge(codec, [whole, whole])
    assert len(twice) == len(whole) and (twice.counts == 2 * whole.counts).all()
    assert len(Filter.from_bytes(codec, Filter.merge(codec, []).to_bytes())) == 0


def test_filters_are_compact():
    rng = np.random.default_rng(1)
    pairs = Filter.count(Codec(15, 2), [rng.integers(1, 2**15, 100_000).astype(np.uint64) for _ in range(2)])
    assert len(pairs.to_bytes()) < 3.6 * len(pairs)  # two bytes of remainder, one of count, and two to three bits of run length
