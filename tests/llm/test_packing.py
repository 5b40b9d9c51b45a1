import struct
import zlib

import pytest

from tuneframe.llm import packing


def check(pieces, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocabulary())
    want = sorted(struct.pack(f"<{len(ids)}I", *ids) for ids in ([*t.encode(x or "", add_special_tokens=False).ids, 2] for x in docs))
    by, sequences = {}, {}
    for r in pieces:
        assert r["length"] == len(r["ids"]) // 4
        by.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(x["length"] for x in own[:i]) for i in range(len(own))]
        total = sum(r["length"] for r in own)
        assert total <= 4096 and (total & (total - 1) == 0)
    return want, by


def test_round_trip(rows):
    texts = [f"Document {i} says: 'it's {i * 7919} words, don't you think?' Été ÉTÉ naïve… <|endoftext|> " * (1 + i * i % 90) for i in range(60)]
    texts += [None, "", "a" * 3000, "İstanbul ΣΑΣ ﬁne e\u0301 \u00a0 x"]
    df = rows("doc_id long, text string", list(enumerate(texts)))
    pieces = packing.pack(df).collect()
    want, by = check(pieces, texts)
    got = sorted(b"".join(r["ids"] for r in sorted(own, key=lambda r: r["start"])) for own in by.values())
    assert got == want


def test_neighbours_come_by_score():
    import numpy as np

    stats = packing.Statistics(np.ones(1 << packing.TERM_BITS, np.float32), 10.0)
    shard = packing.Shard([np.array(x) for x in ([1, 2, 3], [7, 8, 9], [1, 2, 9], [1, 1, 5])], stats)
    scores = shard.scores(0)
    tf = lambda n, size: n * 2.2 / (n + 1.2 * (0.25 + 0.75 * size / 10))
    assert scores == pytest.approx([3 * tf(1, 3), 0, 2 * tf(1, 3), tf(2, 3)])
    assert np.argsort(-scores, kind="stable").tolist()[1] == 2


def test_odd_rows(odd, empty, clashing):
    pieces = packing.pack(odd).collect()
    check(pieces, [])
    assert sum(r["length"] for r in pieces if r["doc_id"] in (1, 2, 7)) == 3  # the end id alone
    assert sum(r["length"] for r in pieces if r["doc_id"] == 5) == 14  # repeated rows are packed twice
    assert packing.pack(empty).count() == 0
    kept = packing.pack(clashing, keep=["doc_id", "source", "start"])
    assert kept.columns.count("start") == 1 and kept.where("source = 's'").count() == kept.count()


def test_cache_is_emptied(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 5)
    tokens = packing.WordTokens(packing.default_vocabulary())
    one = tokens.ids(b"alpha beta gamma, delta epsilon! zeta")[0]
    assert tokens.ids(b"eta theta")[0].tolist() and tokens.ids(b"alpha beta gamma, delta epsilon! zeta")[0].tolist() == one.tolist()


def test_terms_of_cached_words():
    import numpy as np

    tokens = packing.WordTokens(packing.default_vocabulary())
    text = ("Été, naïve <|x ALL Caps. " + "y" * 100 + " end!").encode()
    assert tokens.ids(text)[1].tolist() == packing.terms_of([np.frombuffer(text, np.uint8)])[0].tolist()
    plain = text.replace(b"<|", b"<")
    assert tokens.ids(plain)[1].tolist() == packing.terms_of([np.frombuffer(plain, np.uint8)])[0].tolist()


ALPHABET = ["a", "B", "İ", "ı", "ß", "ẞ", "É", "e\u0301", "E\u0301", "Y\u030a", "\u0345", "Σ", "ς", "ﬁ", "Å", "\u212b", "K", "\u00a0", "\u2028", "9", "٣", "½", "'", "'s", "'LL", "!", "…", "<", "|",
            "<|endoftext|>", "<|ENDOFTEXT|>", "\x00", "\x1c", "\x1f", "\x7f", "\x85", "\u200b", "\u0338", "=", "日", "本", "👍", " ", "\t", "\n", "\r\n", "\x0b", "\x0c", "zz", "The"]


def test_ids_are_those_of_the_tokenizer():
    """Random strings of what normalisation, case and pre-tokens could trip over."""
    import random

    tokens = packing.WordTokens(packing.default_vocabulary())
    rng = random.Random(7)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randrange(1, 9))) for _ in range(60_000)]
    want = tokens.tokenizer.encode_batch(texts, add_special_tokens=False)
    for text, encoding in zip(texts, want):
        assert tokens.ids(text.encode())[0].tolist() == encoding.ids, text.encode()


def plain_packing(lists, terms, stats):
    """One shard in plain Python: BM25 by dictionaries, a greedy fill by falling score."""
    import math

    def score(seed, other):
        total = 0.0
        for t in set(terms[seed]):
            tf = terms[other].count(t)
            if tf:
                total += stats.idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(terms[other]) / stats.mean))
        return total

    free, windows, window, room, seed = list(range(len(lists))), [], [], packing.WINDOW, None

    def put(i):
        nonlocal room, window
        left = len(lists[i])
        while left:
            part = min(left, room)
            window.append((i, part))
            room, left = room - part, left - part
            if not room:
                windows.append(window)
                window, room = [], packing.WINDOW

    while free:
        i = free[0] if seed is None else min(free, key=lambda j: (-round(score(seed, j), 3), j))
        free.remove(i)
        before = len(windows)
        put(i)
        if seed is None or len(windows) != before:
            seed = i if window else None
    assert math.isclose(sum(n for w in windows for _, n in w) + sum(n for _, n in window), sum(map(len, lists)))
    return windows


def test_whole_packing_against_a_plain_one():
    import random

    import numpy as np

    rng = random.Random(5)
    stats = packing.Statistics(np.array([1 + (i * 37 % 101) / 7 for i in range(1 << packing.TERM_BITS)], np.float32), 300.0)
    terms = [[rng.choice([rng.randrange(60), rng.randrange(4000)]) for _ in range(rng.randrange(1, 900))] for _ in range(70)]
    lists = [np.arange(len(t) * 2, dtype=np.uint32) for t in terms]
    packer = packing._Packer(stats, 0)
    for i, (ids, own) in enumerate(zip(lists, terms)):
        packer.add((0, i, len(ids)), ids, np.array(own))
    packer.pack()
    got = {}
    for doc, _, ids, sequence, _ in packer.take():
        got.setdefault(sequence, []).append((doc[1], len(ids)))
    assert [got[s] for s in sorted(got)] == plain_packing(lists, terms, stats)


def test_latin_words_are_encoded_by_their_pre_tokens_once(monkeypatch):
    """No word of Western European text costs a call of the whole tokenizer; words that normalisation may change still do."""
    import pyarrow as pa

    texts = ["Été naïve, garçon d'ÉTÉ 42ßä!'s", None, "", " \t", "Straße DON'T où?? l'Âme'll 'S 'ré", "éÿÞ'll'd" * 3, "naïve garçon " * 900]
    tokens = packing.WordTokens(packing.default_vocabulary())
    want = [tokens.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    whole = []

    class Whole:
        def encode(self, word, **kind):
            whole.append(word)
            return real.encode(word, **kind)

    real, tokens.tokenizer = tokens.tokenizer, Whole()
    assert [tokens.ids((t or "").encode())[0].tolist() for t in texts] == want and not whole
    monkeypatch.setattr(packing, "GROUP_BYTES", 40)
    monkeypatch.setattr(packing, "CALL_PIECES", 3)
    assert [ids.tolist() for ids, _ in tokens.groups(pa.array(texts))] == want and not whole
    odd = "a×b e\u0301 İ Ω <|endoftext|> x÷"
    assert tokens.ids(odd.encode())[0].tolist() == real.encode(odd, add_special_tokens=False).ids
    assert sorted(whole) == sorted(odd.split())
