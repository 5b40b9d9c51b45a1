import hashlib
import random

import numpy as np
import pytest

from tuneframe.llm import bwt, repeats
from tuneframe.llm.text import span_hashes


def plain(docs, length=50):
    first, out = {}, {}
    for d, x in sorted(docs, key=lambda p: (p[0] is None, p[0])):
        for i in range(len(x) - length + 1):
            first.setdefault(x[i : i + length], d)
    for d, x in docs:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            f = first[x[i : i + length]]
            if f is not None and (d is None or f < d):
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(x, gone) if not g)
        out[d] = (len(x), sum(gone), sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])), hashlib.sha256(kept).hexdigest())
    return out


def test_against_a_table_of_all_strings(rows):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 8)))
    passages = [" ".join(word() for _ in range(25)) for _ in range(4)]
    texts = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randrange(40)))]
        parts += rng.sample(passages, rng.randrange(3)) + ["-" * rng.choice([0, 49, 50, 120])]
        rng.shuffle(parts)
        texts.append(" ".join(parts))
    texts[30] = texts[3]
    data = [*enumerate(texts), (100, None), (101, ""), (102, texts[3][:49]), (103, texts[3][:50]), (None, texts[3])]
    want = plain([(d, (t or "").encode()) for d, t in data])
    df = rows("doc_id long, text string, part string", [(d, t, "z") for d, t in data]).repartition(4)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.remove_repeats(df).collect()}
    assert got == want


def test_a_hot_anchor_is_dealt_by_content(rows, monkeypatch):
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    as_bytes = lambda t: np.frombuffer(t.encode(), np.uint8)
    # 24 bytes whose hash is below those of the other text at both sides, so that they are the anchor.
    piece = min((letters(24) for _ in range(4000)), key=lambda t: span_hashes(as_bytes(t), np.array([0]), np.array([24]))[0])
    ends = [letters(20) for _ in range(9)]
    data = [(i, letters(40) + rng.choice(ends) + piece + rng.choice(ends) + letters(rng.choice([3, 40]))) for i in range(400)]
    data += [(None, data[7][1]), (400, data[9][1])]
    want = plain([(d, t.encode()) for d, t in data])

    def bounded(text, *rest):
        assert len(text) <= 1 << 14  # all regions around the piece are 30,000 bytes
        return bwt.repeated_intervals(text, *rest)

    monkeypatch.setattr(repeats, "repeated_intervals", bounded)
    monkeypatch.setattr(repeats, "MERGE_BYTES", 1 << 12)
    df = rows("doc_id long, text string", data).repartition(4)
    for hot in (100, 1):
        monkeypatch.setattr(repeats, "HOT", hot)
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.remove_repeats(df).collect()}
        assert got == want
    monkeypatch.setattr(repeats, "HOT", 1 << 40)
    with pytest.raises(Exception, match="AssertionError"):
        repeats.remove_repeats(df).collect()


def test_odd_rows(odd, empty):
    got = repeats.remove_repeats(odd).collect()
    assert len(got) == 10 and {r["doc_id"]: len(r["kept"]) for r in got}[4] == 0
    assert {r["n_removed"] for r in got if r["doc_id"] == 5} == {0}  # equal ids do not strike each other
    assert repeats.remove_repeats(empty).count() == 0


def test_merged_transforms_sort_all_suffixes():
    rng = random.Random(3)
    for _ in range(60):
        strings = ["".join(rng.choice("ab\n") for _ in range(rng.randrange(30))) for _ in range(rng.randrange(1, 9))]
        flat = np.frombuffer("".join(strings).encode(), np.uint8)
        depth = rng.choice([2, 8])
        blocks = bwt.repeated_intervals(flat, np.cumsum([len(s) for s in strings]), depth, rng.choice([10, 40, 1000]))
        named, i = {}, 0
        for s in strings:
            for j in range(len(s)):
                if j + depth > len(s):
                    assert blocks[i] == -1
                else:
                    assert named.setdefault(s[j : j + depth], blocks[i]) == blocks[i]
                i += 1
        assert len(set(named.values())) == len(named)


def test_common_prefixes():
    strings = [b"banana", b"bandana", b"ban"]
    closed = [np.array([*(x + 1 for x in s), 0], np.uint8) for s in strings]
    arrays, transforms = zip(*(bwt.shard_bwt(c, np.array([len(c)])) for c in closed))
    for steps in (1, 2):
        row, _, common = bwt.merge(list(transforms), 6, steps)
        places = [(i, a) for i, array in enumerate(arrays) for a in array.tolist()]
        suffixes = [strings[i][a:] for i, a in (places[r] for r in row.tolist())]
        assert suffixes == sorted(suffixes)
        for a, b, n in zip(suffixes, suffixes[1:], common[1:].tolist()):
            shared = next((i for i in range(7) if i >= min(len(a), len(b)) or a[i] != b[i]), 6)
            assert n == shared // steps * steps


def test_each_window_has_one_anchor():
    rng = np.random.default_rng(1)
    for i in range(400):
        length, gram = [(50, 24), (12, 4), (6, 5)][i % 3]
        n = int(rng.integers(0, 160))
        data = rng.integers(97, 97 + rng.integers(1, 4), n).astype(np.uint8)
        at, h = repeats.anchors(data, length, gram)
        first, number = repeats.owned(at, h, n, length, gram)
        starts = np.arange(n - gram + 1)
        hashes = span_hashes(data, starts, starts + gram) if n >= gram else starts
        want = [s + int(np.argmin(hashes[s : s + length - gram + 1])) for s in range(n - length + 1)]
        assert np.repeat(at, number).tolist() == want
        assert [s for a, k in zip(first.tolist(), number.tolist()) for s in range(a, a + k)] == list(range(len(want)))


def test_texts_stay_and_lone_regions_are_not_merged(rows, monkeypatch):
    """Copies of whole texts in two chunks: every anchor has one region, so there is nothing to merge."""
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randrange(40, 400))) for _ in range(20)]
    data = list(enumerate(texts * 3))
    monkeypatch.setattr(repeats, "repeated_intervals", lambda *_: pytest.fail("merged"))
    out = repeats.remove_repeats(rows("doc_id long, text string", data).repartition(4))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and not [line for line in plan.splitlines() if "Exchange" in line and "texts" in line]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out.collect()}
    assert got == plain([(d, t.encode()) for d, t in data])


def test_only_regions_that_may_share_a_window_are_merged(rows, monkeypatch):
    """Forty equal bytes among different ones: the texts share anchors, but no window."""
    rng = random.Random(12)
    some = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage = some(40)
    data = [(d, some(100) + passage + some(100)) for d in range(12)]
    monkeypatch.setattr(repeats, "repeated_intervals", lambda *_: pytest.fail("merged"))
    got = {r["doc_id"]: r["n_removed"] for r in repeats.remove_repeats(rows("doc_id long, text string", data).repartition(3)).collect()}
    assert got == dict.fromkeys(range(12), 0)


def test_regions_are_merged_from_where_they_may_agree(rows):
    """Passages of all lengths about that of a window, in different surroundings and twice in some texts."""
    rng = random.Random(13)
    some = lambda n: "".join(rng.choice("ab") for _ in range(n))
    passages = [some(n) for n in range(44, 60)]
    data = [(d, "".join(some(rng.randrange(30)) + rng.choice(passages) for _ in range(rng.randrange(5)))) for d in range(60)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.remove_repeats(rows("doc_id long, text string", data).repartition(3)).collect()}
    assert got == plain([(d, t.encode()) for d, t in data])


def test_anchors_of_texts_laid_end_to_end():
    rng = np.random.default_rng(2)
    for length, gram in [(50, 24), (12, 4), (6, 5)] * 40:
        texts = [rng.integers(97, 99, int(n)).astype(np.uint8) for n in rng.integers(0, 120, 9)]
        ends = np.cumsum([len(t) for t in texts])
        at, h = repeats.anchors(np.concatenate(texts), length, gram, ends)
        base, end = (x[np.searchsorted(ends, at, "right")] for x in (ends - [len(t) for t in texts], ends))
        got = np.stack((at, *repeats.owned(at, h, end, length, gram, base)))
        alone = []
        for t, e in zip(texts, ends.tolist()):
            place, own = repeats.anchors(t, length, gram)
            first, n = repeats.owned(place, own, len(t), length, gram)
            alone.append(np.stack((place + e - len(t), first + e - len(t), n)))
        assert np.array_equal(got, np.concatenate(alone, axis=1))


def _drawn(seed):
    rng = random.Random(seed)
    some = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passages = [some(n) for n in range(45, 75)]
    return [(d, "".join(some(rng.randrange(60)) + rng.choice(passages) for _ in range(rng.randrange(6)))) for d in range(600)]


def test_rows_between_chunks_and_partitions_do_not_grow_with_their_product(rows, monkeypatch):
    """Texts of hundreds of the smallest chunks and thousands of partitions."""
    data = _drawn(21)
    pieces = []
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 1 << 8)
    monkeypatch.setattr(repeats, "PART_BYTES", 1 << 6)
    monkeypatch.setattr(repeats, "CHUNKS", 8, raising=False)
    monkeypatch.setattr(repeats, "BINS", 16, raising=False)
    wrote = repeats.written
    monkeypatch.setattr(repeats, "written", lambda df, name: pieces.append(wrote(df, name)) or pieces[-1])
    out = repeats.remove_repeats(rows("doc_id long, text string", data).repartition(2))
    assert 30 < pieces[0].count() <= 10 * 18 * 2  # of regions and of dealt windows
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out.collect()}
    assert got == plain([(d, t.encode()) for d, t in data])


@pytest.mark.parametrize("hot", [1 << 12, 3])
def test_bins_of_several_partitions(rows, monkeypatch, hot):
    data = [*_drawn(22), (None, "x" * 200), (600, "x" * 70), (601, None), (602, "")]
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 1 << 12)
    monkeypatch.setattr(repeats, "PART_BYTES", 1 << 9)
    monkeypatch.setattr(repeats, "BINS", 5)
    monkeypatch.setattr(repeats, "HOT", hot)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.remove_repeats(rows("doc_id long, text string", data).repartition(3)).collect()}
    assert got == plain([(d, (t or "").encode()) for d, t in data])


def test_chunks_go_on_over_arrow_batches(spark, rows, monkeypatch):
    data = _drawn(23)
    pieces = []
    wrote = repeats.written
    monkeypatch.setattr(repeats, "written", lambda df, name: pieces.append(wrote(df, name)) or pieces[-1])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = repeats.remove_repeats(rows("doc_id long, text string", data).repartition(2))
        assert pieces[0].select("chunk").distinct().count() == 2
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == plain([(d, t.encode()) for d, t in data])
