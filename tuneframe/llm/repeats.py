"""Remove byte strings that a document with a smaller id holds too, found by merging Burrows-Wheeler transforms.

A string of ``length`` bytes is repeated when it also starts in a document with a smaller id; all bytes that
such strings cover go. Matches never cross documents, and strings are judged on the input.

Transforms are only needed where texts can repeat. Every window of ``length`` bytes chooses its smallest
``GRAM``-byte hash as anchor, so equal windows have equal anchors:

1. Anchors are counted by hash, a short name each, summed per chunk of documents. One that a single document
   holds is done with.
2. Around the others the chunk cuts regions, the bytes of the windows that choose that anchor, the first of equal ones, so each
   window is in one region. Equal regions of a chunk are one, with the smallest id that holds it, and go to the partition of the anchor.
3. A partition cuts its regions into shards, transforms each and merges the transforms by iterative
   interleave refinement. Blocks that are left after ``length`` symbols are the repeated intervals: the
   windows there are equal, their common prefix is ``length`` or more. Each learns its smallest id. Of a region only
   the stretch goes into the merge whose windows agree with another region of the anchor in most of their bytes, by hash; a
   region alone with its anchor has none.
4. The answers return to the chunks, which strike out what a smaller id holds.

Texts are written once, in a table bucketed by chunk, and stay there: anchors, regions and answers come to them.

A hot passage is one region per chunk, not one per document. Chunks and shards are bounded in bytes;
a partition with more regions merges them by parts, equal anchors together. What a chunk and the partitions tell each other
goes in one row for each bin of partitions. The rows are as many as chunks times bins, so from ``CHUNKS`` chunks and ``BINS`` bins on these hold
more instead of becoming more, up to ``ROW_BYTES`` of text. An anchor that stands at ``HOT``
places or more, whose regions may all differ, is dealt by content instead: each window around it goes by the hash
of all its bytes to a partition of windows, where only equal windows share a group, one row a chunk.

* Null text is empty. A null id counts as larger than all others. Rows with the same id do not strike each other.
* Texts shorter than ``length`` keep all bytes. Empty tables give no rows. Other columns are not looked at.
* Anchors, regions and dealt windows are told apart by hashes (the latter two by 64 bits); a clash of anchors costs work only.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneframe.llm.bwt import repeated_intervals
from tuneframe.llm.registry import query, table
from tuneframe.llm.text import U64, byte_rows, mix, run_hashes, span_hashes, spread, stretches
from tuneframe.session import give_back, run_folder, swept, written

LENGTH = 50
GRAM = 24
CHUNK_DOCS = 1 << 17
CHUNK_BYTES = 4 << 20
PART_BYTES = 4 << 20
CHUNKS = 128
BINS = 256
ROW_BYTES = 16 << 20
HELD_BYTES = 200 << 20
MERGE_BYTES = 1 << 19
ANCHOR_BYTES = 1 << 16
BLOCK_BYTES = 1 << 20
HOT = 1 << 12
LEVEL = 3
BUCKET_BYTES = 16 << 20
LAST = np.iinfo(np.int64).max


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """Minimum or maximum of every window, by doubling."""
    size, out = 1, values
    while 2 * size <= width:
        out = best(out[: len(out) - size], out[size:])
        size *= 2
    extra = width - size
    return best(out[: len(out) - extra], out[extra:]) if extra else out


def anchors(data: np.ndarray, length: int, gram: int, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the anchors of all windows of a text, or of texts laid end to end that end at ``ends``; all ties count."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    h = run_hashes(data, gram)
    width = length - gram + 1
    low = _sliding(h, width, np.minimum)
    for i in range(1, length):  # no window crosses from text to text
        over = np.zeros(0, np.int64) if ends is None else ends[:-1] - i
        low[over[(over >= 0) & (over < len(low))]] = 0
    # A position is an anchor when it is the smallest of some window around it.
    padded = np.concatenate((np.zeros(width - 1, U64), low, np.zeros(width - 1, U64)))
    at = np.flatnonzero(_sliding(padded, width, np.maximum) == h)
    return at, h[at]


def owned(position: np.ndarray, h: np.ndarray, end: np.ndarray | int, length: int, gram: int, base: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows that choose each of the anchors: those whose smallest hash it is, at its first place. The text of an
    anchor lies from ``base`` to ``end``, which are numbers for one text."""
    if not len(position):
        return position, position
    base, end = np.broadcast_to(base, len(position)), np.broadcast_to(end, len(position))
    first = np.where(np.append(True, h[1:] >= h[:-1]), np.append(-1, position[:-1]) + 1, position - (length - gram))
    other = np.append(True, base[1:] != base[:-1])
    first[other] = base[other]
    last = end - length + 1
    first = np.minimum.accumulate(np.minimum(first, last)[::-1])[::-1]
    return first, np.where(np.append(other[1:], True), last, np.append(first[1:], 0)) - first


def _more(n: np.ndarray) -> np.ndarray:
    """The places that hold more than one, and how many."""
    at = np.flatnonzero(n > 1)
    return np.stack((at, np.minimum(n[at], LAST >> 32))).astype(np.uint32)


def _pack(x: np.ndarray) -> bytes:
    return np.int64(x.nbytes).tobytes() + pa.Codec("zstd", compression_level=LEVEL).compress(x.tobytes(), asbytes=True)


def _unpack(blob: bytes, kind) -> np.ndarray:
    size = int(np.frombuffer(blob[:8], np.int64)[0])
    return np.frombuffer(pa.decompress(blob[8:], size, "zstd", asbytes=True) if size else b"", kind)


def _runs_of(x: np.ndarray) -> np.ndarray:
    """The values of a sequence without those that repeat the one before, and how often each stands."""
    at = np.flatnonzero(np.append(True, x[1:] != x[:-1])[: len(x)])
    return np.stack((x[at], np.diff(at, append=len(x))))


def _layout(total: int) -> tuple[int, int, int]:
    """Bytes of a chunk, number of partitions and partitions of a bin, for so many bytes of text."""
    parts = total // PART_BYTES + 1
    return max(CHUNK_BYTES, min(total // CHUNKS, ROW_BYTES)), parts, max(1, min(parts // BINS, ROW_BYTES // PART_BYTES))


def _chunk_rows(batches, most):
    """Groups of rows of ``most`` bytes or a text more, whatever the batches: a name, the ids and the texts."""
    number, size, ids, texts = TaskContext.get().partitionId() << 32, 0, [], []
    for batch in batches:
        for data, own in zip(byte_rows(batch.column(0)), batch.column(1).to_pylist()):
            ids.append(own)
            texts.append(data)
            size += len(data)
            if size >= most or len(texts) == CHUNK_DOCS:
                yield number, ids, texts
                number, size, ids, texts = number + 1, 0, [], []
                give_back(HELD_BYTES)
    if texts:
        yield number, ids, texts
    del texts
    give_back(HELD_BYTES)


def _blocks(ends: np.ndarray, size: int) -> list[tuple[int, int]]:
    """From and to of texts that are ``size`` bytes or a text more together."""
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(size, ends[-1] + size, size), "left") + 1, len(ends)).clip(max=len(ends))).tolist()
    return list(zip([0, *cuts[:-1]], cuts))


def _order_of_parts(part: np.ndarray, parts: int) -> np.ndarray:
    return np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")


def _chunk_anchors(texts, length, gram, parts):
    """Anchors of a chunk: (document, position in the chunk, hash, number of its name), and its names, the distinct hashes, with their partitions, their
    order by partition, whether two documents hold them and at how many places they stand."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    found = []
    for i, j in _blocks(ends, ANCHOR_BYTES):
        base = int(ends[i] - sizes[i])
        at, own = anchors(np.concatenate(texts[i:j]), length, gram, ends[i:j] - base)
        found.append((at + base, own))
    position = np.concatenate([p for p, _ in found])
    h = np.concatenate([x for _, x in found])
    doc = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(position, ends), prepend=0))
    order = np.argsort(h)
    sorted_h = h[order]
    new = np.ones(len(h), bool)
    new[1:] = sorted_h[1:] != sorted_h[:-1]
    first = np.flatnonzero(new)
    name = np.empty(len(h), np.int64)
    name[order] = np.cumsum(new) - 1
    sorted_doc = doc[order]
    several = np.minimum.reduceat(sorted_doc, first) != np.maximum.reduceat(sorted_doc, first) if len(h) else np.zeros(0, bool)
    names = sorted_h[first]
    part = (names % U64(parts)).astype(np.int64)
    return doc, position, h, name, names, part, _order_of_parts(part, parts), several, np.diff(first, append=len(h))


def _dealt(keys, part, parts, per):
    """The order of things by partition and key, the first of each distinct key in it, and of each bin its number, which of the distinct keys and which
    of the things are in it, and the number of distinct keys by partition."""
    order = np.argsort(keys)
    order = order[_order_of_parts(part[order], parts)]
    one = np.flatnonzero(np.append(True, np.diff(keys[order]) != 0)[: len(keys)])
    own = part[order[one]]
    cuts = np.flatnonzero(np.append(True, np.diff(own // per) != 0)[: len(own)])
    till = np.append(one, len(keys))
    bins = []
    for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(own)]):
        number = int(own[i]) // per
        bins.append((number, slice(i, j), slice(int(till[i]), int(till[j])), np.bincount(own[i:j] - number * per, minlength=per).astype(np.int32)))
    return order, one, bins


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary: the bytes that stay) and kept_sha256 per document."""
    docs = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunk_bytes, parts, per = _layout(int(total))
    bins = -(-parts // per)

    def name(batches):
        for chunk, _, texts in _chunk_rows(batches, chunk_bytes):
            *_, names, part, by_part, several, places = _chunk_anchors(texts, length, gram, parts)
            short = (mix(names[by_part]) >> U64(32)).astype(np.uint32)
            flags, places = several[by_part], places[by_part]
            own, at = np.unique(part[by_part] // per, return_index=True)
            cuts = [slice(a, b) for a, b in zip(at.tolist(), [*at[1:].tolist(), len(part)])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.int64()), pa.array([chunk] * len(own), pa.int64()),
                 pa.array([short[c].tobytes() for c in cuts], pa.binary()),
                 pa.array([np.packbits(flags[c]).tobytes() for c in cuts], pa.binary()),
                 pa.array([_more(places[c]).tobytes() for c in cuts], pa.binary())], ["part", "chunk", "names", "several", "more"])

    def repeated(key, own):
        give_back(HELD_BYTES)  # what the group before has left
        chunk = own.column("chunk").to_pylist()
        names = [np.frombuffer(x, np.uint32) for x in own.column("names").to_pylist()]
        sizes = [len(x) for x in names]
        several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(own.column("several").to_pylist(), sizes)])
        _, at, n = np.unique(np.concatenate(names), return_inverse=True, return_counts=True)
        good = (n > 1) | (np.bincount(at, several) > 0)
        places = np.ones(len(at), np.int64)
        for base, x in zip((np.cumsum(sizes) - sizes).tolist(), own.column("more").to_pylist()):
            place, more = np.frombuffer(x, np.uint32).reshape(2, -1).astype(np.int64)
            places[base + place] = more
        hot = good & (np.bincount(at, places) >= HOT)
        split = [[np.packbits(b).tobytes() if b.any() else b"" for b in np.split(x[at], np.cumsum(sizes)[:-1])] for x in (good, hot)]
        return pa.table([pa.array([key[0].as_py()] * len(chunk), pa.int64()), pa.array(chunk, pa.int64()), *(pa.array(x, pa.binary()) for x in split)], ["part", "chunk", "bits", "hot"])

    named = docs.mapInArrow(name, "part long, chunk long, names binary, several binary, more binary")
    answers = named.groupBy("part").applyInArrow(repeated, "part long, chunk long, bits binary, hot binary")

    def bundle(batches):
        for chunk, own, texts in _chunk_rows(batches, chunk_bytes):
            sizes = np.array([len(t) for t in texts], np.int64)
            ids = np.array([LAST if x is None else x for x in own], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([_pack(ids)]), pa.array([_pack(sizes)]), pa.array([_pack(np.concatenate(texts))])], ["chunk", "ids", "sizes", "texts"])

    spark = docs.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total // BUCKET_BYTES) + 1)
    held = f"repeat_chunks_{uuid.uuid4().hex}"
    rows = docs.mapInArrow(bundle, "chunk long, ids binary, sizes binary, texts binary")
    rows.write.format("parquet").bucketBy(buckets, "chunk").option("path", run_folder(spark, "repeat-chunks")).saveAsTable(held)
    bundles = spark.table(held)

    # A chunk's regions by bin, from ``bins`` on its dealt windows; n: how many of them are in each of the bin's partitions
    cut_rows = "chunk long, part long, a binary, b binary, c binary, e binary, n binary"
    names_ = [f.split()[0] for f in cut_rows.split(", ")]
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 5]

    def cut(key, own, told):
        give_back(HELD_BYTES)
        chunk = key[0].as_py()
        ids, sizes, flat = _unpack(own.column("ids")[0].as_py(), np.int64), _unpack(own.column("sizes")[0].as_py(), np.int64), _unpack(own.column("texts")[0].as_py(), np.uint8)
        base = np.cumsum(sizes) - sizes
        texts = [flat[b : b + n] for b, n in zip(base.tolist(), sizes.tolist())]
        doc, position, h, name, names, part, by_part, *_ = _chunk_anchors(texts, length, gram, parts)
        _, several = np.unique(part[by_part] // per, return_counts=True)
        told = [told.column(c).take(np.argsort(told.column("part").to_numpy())).to_pylist() for c in ("bits", "hot")]
        good, hot = np.zeros(len(names), bool), np.zeros(len(names), bool)
        for flags, bits in zip((good, hot), told):
            flags[by_part] = np.concatenate([np.zeros(0, np.uint8), *(np.unpackbits(np.frombuffer(b, np.uint8), count=n) if b else np.zeros(n, np.uint8) for b, n in zip(bits, several.tolist(), strict=True))]).astype(bool)
        low, n = owned(position, h, (base + sizes)[doc], length, gram, base[doc])
        keep = good[name] & (n > 0)
        doc, position, h, hot, first, n = doc[keep], position[keep], h[keep], hot[name[keep]], low[keep], n[keep]
        rows = []
        # All windows around hot anchors.
        start, owner = spread(first[hot], n[hot]), np.repeat(doc[hot], n[hot])
        windows = mix(_region_hashes(flat, start, start + length))
        order, one, dealt = _dealt(windows, (windows % U64(parts)).astype(np.int64), parts, per)
        windows, start, owner = windows[order[one]], start[order], owner[order]
        back = np.cumsum(np.bincount(one, minlength=len(order))) - 1
        smallest = np.minimum.reduceat(ids[owner], one) if len(one) else one
        for to, i, j, by in dealt:
            rows.append((chunk, bins + to, _pack(windows[i]), _pack(smallest[i]), None,
                         _pack(np.stack((back[j] - i.start, owner[j], start[j] - base[owner[j]])).astype(np.int32)), by.tobytes()))
        doc, position, h, first, size = (x[~hot] for x in (doc, position, h, first, n + length - 1))
        order, one, dealt = _dealt(mix(_region_hashes(flat, first, first + size) + h), (h % U64(parts)).astype(np.int64), parts, per)
        back = np.cumsum(np.bincount(one, minlength=len(order))) - 1
        smallest = np.minimum.reduceat(ids[doc[order]], one) if len(one) else one
        for to, i, j, by in dealt:
            of, at = order[one[i]], order[j]
            rows.append((chunk, to, _pack(stretches(flat, first[of], size[of])), _pack(np.stack((size[of], smallest[i]))), _pack((position - first)[of].astype(np.int32)),
                         _pack(np.stack((back[j] - i.start, doc[at], first[at] - base[doc[at]])).astype(np.int32)), by.tobytes()))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names_)

    pieces = written(bundles.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(cut, cut_rows), "repeat-regions")
    del named, answers
    for _ in range(2):  # the first has Python's hold on them let go
        swept(spark)

    def least_ids(own):
        """For each dealt window of each chunk its smallest id."""
        cuts = [np.cumsum(np.append(0, np.frombuffer(x, np.int32))) for x in own.column("n").to_pylist()]
        windows = [_unpack(x, U64) for x in own.column("a").to_pylist()]
        ids = [_unpack(x, np.int64) for x in own.column("b").to_pylist()]
        answers = [np.empty_like(x) for x in ids]
        for p in range(per):
            of = [slice(c[p], c[p + 1]) for c in cuts]
            _, back = np.unique(np.concatenate([x[i] for x, i in zip(windows, of)]), return_inverse=True)
            least = np.full(int(back.max(initial=-1)) + 1, LAST)
            np.minimum.at(least, back, np.concatenate([x[i] for x, i in zip(ids, of)]))
            for x, i, own_back in zip(answers, of, np.split(back, np.cumsum([i.stop - i.start for i in of])[:-1])):
                x[i] = least[own_back]
        return pa.table([own.column("part"), own.column("chunk"), pa.array([_pack(x) for x in answers], pa.binary())], ["part", "chunk", "smallest"])

    def merged(flat, size, ids, place):
        """For regions laid end to end the smallest ids of the windows of the distinct ones; which of these each region is; their first window and their number of windows."""
        ends = np.cumsum(size)
        starts = ends - size
        anchor = starts + place
        groups = _region_hashes(flat, anchor, anchor + gram)
        regions = _region_hashes(flat, starts, ends) ^ mix(groups)
        _, at, back = np.unique(regions, return_index=True, return_inverse=True)
        as_laid = np.argsort(at)
        at, back = at[as_laid], np.argsort(as_laid)[back]
        least = np.full(len(at), LAST)
        np.minimum.at(least, back, ids)
        starts, place, anchor, groups, windows = starts[at], place[at].astype(np.int64), anchor[at], groups[at], size[at] - length + 1
        base = np.cumsum(windows) - windows
        answer = np.repeat(least, windows)
        low, high = _shared(flat, anchor, place, windows, length, gram)
        order = np.flatnonzero(low < high)  # a region that shares none of its windows is done
        order = order[np.argsort(groups[order], kind="stable")]  # equal anchors stay together in one merge
        g, low, high = groups[order], low[order], high[order]
        width = high - low + length - 1
        begin = 0
        weight = np.cumsum(width)
        while begin < len(order):
            limit = (weight[begin - 1] if begin else 0) + MERGE_BYTES
            end = max(begin + 1, int(np.searchsorted(weight, limit, "right")))
            if end < len(order):  # up to where a group of anchors ends, or starts if that is all
                if g[end] == g[end - 1]:
                    start_of = int(np.searchsorted(g, g[end], "left"))
                    end = start_of if start_of > begin else int(np.searchsorted(g, g[end], "right"))
            i = slice(begin, end)
            part = order[i]
            block = repeated_intervals(stretches(flat, starts[part] + low[i], width[i]), np.cumsum(width[i]), length)
            own_id = np.repeat(least[part], width[i])
            fits = block >= 0
            best = np.full(int(block.max()) + 1 if len(block) else 0, LAST)
            np.minimum.at(best, block[fits], own_id[fits])
            answer[spread(base[part] + low[i], high[i] - low[i])] = best[block[fits]]
            begin = end
        return answer, back, base, windows

    def smallest_ids(key, own):
        """For each region of each chunk the smallest ids of its windows, one after the other, as runs of equal ones."""
        give_back(HELD_BYTES)
        if key[0].as_py() >= bins:
            return least_ids(own)
        texts = [_unpack(x, np.uint8) for x in own.column("a").to_pylist()]
        facts = [_unpack(x, np.int64).reshape(2, -1) for x in own.column("b").to_pylist()]
        place = [_unpack(x, np.int32) for x in own.column("c").to_pylist()]
        cuts = [np.cumsum(np.append(0, np.frombuffer(x, np.int32))) for x in own.column("n").to_pylist()]
        at = [np.append(0, np.cumsum(f[0]))[c] for f, c in zip(facts, cuts)]
        answers = [[] for _ in texts]
        for p in range(per):
            of = [slice(c[p], c[p + 1]) for c in cuts]
            size, ids = np.concatenate([f[:, i] for f, i in zip(facts, of)], axis=1)
            if not len(size):
                continue
            answer, back, base, windows = merged(np.concatenate([x[a[p] : a[p + 1]] for x, a in zip(texts, at)]), size, ids, np.concatenate([x[i] for x, i in zip(place, of)]))
            n = 0
            for i, out in zip(of, answers):
                own_back = back[n : n + i.stop - i.start]
                out.append(_runs_of(stretches(answer, base[own_back], windows[own_back])))
                n += len(own_back)
        return pa.table([own.column("part"), own.column("chunk"), pa.array([_pack(np.concatenate(x, axis=1)) for x in answers], pa.binary())], ["part", "chunk", "smallest"])

    told = pieces.select("part", "chunk", "a", "b", "c", "n").groupBy("part").applyInArrow(smallest_ids, "part long, chunk long, smallest binary")
    blank = F.lit(None).cast("binary")
    places = pieces.select("chunk", "part", "b", "e", blank.alias("smallest"))
    answered = told.select("chunk", "part", blank.alias("b"), blank.alias("e"), "smallest")

    def strike(key, own, told):
        give_back(HELD_BYTES)
        rows = told.to_pylist()
        out = []
        smallest = {r["part"]: r["smallest"] for r in rows if r["smallest"] is not None}
        ids, sizes, flat = _unpack(own.column("ids")[0].as_py(), np.int64), _unpack(own.column("sizes")[0].as_py(), np.int64), _unpack(own.column("texts")[0].as_py(), np.uint8)
        ends = np.cumsum(sizes)
        base = ends - sizes
        starts = np.zeros(len(flat), bool)  # of windows that go
        for r in rows:
            if r["smallest"] is not None:
                continue
            back, doc, low = _unpack(r["e"], np.int32).reshape(3, -1).astype(np.int64)
            if r["part"] >= bins:
                gone = _unpack(smallest[r["part"]], np.int64)[back] < ids[doc]
                starts[(base[doc] + low)[gone]] = True
                continue
            windows = _unpack(r["b"], np.int64).reshape(2, -1)[0] - length + 1
            least = np.repeat(*_unpack(smallest[r["part"]], np.int64).reshape(2, -1))
            n = windows[back]
            gone = stretches(least, (np.cumsum(windows) - windows)[back], n) < np.repeat(ids[doc], n)
            starts[spread(base[doc] + low, n)[gone]] = True
        for first, last in _blocks(ends, BLOCK_BYTES):
            at = int(base[first])
            removed = np.cumsum(starts[at : ends[last - 1]], dtype=np.int32)
            removed[length:] -= removed[:-length].copy()
            removed = removed > 0
            for i in range(first, last):
                gone, text = removed[base[i] - at : ends[i] - at], flat[base[i] : ends[i]]
                n = int(np.count_nonzero(gone))
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0]) if n else 0
                kept = (text[~gone] if n else text).tobytes()
                out.append((int(ids[i]), len(text), n, spans, hashlib.sha256(kept).hexdigest(), kept))
        columns = list(zip(*out)) or [[]] * 6
        columns[0] = [None if x == LAST else x for x in columns[0]]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(columns, types)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    struck = bundles.groupBy("chunk").cogroup(places.unionByName(answered).groupBy("chunk"))
    return struck.applyInArrow(strike, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def _shared(flat, anchor, place, windows, length, gram):
    """Of each of some distinct regions, its windows from a first to before a last that all windows lie between which another region may hold.

    A window has its anchor and ``length - gram`` bytes more, so many before the anchor and the others behind it. Those with ``few`` to ``many``
    before it all have the ``few`` bytes before it and what is behind it of the window with ``many``: where no other region has the
    same there, none has such a window.
    """
    spare = length - gram
    low, high = windows.copy(), np.zeros_like(windows)
    cuts = np.unique(np.linspace(0, spare + 1, 5).astype(np.int64))
    for few, many in zip(cuts[:-1].tolist(), (cuts[1:] - 1).tolist()):
        first, last = np.maximum(place - many, 0), np.minimum(place - few + 1, windows)
        at = np.flatnonzero(first < last)
        same = _region_hashes(flat, anchor[at] - few, anchor[at] + gram + spare - many)
        _, back, n = np.unique(same, return_inverse=True, return_counts=True)
        at = at[n[back] > 1]
        low[at], high[at] = np.minimum(low[at], first[at]), np.maximum(high[at], last[at])
    return low, high


def _region_hashes(flat: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of spans given by rising starts; they may overlap."""
    out = np.empty(len(first), U64)
    for i in range(0, len(first), 1 << 14):
        a, b = first[i : i + (1 << 14)], last[i : i + (1 << 14)]
        for j in _runs(a, b):
            out[i + j.start : i + j.stop] = span_hashes(flat, a[j], b[j])
    return out


def _runs(first: np.ndarray, last: np.ndarray):
    """Slices whose ends rise as well."""
    cuts = np.flatnonzero(np.diff(last) < 0) + 1
    bounds = [0, *cuts.tolist(), len(first)]
    return [slice(a, b) for a, b in zip(bounds[:-1], bounds[1:]) if a < b]


@query("op7_repeats")
def op7(spark, folder):
    return remove_repeats(table(spark, folder, "documents")).drop("kept")
