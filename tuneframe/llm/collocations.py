"""Phrase collocation mining with counting quotient filters.

Texts become chunks of local word numbers. A chunk's words go, each with its count, to the shards of their hashes, a row a shard; a shard adds up
what all chunks sent, numbers the words that are frequent in their language and answers each chunk with the numbers of its words, so no
dictionary is ever sent to all tasks. A chunk's pairs of frequent words are packed, permuted and counted in a quotient filter (:mod:`.quotient`), which is cut by
leading bits of the quotient; all cuts of a shard are merged. A shard answers each chunk which of its pairs are frequent, and only
runs in which every pair is frequent are counted as longer phrases, by a second round of filters. Every count of
a frequent phrase is exact: a phrase is at most as frequent as its parts.

A word or phrase is one entry a chunk, however often it occurs; shards are as many as the words ask for, and hold the entries
evenly.

* Null text is empty; a null language is ``und``. Texts without words give nothing, an empty table no rows. Very long texts
  are split in blocks and may fill a chunk alone. Repeated rows count each time.
* Equal cuts: the first. Equal ranks are resolved by score, count, then the phrase's bytes, which differ.
* Extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tuneframe.llm.quotient import Codec, Filter
from tuneframe.llm.registry import query, table
from tuneframe.session import run_folder, scratch, written

LEAST = 100
LONGEST = 5
BEST = 2000
CHUNK_WORDS = 1 << 21
# Text a shard, on average: about a million words. A shard's entries are fewer.
SHARD_BYTES = 6 << 20
BLOCK = 1 << 20
UNKNOWN = "und"

_BREAK = b"\xff"  # in no UTF-8 text
_PLAIN = bytes(0xFF if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256)).lower()
_CUT = re.compile(rb"[ \t\xff]")
CHUNKS = "chunk long, lang string, n long, size long, numbers binary, shards binary, shard long, words binary, times binary"
_CHUNK_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
WORDS = "shard long, chunk long, ids binary, lang string, word binary, f long, number int"
_WORD_KINDS = [pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.binary(), pa.int64(), pa.int32()]


def words(text: bytes | None) -> Iterator[list[bytes]]:
    """Words of a text in order, with :data:`_BREAK` between pieces, in blocks of about a million bytes."""
    plain = (text or b"").translate(_PLAIN)
    at = 0
    while at < len(plain):
        cut = _CUT.search(plain, at + BLOCK)
        end = cut.start() if cut else len(plain)
        yield plain[at:end].replace(_BREAK, b" \xff ").split()
        at = end


def _packed(numbers: np.ndarray) -> bytes:
    return pa.Codec("zstd", compression_level=9).compress(numbers.astype(np.int32).tobytes(), asbytes=True)


def _numbers(size: int, data: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 4 * size, codec="zstd", asbytes=True), np.int32)


class _Chunk:
    """Word numbers of one language in the making; 0 stands between pieces."""

    def __init__(self):
        self.vocabulary: dict[bytes, int] = defaultdict(count(1).__next__)
        self.vocabulary[_BREAK] = 0
        self.parts: list[np.ndarray] = []

    def add(self, text: bytes | None) -> int:
        number, size = self.vocabulary.__getitem__, 0
        for block in words(text):
            self.parts.append(np.fromiter(map(number, block), np.int32, len(block)))
            size += len(block)
        self.parts.append(np.zeros(1, np.int32))
        return size + 1

    def rows(self, chunk: int, lang: str, shard_bits: int) -> pa.RecordBatch:
        """The chunk's word numbers, and its words with their counts, cut by shard; words are numbered in that order."""
        numbers = np.concatenate(self.parts)
        # Breaks that follow each other are one.
        numbers = numbers[np.append(True, (numbers[1:] > 0) | (numbers[:-1] > 0))]
        own = [w for w in self.vocabulary if w != _BREAK]
        shard = np.fromiter(map(zlib.crc32, own), np.int64, len(own)) >> (32 - shard_bits)
        order = np.argsort(shard, kind="stable")
        renamed = np.zeros(len(own) + 1, np.int32)
        renamed[order + 1] = np.arange(1, len(own) + 1)
        numbers = renamed[numbers]
        times = np.bincount(numbers, minlength=len(own) + 1)[1:]
        shards, starts = np.unique(shard[order], return_index=True)
        place = np.stack((shards, starts))
        rows = [(chunk, lang, int(times.sum()), len(numbers), _packed(numbers), place.astype("<i8").tobytes(), None, None, None)]
        for name, a, b in zip(shards.tolist(), starts.tolist(), [*starts[1:].tolist(), len(own)]):
            held = times[a:b]
            small = np.minimum(held, 255).astype(np.uint8)
            counts = small.tobytes() + held[small == 255].astype("<i8").tobytes()
            rows.append((chunk, lang, None, None, None, None, name, b"\n".join(own[i] for i in order[a:b].tolist()), counts))
        return _table(rows, CHUNKS, _CHUNK_KINDS).combine_chunks().to_batches()[0]


def chunked(docs: DataFrame) -> tuple[DataFrame, int]:
    """One row of word numbers for each chunk, and one row for each shard of its words; written. And the bits of a shard's name."""
    rows = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shard_bits = min(32, max(3, (size // SHARD_BYTES).bit_length()))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, serial = TaskContext.get().partitionId() << 32, count()
        chunks: dict[str, _Chunk] = defaultdict(_Chunk)
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                size += chunks[lang].add(text.as_py())
                if size >= CHUNK_WORDS:
                    for own, chunk in chunks.items():
                        yield chunk.rows(first + next(serial), own, shard_bits)
                    chunks.clear()
                    size = 0
        for own, chunk in chunks.items():
            yield chunk.rows(first + next(serial), own, shard_bits)

    return written(rows.mapInArrow(split, CHUNKS), "phrase-chunks"), shard_bits


def _frequent(least: int):
    """Words of a shard in all chunks -> those that are frequent in their language, numbered, and for each chunk the numbers of its words, 0 for the others."""

    def run(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        held = []
        totals: dict[str, dict[bytes, int]] = defaultdict(lambda: defaultdict(int))
        for chunk, lang, text, times in zip(*(part.column(c).to_pylist() for c in ("chunk", "lang", "words", "times"))):
            own = text.split(b"\n")
            counts = np.frombuffer(times, np.uint8, len(own)).astype(np.int64)
            large = counts == 255
            counts[large] = np.frombuffer(times, "<i8", int(large.sum()), len(own))
            total = totals[lang]
            for word, n in zip(own, counts.tolist()):
                total[word] += n
            held.append((chunk, lang, own))
        shard, rows, numbers, serial = key[0].as_py(), [], {}, count(1)
        for lang in sorted(totals):
            numbers[lang] = {word: next(serial) for word in sorted(w for w, n in totals[lang].items() if n >= least)}
            rows += [(shard, None, None, lang, word, totals[lang][word], number) for word, number in numbers[lang].items()]
        for chunk, lang, own in held:
            known = numbers[lang]
            ids = np.fromiter((known.get(word, 0) for word in own), np.int32, len(own))
            if ids.any():
                rows.append((shard, chunk, ids.tobytes(), None, None, None, None))
        return _table(rows, WORDS, _WORD_KINDS)

    return run


PARTS = "chunk long, shard long, part binary, size long, numbers binary"
_PART_KINDS = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]
FOUND = "chunk long, hits binary, phrase array<int>, a long"
_FOUND_KINDS = [pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.int64()]


def _table(rows: list[tuple], schema: str, kinds: list[pa.DataType]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in schema.split(", ")])


def _cuts(own: Filter, chunk: int, shard_bits: int) -> list[tuple]:
    return [(chunk, shard, part.to_bytes(shard_bits), None, None) for shard, part in own.split(shard_bits)]


def _pairs(codec: Codec, shard_bits: int):
    """Chunk and ids of its words -> cuts of its filter of pairs, and the chunk in ids."""

    def run(key, chunk: pa.Table, known: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if chunk.num_rows and known.num_rows:
            numbers = _numbers(chunk.column("size")[0].as_py(), chunk.column("numbers")[0].as_py())
            ids = np.zeros(int(numbers.max()) + 1, np.int32)
            shards, starts = np.frombuffer(chunk.column("shards")[0].as_py(), "<i8").reshape(2, -1)
            place = dict(zip(shards.tolist(), starts.tolist()))
            for shard, data, offset in zip(*(known.column(c).to_pylist() for c in ("shard", "ids", "offset"))):
                own = np.frombuffer(data, np.int32)
                at = place[shard] + 1
                ids[at : at + len(own)] = np.where(own > 0, own + offset, 0)
            ids = ids[numbers]
            ids = ids[np.append(True, (ids[1:] > 0) | (ids[:-1] > 0))]
            both = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
            name = key[0].as_py()
            rows = _cuts(Filter.count(codec, [ids[both], ids[both + 1]]), name, shard_bits)
            rows.append((name, None, None, len(ids), _packed(ids)))
        return _table(rows, PARTS, _PART_KINDS)

    return run


def _longer(pairs: Codec, codec: Codec, shard_bits: int):
    """Chunk in ids and its frequent pairs -> cuts of its filter of phrases of three words and more."""

    def run(key, chunk: pa.Table, hits: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if chunk.num_rows and hits.num_rows:
            ids = _numbers(chunk.column("size")[0].as_py(), chunk.column("numbers")[0].as_py()).astype(np.int64)
            good = Filter.merge(pairs, [Filter.from_bytes(pairs, data[8:], int.from_bytes(data[:8], "little")) for data in hits.column("hits").to_pylist()]).limbs[0]
            own = pairs.permute(pairs.pack([ids[:-1], ids[1:]]))[0]
            at = np.minimum(np.searchsorted(good, own), len(good) - 1)
            linked = (ids[:-1] > 0) & (ids[1:] > 0) & (good[at] == own)
            columns: list[list[np.ndarray]] = [[] for _ in range(codec.words)]
            run_ok = linked
            for n in range(3, codec.words + 1):
                run_ok = run_ok[:-1] & linked[n - 2 :]
                starts = np.flatnonzero(run_ok)
                for i in range(codec.words):
                    columns[i].append(ids[starts + i] if i < n else np.zeros(len(starts), np.int64))
            rows = _cuts(Filter.count(codec, [np.concatenate(c) for c in columns]), key[0].as_py(), shard_bits)
        return _table(rows, PARTS, _PART_KINDS)

    return run


def _merged(codec: Codec, least: int, shard_bits: int, answer: bool):
    """Cuts of a shard -> its frequent phrases and, for ``answer``, which of them each chunk holds, as a filter behind the shard's name."""

    def run(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        prefix = key[0].as_py()
        names, cuts = part.column("chunk").to_pylist(), part.column("part").to_pylist()
        # Merged as they come, so that what is unpacked stays near the number of distinct entries.
        whole, held, size = Filter.merge(codec, []), [], 0
        for data in cuts:
            held.append(Filter.from_bytes(codec, data, prefix))
            size += len(held[-1])
            if size > max(1 << 20, len(whole)):
                whole, held, size = Filter.merge(codec, [whole, *held]), [], 0
        whole = Filter.merge(codec, [whole, *held])
        good = whole.where(whole.counts >= least)
        columns = good.words()
        rows: list[tuple] = [
            (None, None, [int(w) for w in own if w], int(a)) for *own, a in zip(*(c.tolist() for c in columns), good.counts.tolist())
        ]
        if answer and len(good):
            for name, data in zip(names, cuts):
                own = Filter.from_bytes(codec, data, prefix)
                at = np.minimum(np.searchsorted(good.limbs[0], own.limbs[0]), len(good) - 1)
                hits = own.where(good.limbs[0][at] == own.limbs[0])
                if len(hits):
                    rows.append((name, prefix.to_bytes(8, "little") + hits.to_bytes(shard_bits), None, None))
        return _table(rows, FOUND, _FOUND_KINDS)

    return run


class Phrases:
    """Written counts: ``sizes`` (lang, n), ``vocabulary`` (lang, word, f, id) and ``phrases`` (phrase: ids, a)."""

    def __init__(self, docs: DataFrame, least: int = LEAST, longest: int = LONGEST):
        # Chunks are removed once they are pairs: what is kept is written to folders from outside of the block.
        spark = docs.sparkSession
        folders = {name: run_folder(spark, name) for name in ("phrase-sizes", "phrase-vocabulary", "phrase-pairs")}

        def kept(df: DataFrame, name: str) -> DataFrame:
            df.write.parquet(folders[name])
            return spark.read.schema(df.schema).parquet(folders[name])

        with scratch(spark):
            chunks, shard_bits = chunked(docs)
            self.sizes = kept(chunks.filter(F.col("n").isNotNull()).groupBy("lang").agg(F.sum("n").alias("n")).filter("n > 0"), "phrase-sizes")
            entries = chunks.filter(F.col("shard").isNotNull()).select("shard", "chunk", "lang", "words", "times")
            words_ = written(entries.groupBy("shard").applyInArrow(_frequent(least), WORDS), "phrase-words")
            frequent = words_.filter(F.col("word").isNotNull())
            # Numbers of a shard's words follow those of the shards before it: one row per shard.
            per_shard = frequent.groupBy("shard").agg(F.count(F.lit(1)).alias("m"))
            before = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
            offsets = written(per_shard.select("shard", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("offset")), "phrase-offsets")
            placed = frequent.join(offsets, "shard").select("lang", "word", "f", (F.col("offset") + F.col("number")).cast("int").alias("id"))
            self.vocabulary = kept(placed, "phrase-vocabulary")
            bits = max(1, self.vocabulary.count().bit_length())
            pairs, longer = Codec(bits, 2), Codec(bits, longest)
            shard_bits = min(pairs.width, shard_bits)

            known = words_.filter(F.col("ids").isNotNull()).join(offsets, "shard").select(F.col("chunk").alias("home"), "shard", "ids", "offset")
            texts = chunks.filter(F.col("numbers").isNotNull()).select("chunk", "size", "numbers", "shards")
            parts = kept(texts.groupBy("chunk").cogroup(known.groupBy("home")).applyInArrow(_pairs(pairs, shard_bits), PARTS), "phrase-pairs")
        cuts = parts.filter(F.col("shard").isNotNull()).select("shard", "chunk", "part")
        found = written(cuts.groupBy("shard").applyInArrow(_merged(pairs, least, shard_bits, True), FOUND), "phrase-found")

        texts = parts.filter(F.col("numbers").isNotNull()).select("chunk", "size", "numbers")
        hits = found.filter(F.col("hits").isNotNull()).select("chunk", "hits")
        more = texts.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(_longer(pairs, longer, shard_bits), PARTS)
        rest = more.select("shard", "chunk", "part").groupBy("shard").applyInArrow(_merged(longer, least, shard_bits, False), FOUND)
        phrases = found.filter(F.col("phrase").isNotNull()).unionAll(rest) if longest > 2 else found.filter(F.col("phrase").isNotNull())
        self.phrases = written(phrases.select("phrase", "a"), "phrase-counts")

    def named(self) -> DataFrame:
        """``phrase`` as ids, ``a``, ``lang``, ``n`` and ``text``, the words joined by spaces."""
        spread = self.phrases.select("phrase", F.posexplode("phrase").alias("at", "id"))
        words_of = self.vocabulary.select("id", "lang", F.col("word").cast("string").alias("word"))
        texts = (
            spread.join(words_of, "id")
            .groupBy("phrase")
            .agg(F.any_value("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("own"))
            .select("phrase", "lang", F.array_join("own.word", " ").alias("text"))
        )
        return self.phrases.join(texts, "phrase").join(self.sizes, "lang")

    def scored(self) -> DataFrame:
        """Phrases that no longer one of the same count holds, with ``l``, ``r`` and ``score`` of their lowest cut."""
        size = F.size("phrase")
        # If any longer phrase is as frequent, one that is longer by a word is.
        long = self.phrases.filter(size > 2)
        inner = long.select(F.slice("phrase", 1, size - 1).alias("phrase"), "a").unionAll(long.select(F.slice("phrase", 2, size - 1).alias("phrase"), "a"))
        left = self.named().join(inner.distinct(), ["phrase", "a"], "left_anti")
        parts = self.phrases.unionAll(self.vocabulary.select(F.array("id").alias("phrase"), F.col("f").alias("a")))
        cut = left.select("*", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
        cut = cut.select("*", F.slice("phrase", F.lit(1), F.col("k")).alias("_l"), F.slice("phrase", F.col("k") + 1, size - F.col("k")).alias("_r"))
        cut = cut.join(parts.select(F.col("phrase").alias("_l"), F.col("a").alias("l")), "_l")
        cut = cut.join(parts.select(F.col("phrase").alias("_r"), F.col("a").alias("r")), "_r")
        score = F.expr("(cast(1000 * a as decimal(19,0)) * cast(n as decimal(18,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(18,0)))")
        lowest = cut.withColumn("score", score).groupBy("lang", "text", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
        return lowest.select("lang", F.col("text").alias("phrase"), "a", "m.l", "m.r", "n", "m.score")


def best(scored: DataFrame, n: int = BEST, salts: int = 64) -> DataFrame:
    """The first ``n`` phrases of each language with their ``rank``; languages are cut down in salted groups first."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = scored.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    few = salted.withColumn("_at", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).filter(F.col("_at") <= n)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= n).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@query(
    "op12_collocations",
    r"""
    WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
    g AS (SELECT lang, len(x) AS k, array_to_string(x, ' ') AS phrase FROM (
      SELECT lang, w[i:i + k - 1] AS x FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w), (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(w))),
    f AS (SELECT lang, k, phrase, count(*)::BIGINT AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
    n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
    c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
    inside AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS a FROM (SELECT lang, a, k, w, i, unnest(range(2, k)) AS m FROM (SELECT *, unnest(range(1, k)) AS i FROM c)) WHERE i + m - 1 <= k GROUP BY ALL),
    cut AS (SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, n.n, i, ((1000::HUGEINT * c.a * n.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
      FROM (SELECT *, unnest(range(1, k)) AS i FROM c) c JOIN n USING (lang)
      JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:i], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[i + 1:c.k], ' ')),
    low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
    kept AS (SELECT low.* FROM low ANTI JOIN inside ON inside.lang = low.lang AND inside.phrase = low.phrase AND 100 * inside.a >= 100 * low.a),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
    SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
    """,
)
def op12(spark, folder):
    return best(Phrases(table(spark, folder, "documents")).scored())
