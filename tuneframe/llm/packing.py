"""Pack documents into token windows, each filled with lexical neighbours of its seed document.

Documents are tokenized where they lie. Whole windows of a long document stand alone; what remains
of each document goes to the shard that its task is filling. A shard has a BM25 inverted index of
its documents; statistics (document frequencies, mean length, number of documents) come from a
pass over the whole table. The first unused document seeds a window, and the unused documents that
the index scores highest for the seed's words follow until the window is full. The last one is
cut, and its rest seeds the next window, so every window is full. What is left at the end of a task
is cut at powers of two, which need no padding.

Nothing is shuffled but the frequencies: ``2 ** TERM_BITS`` hashed terms, a fixed size that does not
grow with the vocabulary, and the only thing that tasks are sent. A shard is bounded by documents
and tokens, so a task's memory does not grow with its input.

* Null text is empty: a document is its end id alone. An empty table gives no rows.
* Repeated rows are packed as often as they occur. Ties in score go to the earlier document.
* ``keep`` columns are carried; the other output names are fixed and win over the input's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tuneframe.llm.registry import query, table
from tuneframe.llm.text import as_strings, distinct_words, laid_out, lowered, stretches, word_hashes
from tuneframe.session import give_back, lean

WINDOW = 4096
END_ID = 2
VOCABULARY = "word_bpe_49k.json"
TERM_BITS = 18
K1, B = 1.2, 0.75
SHARD_DOCUMENTS, SHARD_TOKENS = 1024, 4 << 20
# Bytes of text whose words are told apart together, and distinct words that are held and encoded at a time.
GROUP_BYTES, CACHE_WORDS = 16 << 20, 250_000
# Pre-tokens of one call of the tokenizer's model.
CALL_PIECES = 20_000
# Fixed values of the tokenizer: pre-tokens are runs of letters, single digits and runs of symbols, its contractions begin
# with an apostrophe, and its special tokens begin with ``<|``.
_SEPARATOR, _LETTER, _DIGIT, _SYMBOL = range(4)
_kinds = np.full(256, _SYMBOL, np.uint8)
_kinds[ord("a") : ord("z") + 1] = _kinds[0x80:] = _LETTER
_kinds[ord("0") : ord("9") + 1] = _DIGIT
_kinds[ord("\n")] = _SEPARATOR
_SHORT, _LONG = np.frombuffer(b"stmd", np.uint8), np.frombuffer(b"revell", np.uint16)
# Byte-level vocabularies name printable Latin-1 bytes by themselves and the others, in order, from U+0100 on.
_own_names = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_byte_names = np.arange(256, dtype=np.uint32)
_byte_names[sorted(set(range(256)) - _own_names)] = 0x100 + np.arange(256 - len(_own_names))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _plain(words: pa.Array) -> np.ndarray:
    """Which words the tokenizer's normalisation leaves alone but for case: those of ASCII and the letters from U+00C0 to U+00FF, without ``<|``."""
    data, place = laid_out(words)
    after = np.append(data[1:], np.uint8(ord("\n")))
    letter = np.flatnonzero((data == 0xC3) & (after >= 0x80) & (after < 0xC0) & (after != 0x97) & (after != 0xB7))
    odd = (data >= 0x80) | ((data == ord("<")) & (after == ord("|")))
    odd[letter] = odd[letter + 1] = False
    plain = np.ones(len(words), bool)
    plain[np.searchsorted(place, np.flatnonzero(odd), "right") - 1] = False
    return plain


def _pre_tokens(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Pre-tokens of plain words, lower case, in order, with a line feed after each word; and the word of each."""
    data, _ = laid_out(words)
    data = lowered(data)
    upper = np.flatnonzero(data == 0xC3) + 1
    data[upper] += np.where(data[upper] < 0x9F, 0x20, 0).astype(np.uint8)  # the letters from U+00C0 to U+00DE
    padded = np.append(data, np.full(3, ord("\n"), np.uint8))
    kind = _kinds[padded]
    start = np.ones(len(padded), bool)
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT) | (kind[1:] == _SEPARATOR)
    at = np.flatnonzero(data == ord("'"))
    at = at[(at == 0) | (kind[at - 1] != _SYMBOL)]
    short = at[np.isin(padded[at + 1], _SHORT)]
    long = at[np.isin(padded[at + 1] | (padded[at + 2].astype(np.uint16) << 8), _LONG)]
    start[short + 1] = start[long + 1] = False
    start[short + 2] = start[long + 3] = True
    first = np.flatnonzero(start[: len(data)])
    offsets = np.append(first, len(data)).astype(np.int64)
    pieces = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    ended = data[first] == ord("\n")
    return pieces, np.cumsum(ended) - ended


class WordTokens:
    """Ids of texts for a tokenizer whose pre-tokens never cross white space: each distinct word of a group of texts is encoded once.

    Words of ASCII and Latin-1 letters are cut into pre-tokens here, which go to the byte-pair model, each once; their case does not count.
    Words with other characters, or with ``<|``, the start of the special tokens, go through the whole tokenizer
    as they stand, since normalisation may change them together with their neighbours. Nothing is kept from group to group.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = WhitespaceSplit()
        names = self.tokenizer.get_vocab()
        self.last = np.zeros(max(names.values()) + 1, bool)  # the ids that end a pre-token
        self.last[[i for name, i in names.items() if name.endswith(self.tokenizer.model.end_of_word_suffix)]] = True

    def _piece_ids(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens, end to end, and how many each has."""
        out = [np.zeros(0, np.uint32)]
        for i in range(0, len(pieces), CALL_PIECES):
            data, place = laid_out(pieces.slice(i, CALL_PIECES))
            named = _byte_names[data]
            named[np.append(place[1:], len(data)) - 1] = ord(" ")
            ids = self.model.encode_batch_fast([named.tobytes().decode("utf-32-le")], add_special_tokens=False)[0].ids
            out.append(np.array(ids, np.uint32))
        ids = np.concatenate(out)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(pieces):
            raise ValueError("the vocabulary does not mark the ends of pre-tokens")
        return ids, np.diff(ends, prepend=0)

    def _word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, end to end, and how many each has."""
        plain = _plain(words)
        size = np.zeros(len(words), np.int64)
        pieces, word = _pre_tokens(words.filter(pa.array(plain)))
        coded = pieces.dictionary_encode()
        code = coded.indices.to_numpy()
        flat, piece_size = self._piece_ids(coded.dictionary)
        first = np.cumsum(piece_size) - piece_size
        piece_size[pc.equal(coded.dictionary, b"\n").to_numpy(zero_copy_only=False)] = 0
        size[plain] = np.bincount(word, piece_size[code], int(plain.sum())).astype(np.int64)
        ids = stretches(flat, first[code], piece_size[code])
        if plain.all():
            return ids, size
        others = [self.tokenizer.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids for w in words.filter(pa.array(~plain)).cast(pa.large_binary()).to_pylist()]
        size[~plain] = [len(x) for x in others]
        out = np.empty(int(size.sum()), np.uint32)
        of_plain = np.repeat(plain, size)
        out[of_plain], out[~of_plain] = ids, np.fromiter((i for x in others for i in x), np.uint32)
        return out, size

    def groups(self, texts: pa.Array):
        """Ids of each text of a column, and the hashed terms of its words: the same that :func:`terms_of` finds."""
        for group in _groups(texts):
            words, number, begin = distinct_words(group)
            term = _terms(words)
            found = [self._word_ids(words.slice(i, CACHE_WORDS)) for i in range(0, len(words), CACHE_WORDS)] or [(np.zeros(0, np.uint32), np.zeros(0, np.int64))]
            flat, size = (np.concatenate(x) for x in zip(*found))
            give_back()  # the model's answers take many times the room of their ids
            first = np.cumsum(size) - size
            for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
                own = number[a:b]
                yield stretches(flat, first[own], size[own]), term[own]

    def ids(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The same for one text."""
        return next(self.groups(as_strings([data])))


_tokens: dict[str, WordTokens] = {}


def tokens_for(path: str) -> WordTokens:
    """One per worker process, kept over its tasks."""
    if path not in _tokens:
        _tokens[path] = WordTokens(path)
    return _tokens[path]


def _groups(texts: pa.Array):
    """A column cut into slices of up to ``GROUP_BYTES`` of text, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + GROUP_BYTES, "right")))
        yield texts.slice(start, stop - start)
        start = stop


def _terms(words: pa.Array) -> np.ndarray:
    return (word_hashes(lowered(laid_out(words)[0])) & np.uint64((1 << TERM_BITS) - 1)).astype(np.int64)


def terms_of(texts: pa.Array | list[np.ndarray]):
    """Hashed terms of the words of each text, in order."""
    texts = texts if isinstance(texts, pa.Array) else as_strings([t.tobytes() for t in texts])
    out = []
    for group in _groups(texts):
        words, number, begin = distinct_words(group)
        own = _terms(words)[number]
        out += np.split(own, begin[1:-1])
    return out


class Statistics:
    """Inverse document frequency by term and mean words of a document, over a whole table."""

    def __init__(self, idf: np.ndarray, mean: float):
        self.idf, self.mean = idf, mean

    @classmethod
    def of(cls, docs: DataFrame) -> Statistics:
        def count(batches):
            df, words, n = np.zeros(1 << TERM_BITS, np.int64), 0, 0
            last = np.zeros(1 << TERM_BITS, np.int64)
            for own in (x for batch in batches for group in _groups(batch.column(0)) for x in terms_of(group)):
                at = np.arange(len(own))
                last[own] = at
                df[own[last[own] == at]] += 1  # each term once: where it stands last
                words, n = words + len(own), n + 1
            at = np.flatnonzero(df)
            keys, values = np.concatenate((at, [-1, -2])), np.concatenate((df[at], [words, n]))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(values)], ["term", "n"])

        sums = docs.select("text").mapInArrow(lean(count), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        term, total = sums.column("term").to_numpy(), sums.column("n").to_numpy()
        df = np.zeros(1 << TERM_BITS, np.float64)
        df[term[term >= 0]] = total[term >= 0]
        words, n = (int(total[term == k].sum()) for k in (-1, -2))
        return cls(np.maximum(0, np.log((n - df + 0.5) / (df + 0.5))).astype(np.float32), max(1.0, words / max(1, n)))


class Shard:
    """Inverted index of a bounded set of documents."""

    def __init__(self, term_lists: list[np.ndarray], stats: Statistics):
        self.n = len(term_lists)
        each = [np.unique(t, return_counts=True) for t in term_lists]
        doc = np.repeat(np.arange(self.n), [len(t) for t, _ in each])
        term = np.concatenate([t for t, _ in each] or [np.zeros(0, np.int64)])
        tf = np.concatenate([c for _, c in each] or [np.zeros(0, np.int64)]).astype(np.float32)
        length = np.array([len(t) for t in term_lists], np.float32)[doc]
        weight = stats.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / stats.mean))
        kept = weight > 0  # a term in more than half of all documents tells nothing
        doc, term, weight = doc[kept], term[kept], weight[kept]
        names, self.term = np.unique(term, return_inverse=True)
        self.doc_end = np.cumsum(np.bincount(doc, minlength=self.n))
        order = np.argsort(self.term, kind="stable")
        self.posting, self.weight = doc[order], weight[order]
        self.size = np.bincount(self.term, minlength=len(names))
        self.end = np.cumsum(self.size)

    def scores(self, seed: int) -> np.ndarray:
        own = self.term[(self.doc_end[seed - 1] if seed else 0) : self.doc_end[seed]]
        size, ends = self.size[own], np.cumsum(self.size[own])
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.end[own] - ends, size) + np.arange(total)
        return np.bincount(self.posting[at], self.weight[at], self.n)


class _Packer:
    """Turns the documents of one task into pieces (document, start, length, sequence, offset)."""

    def __init__(self, stats: Statistics, partition: int):
        self.stats, self.next = stats, partition << 32
        self.window: list[tuple] = []  # (document, start, ids) of the open window
        self.room = WINDOW
        self.docs: list[tuple] = []
        self.tokens = 0
        self.out: list[tuple] = []

    def _close(self):
        offset = 0
        for doc, start, ids in self.window:
            self.out.append((doc, start, ids, self.next, offset))
            offset += len(ids)
        self.window, self.room, self.next = [], WINDOW, self.next + 1

    def _put(self, doc, start, ids):
        """Fill the open window; what does not fit goes on in the next."""
        while len(ids):
            part = ids[: self.room]
            self.window.append((doc, start, part))
            self.room -= len(part)
            start, ids = start + len(part), ids[len(part) :]
            if not self.room:
                self._close()

    def add(self, doc, ids: np.ndarray, own_terms: np.ndarray):
        whole = len(ids) // WINDOW * WINDOW
        for start in range(0, whole, WINDOW):
            self.out.append((doc, start, ids[start : start + WINDOW], self.next, 0))
            self.next += 1
        if whole < len(ids):
            self.docs.append((doc, whole, ids[whole:], own_terms))
            self.tokens += len(ids) - whole
        if len(self.docs) >= SHARD_DOCUMENTS or self.tokens >= SHARD_TOKENS:
            self.pack()

    def pack(self):
        shard = Shard([d[3] for d in self.docs], self.stats)
        free = np.ones(shard.n, bool)
        seed, first = None, 0  # seed: the document whose words choose what fills the open window
        while True:
            if seed is None:
                while first < shard.n and not free[first]:
                    first += 1
                if first == shard.n:
                    break
                free[first] = False
                self._put(*self.docs[first][:3])
                seed = first if self.window else None
                continue
            filled = False
            for near in np.argsort(-shard.scores(seed), kind="stable").tolist():
                if not free[near]:
                    continue
                before = self.next
                free[near] = False
                self._put(*self.docs[near][:3])
                if self.next != before:  # full; the rest of the cut neighbour opens and seeds the next window
                    seed, filled = (near if self.window else None), True
                    break
            if not filled:
                break  # all are used; the next shard goes on with the open window
        self.docs, self.tokens = [], 0

    def finish(self):
        if self.docs:
            self.pack()
        rest, self.window, left = self.window, [], WINDOW - self.room
        while left:
            self.room = 1 << (left.bit_length() - 1)
            left -= self.room
            while self.room:
                doc, start, ids = rest.pop(0)
                part = ids[: self.room]
                self.window.append((doc, start, part))
                self.room -= len(part)
                if len(part) < len(ids):
                    rest.insert(0, (doc, start + len(part), ids[len(part) :]))
            self._close()

    def take(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


PIECES = "start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(docs: DataFrame, keep: list[str] = ("doc_id",), vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pieces: the ``keep`` columns, start and length in the document's ids, doc_tokens, sequence_id,
    offset in the sequence and the ids (little-endian unsigned 32-bit). Sequences are numbered within input partitions."""
    path = vocabulary or default_vocabulary()
    stats = Statistics.of(docs)
    fixed = T.StructType.fromDDL(PIECES)
    keep = [c for c in keep if c not in fixed.names]
    schema = T.StructType([docs.schema[c] for c in keep] + fixed.fields)

    def run(batches):
        tokens = tokens_for(path)
        packer = _Packer(stats, TaskContext.get().partitionId())
        carried: dict[int, pa.RecordBatch] = {}

        def emit():
            found = packer.take()
            base, total = {}, 0
            for number, batch in carried.items():
                base[number], total = total, total + batch.num_rows
            for i in range(0, len(found), 2048):
                part = found[i : i + 2048]
                at = pa.array([base[x[0][0]] + x[0][1] for x in part])
                own = pa.Table.from_batches(carried.values()).take(at).combine_chunks() if keep else None
                yield pa.RecordBatch.from_arrays(
                    [c.chunk(0) for c in (own.columns if keep else [])]
                    + [pa.array([x[1] for x in part], pa.int64()), pa.array([len(x[2]) for x in part], pa.int64()),
                       pa.array([x[0][2] for x in part], pa.int64()), pa.array([x[3] for x in part], pa.int64()),
                       pa.array([x[4] for x in part], pa.int64()), pa.array([x[2].tobytes() for x in part], pa.binary())],
                    schema.names,
                )

        for number, batch in enumerate(batches):
            carried[number] = batch.select(range(1, 1 + len(keep)))
            for row, (ids, own_terms) in enumerate(tokens.groups(batch.column(0))):
                ids = np.append(ids, np.uint32(end_id))
                packer.add((number, row, len(ids)), ids, own_terms)
                if len(packer.out) >= 2048:
                    yield from emit()
            yield from emit()
            waiting = {d[0][0] for d in packer.docs} | {w[0][0] for w in packer.window}
            carried = {k: v for k, v in carried.items() if k in waiting or k == number}
        packer.finish()
        yield from emit()

    rows = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("_p_text"), *[F.col(c) for c in keep])
    return rows.mapInArrow(lean(run), schema)


@query("op4_packing")
def op4(spark, folder):
    pieces = pack(table(spark, folder, "documents"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
