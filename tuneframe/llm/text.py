"""Texts as UTF-8 byte arrays: words, hashes and shingles, in numpy inside Spark's Arrow tasks.

A word is a longest run of bytes other than space and tab to carriage return; lower case means
A-Z only. Both rules are byte rules, so they hold for UTF-8 without decoding.
"""

from __future__ import annotations

from operator import mul

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

U64 = np.uint64
WORD = r"[^\x20\x09-\x0D]+"

_white = np.zeros(256, bool)
_white[[0x20, *range(0x09, 0x0E)]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[ord("A") : ord("Z") + 1] += 32
_random = np.random.Generator(np.random.PCG64(0x5EED))
_byte_code = _random.integers(0, 2**64 - 1, 256, dtype=U64, endpoint=True)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_BLOCK = 1 << 20
_powers: dict[int, np.ndarray] = {}


def ascii_lower(column):
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text):
    """Number of words of a text column, 0 for null."""
    plain = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.regexp_count(plain, F.lit("[^ ]+")).cast("long")


def byte_rows(column: pa.Array | pa.ChunkedArray):
    """One uint8 array per row of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield flat[start:end]


def lowered(data: np.ndarray) -> np.ndarray:
    return _lower[data]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_white[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 12) if have is None else max(n, 2 * len(have))
        out = np.full(size, base, U64)
        out[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(out)
        _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over the whole value."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span, from prefix sums; very long data is taken in blocks of spans."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + _BLOCK, "right")))
        top = int(ends[j - 1])
        with np.errstate(over="ignore"):
            part = _byte_code[data[base:top]] * _power(_BASE, top - base)
            sums = np.zeros(top - base + 1, U64)
            np.cumsum(part, out=sums[1:])
            first = starts[i:j] - base
            out[i:j] = (sums[ends[i:j] - base] - sums[first]) * _power(_INVERSE, top - base)[first]
        i = j
    return mix(out)


def run_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """The same of every run of ``width`` bytes."""
    out = np.empty(max(0, len(data) - width + 1), U64)
    for i in range(0, len(out), _BLOCK):
        part = data[i : i + _BLOCK + width - 1]
        with np.errstate(over="ignore"):
            sums = np.zeros(len(part) + 1, U64)
            np.cumsum(_byte_code[part] * _power(_BASE, len(part)), out=sums[1:])
            out[i : i + _BLOCK] = (sums[width:] - sums[:-width]) * _power(_INVERSE, len(part) - width + 1)
    return mix(out)


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of stretches, one after the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(first - ends + size, size) + np.arange(total)


def stretches(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Stretches of an array, one after the other."""
    return flat[spread(first, size)]


_ALL = 2**64 - 1
_codes = _byte_code.tolist()
_first_powers = [pow(_BASE, i, 2**64) for i in range(64)]


def word_hash(word: bytes) -> int:
    """The hash of one word, as :func:`word_hashes` gives it."""
    if len(word) > len(_first_powers):
        return int(span_hashes(np.frombuffer(word, np.uint8), np.zeros(1, np.int64), np.array([len(word)]))[0])
    h = sum(map(mul, map(_codes.__getitem__, word), _first_powers)) & _ALL
    h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & _ALL
    h = (h ^ (h >> 27)) * 0x94D049BB133111EB & _ALL
    return h ^ (h >> 31)


def word_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of a byte array, in order."""
    return span_hashes(data, *word_spans(data))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every run of ``k`` words; the whole sequence when there are fewer; sorted, distinct."""
    if len(words) == 0:
        return words
    n = min(k, len(words))
    with np.errstate(over="ignore"):
        out = np.full(len(words) - n + 1, n, U64)
        for i in range(n):
            out = mix(out * U64(_BASE) + words[i : len(words) - n + 1 + i])
    return np.unique(out)


def as_strings(texts: list[bytes]) -> pa.Array:
    """A string column of bytes as they are, as Spark hands texts over."""
    return pa.array(texts, pa.binary()).view(pa.string())


def distinct_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of a string column (null is empty), the number of each word in order, and where each text's words begin,
    with one end more."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = lists.flatten().dictionary_encode()
    number, begin, words = coded.indices.to_numpy(), lists.offsets.to_numpy().astype(np.int64), coded.dictionary
    empty = pc.index(words, "").as_py()  # between two white-space characters, before the first and behind the last
    if empty >= 0:
        kept = number != empty
        begin = np.concatenate((np.zeros(1, np.int64), np.cumsum(kept)))[begin]
        number = number[kept]
        number = number - (number > empty)
        words = pa.concat_arrays([words.slice(0, empty), words.slice(empty + 1)])
    return words, number, begin


def laid_out(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings end to end, a line feed after each, and where each begins."""
    words = words.cast(pa.large_binary())
    if not len(words):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    flat = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    begin = offsets[:-1] - offsets[0] + np.arange(len(words))
    out = np.full(len(flat) + len(words), ord("\n"), np.uint8)
    out[np.arange(len(flat)) + np.repeat(np.arange(len(words)), np.diff(offsets))] = flat
    return out, begin
