"""Counting quotient filters over packed n-grams of word ids.

An n-gram of word ids is packed into 64-bit limbs. The first limb is permuted by an invertible function of all limbs; its
leading bits, the quotient, say where the entry belongs and are not stored, the rest, the remainder, is stored in full together with the other limbs. So a
filter is a lossless set of counters: entries stand in order of quotient and remainder, run lengths of the quotients are
written in unary, and counters take one byte, with the large ones in a list behind. Filters of the same codec merge like
sorted lists, and a range of quotients is a filter of its own.
"""

from __future__ import annotations

import struct

import numpy as np

U64 = np.uint64
_ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_HEAD = struct.Struct("<QBB")


class Codec:
    """Packs and permutes n-grams of up to ``words`` ids of ``bits`` bits; id 0 stands for no word."""

    def __init__(self, bits: int, words: int):
        if not 1 <= bits <= 64:
            raise ValueError("an id takes 1 to 64 bits")
        self.bits, self.words = bits, words
        self.per = max(1, min(words, 64 // bits))
        self.limbs = -(-words // self.per)
        self.width = bits * self.per
        self.mask = U64((1 << self.width) - 1)
        self.half = U64((self.width + 1) // 2)
        self.odd = [m & ((1 << self.width) - 1) | 1 for m in _ODD]
        self.inverse = [pow(m, -1, 1 << self.width) for m in self.odd]

    def pack(self, columns: list[np.ndarray]) -> list[np.ndarray]:
        """Limbs of n-grams given word by word; missing words at the end are 0."""
        zero = np.zeros(len(columns[0]), U64)
        out = []
        for at in range(0, self.words, self.per):
            limb = zero.copy()
            for i in range(at, min(at + self.per, self.words)):
                limb = (limb << U64(self.bits) if self.bits < 64 else zero) | (columns[i].astype(U64) if i < len(columns) else zero)
            out.append(limb)
        return out

    def unpack(self, limbs: list[np.ndarray]) -> list[np.ndarray]:
        out = []
        for n, at in enumerate(range(0, self.words, self.per)):
            own = min(self.per, self.words - at)
            for i in range(own):
                out.append((limbs[n] >> U64(self.bits * (own - 1 - i))) & U64((1 << self.bits) - 1))
        return out

    def _others(self, limbs: list[np.ndarray]) -> np.ndarray:
        h = np.zeros(len(limbs[0]), U64)
        with np.errstate(over="ignore"):
            for limb in limbs[1:]:
                h = (h ^ limb) * U64(_ODD[0])
                h ^= h >> U64(29)
        return h & self.mask

    def permute(self, limbs: list[np.ndarray]) -> list[np.ndarray]:
        x = limbs[0] ^ self._others(limbs)
        with np.errstate(over="ignore"):
            for m in self.odd:
                x = ((x ^ (x >> self.half)) * U64(m)) & self.mask
        return [x ^ (x >> self.half), *limbs[1:]]

    def restore(self, limbs: list[np.ndarray]) -> list[np.ndarray]:
        x = limbs[0] ^ (limbs[0] >> self.half)
        with np.errstate(over="ignore"):
            for m in reversed(self.inverse):
                x = (x * U64(m)) & self.mask
                x ^= x >> self.half
        return [x ^ self._others(limbs), *limbs[1:]]


class Filter:
    """Distinct permuted keys in rising order, and their counts."""

    __slots__ = ("codec", "counts", "limbs")

    def __init__(self, codec: Codec, limbs: list[np.ndarray], counts: np.ndarray):
        self.codec, self.limbs, self.counts = codec, limbs, counts

    def __len__(self) -> int:
        return len(self.counts)

    @classmethod
    def count(cls, codec: Codec, columns: list[np.ndarray]) -> Filter:
        """Count n-grams given word by word."""
        limbs = codec.permute(codec.pack(columns))
        return cls(codec, limbs, np.ones(len(limbs[0]), np.int64))._collapsed()

    @classmethod
    def merge(cls, codec: Codec, filters: list[Filter]) -> Filter:
        if not filters:
            return cls(codec, [np.zeros(0, U64)] * codec.limbs, np.zeros(0, np.int64))
        limbs = [np.concatenate([f.limbs[i] for f in filters]) for i in range(codec.limbs)]
        return cls(codec, limbs, np.concatenate([f.counts for f in filters]))._collapsed()

    def _collapsed(self) -> Filter:
        if len(self) == 0:
            return self
        # Stable sorting takes runs that are sorted already as they are.
        order = np.argsort(self.limbs[0], kind="stable") if len(self.limbs) == 1 else np.lexsort(self.limbs[::-1])
        limbs = [limb[order] for limb in self.limbs]
        first = np.ones(len(order), bool)
        first[1:] = np.any([limb[1:] != limb[:-1] for limb in limbs], axis=0)
        starts = np.flatnonzero(first)
        return Filter(self.codec, [limb[starts] for limb in limbs], np.add.reduceat(self.counts[order], starts))

    def where(self, keep: np.ndarray) -> Filter:
        return Filter(self.codec, [limb[keep] for limb in self.limbs], self.counts[keep])

    def words(self) -> list[np.ndarray]:
        return self.codec.unpack(self.codec.restore(self.limbs))

    def split(self, prefix_bits: int) -> list[tuple[int, Filter]]:
        """(prefix, filter) for every value that the leading ``prefix_bits`` of the quotient take."""
        prefix = (self.limbs[0] >> U64(self.codec.width - prefix_bits)) if prefix_bits else np.zeros(len(self), U64)
        ends = np.flatnonzero(np.append(prefix[1:] != prefix[:-1], True)) + 1 if len(self) else []
        out, start = [], 0
        for end in map(int, ends):
            out.append((int(prefix[start]), Filter(self.codec, [limb[start:end] for limb in self.limbs], self.counts[start:end])))
            start = end
        return out

    def to_bytes(self, prefix_bits: int = 0) -> bytes:
        """Compact form of entries that share the leading ``prefix_bits``."""
        n, left = len(self), self.codec.width - prefix_bits
        q = min(left, max(n - 1, 0).bit_length())
        r = left - q
        rest = self.limbs[0] & U64((1 << left) - 1)
        quotient = (rest >> U64(r) if r < 64 else np.zeros(n, U64)).astype(np.int64)
        runs = np.zeros(n + (1 << q), np.uint8)
        runs[np.arange(n) + quotient] = 1
        small = np.minimum(self.counts, 255).astype(np.uint8)
        parts = [_HEAD.pack(n, prefix_bits, q), np.packbits(runs).tobytes(), _narrow(rest & U64((1 << r) - 1), r)]
        parts += [_narrow(limb, self.codec.width) for limb in self.limbs[1:]]
        return b"".join([*parts, small.tobytes(), self.counts[small == 255].astype("<i8").tobytes()])

    @classmethod
    def from_bytes(cls, codec: Codec, data: bytes, prefix: int = 0) -> Filter:
        n, prefix_bits, q = _HEAD.unpack_from(data)
        at = _HEAD.size
        size = -(-(n + (1 << q)) // 8)
        runs = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n + (1 << q))
        at += size
        quotient = (np.flatnonzero(runs) - np.arange(n)).astype(U64)
        r = codec.width - prefix_bits - q
        rest, at = _wide(data, at, n, r)
        first = rest | (quotient << U64(r) if r < 64 else U64(0)) | U64(prefix << (codec.width - prefix_bits) if prefix_bits else 0)
        limbs = [first]
        for _ in range(codec.limbs - 1):
            limb, at = _wide(data, at, n, codec.width)
            limbs.append(limb)
        counts = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
        large = counts == 255
        counts[large] = np.frombuffer(data, "<i8", int(large.sum()), at + n)
        return cls(codec, limbs, counts)


def _narrow(values: np.ndarray, bits: int) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-bits // 8)].tobytes()


def _wide(data: bytes, at: int, n: int, bits: int) -> tuple[np.ndarray, int]:
    size = -(-bits // 8)
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8, n * size, at).reshape(n, size)
    return out.reshape(-1).view("<u8").astype(U64), at + n * size
