"""Burrows-Wheeler transforms of shards of byte strings, and their merge."""

from __future__ import annotations

import numpy as np

END = 0  # a byte below all others; text bytes are raised by one


def shard_bwt(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, transform) of strings laid end to end, each closed by ``END`` at ``ends - 1``.

    Suffixes end with their string; equal suffixes are ordered by string. Keys of eight bytes are
    sorted first, and only positions that still tie go on to the next eight. The transform gives the
    symbol before each suffix, ``END`` before a string's first.
    """
    n = len(data)
    width = 8
    own = np.repeat(ends, np.diff(np.concatenate((np.zeros(1, np.int64), ends))))  # end of each position's string
    key = data
    for size, kind in ((1, np.uint16), (2, np.uint32), (4, np.uint64)):  # nothing follows an end
        after = np.concatenate((key[size:], np.zeros(min(size, n), key.dtype)))
        after[(key & key.dtype.type(255)) == END] = 0
        key = (key.astype(kind) << kind(8 * size)) | after
    order = np.argsort(key, kind="stable")
    group = np.cumsum(np.concatenate((np.zeros(1, np.int64), (key[order][1:] != key[order][:-1]).astype(np.int64)))) if n else key
    depth = width
    while n:
        size = np.bincount(group)
        tied = np.flatnonzero((size[group] > 1) & (order + depth < own[order]))
        if not len(tied):
            break
        # Within a tie all suffixes are as long as the key, or all ended: an ended one differs by END.
        deep = key[order[tied] + depth]
        again = np.lexsort((deep, group[tied]))  # ties keep their order, which is that of the strings
        moved, deep = order[tied][again], deep[again]
        order[tied] = moved
        new = np.zeros(n, np.int64)
        new[1:] = group[1:] != group[:-1]
        g = group[tied]
        inner = np.flatnonzero((g[1:] == g[:-1]) & (deep[1:] != deep[:-1])) + 1
        new[tied[inner]] = 1
        group = np.cumsum(new)
        depth += width
    start = ends[:-1]
    before = np.concatenate((np.zeros(1, np.uint8), data[:-1])) if n else data
    before[start] = END
    return order, before[order]


def _stepped(transforms: list[np.ndarray], steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of all transforms, shard by shard: the one or two symbols before each suffix as one
    number; the row of the suffix that starts with them; and which codes hold an end."""
    value, row, base = [], [], 0
    for transform in transforms:
        back = np.empty(len(transform), np.int64)
        back[np.argsort(transform, kind="stable")] = np.arange(len(transform))
        at, own = np.arange(len(transform)), np.zeros(len(transform), np.uint64)
        for i in range(steps):
            own |= transform[at].astype(np.uint64) << np.uint64(8 * i)
            at = back[at]
        value.append(own)
        row.append(at + base)
        base += len(transform)
    code = np.concatenate(value).astype(np.uint8 if steps == 1 else np.uint16)
    ended = np.zeros(1 << (8 * steps), bool)
    for i in range(steps):
        ended |= ((np.arange(len(ended)) >> (8 * i)) & 255) == END
    return code, np.concatenate(row).astype(np.int32), ended


def merge(transforms: list[np.ndarray], depth: int, steps: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge transforms by refining their interleave until it is sorted by ``depth`` symbols, a multiple of ``steps`` (1 or 2).

    The interleave names a row of some shard for every merged position; at first shards stand one after the
    other. A round deals it out by the ``steps`` preceding symbols and moves each row to the suffix that
    starts with them, which sorts by that many symbols more than before; the suffixes themselves are never
    compared. Suffixes that agree on all symbols so far form a block; where a block splits in round h, the
    neighbours' common prefix is at least ``(h - 1) * steps`` and less than ``h * steps`` long.

    Returns the row of each merged suffix, its block after the last round, and that lower bound of the common
    prefix with the suffix before it, ``depth`` within a block.
    """
    if depth % steps:
        raise ValueError("the depth must be a multiple of the steps")
    total = sum(map(len, transforms))
    row, block = np.arange(total, dtype=np.int32), np.zeros(total, np.int32)
    common = np.full(total, depth, np.uint8)
    if not total:
        return row, block, common
    code, back, ended = _stepped(transforms, steps)
    new = np.ones(total, bool)
    for h in range(steps, depth + 1, steps):
        symbol = code[row]
        order = np.argsort(symbol, kind="stable")
        row, past, symbol = back[row[order]], block[order], symbol[order]
        np.not_equal(symbol[1:], symbol[:-1], out=new[1:])
        new[1:] |= past[1:] != past[:-1]
        new |= ended[symbol]
        common[new & (common == depth)] = h - steps
        block = np.cumsum(new, dtype=np.int32)
    return row, block, common


def repeated_intervals(strings: np.ndarray, ends: np.ndarray, depth: int, shard_bytes: int = 1 << 18) -> np.ndarray:
    """For every position of the strings, the block of equal ``depth``-byte substrings that starts there, -1 where none fits.

    ``strings`` are bytes laid end to end. Shards of whole strings are transformed alone and merged; all suffixes are
    never sorted together.
    """
    n = len(ends)
    size = np.diff(np.concatenate((np.zeros(1, np.int64), ends)))
    closed = np.zeros(len(strings) + n, np.uint16)
    place = np.arange(len(strings)) + np.repeat(np.arange(n), size)
    closed[place] = strings.astype(np.uint16) + 1
    # Bytes of text are raised by one; 255 never occurs in UTF-8, so the alphabet still fits a byte.
    closed = np.minimum(closed, 255).astype(np.uint8)
    shut = ends + np.arange(1, n + 1)
    cuts = np.searchsorted(shut, np.arange(shard_bytes, len(closed) + shard_bytes, shard_bytes), "left")
    bounds = np.unique(np.concatenate((np.zeros(1, np.int64), np.minimum(cuts + 1, n), np.array([n]))))
    arrays, transforms = [], []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        base = int(shut[a - 1]) if a else 0
        order, transform = shard_bwt(closed[base : shut[b - 1]], shut[a:b] - base)
        arrays.append(order + base)
        transforms.append(transform)
    row, block, _ = merge(transforms, depth, 2 if depth % 2 == 0 else 1)
    where = np.empty(len(closed), np.int64)
    where[np.concatenate([*arrays, np.zeros(0, np.int64)])[row]] = block
    out = where[place]
    out[np.arange(len(strings)) + depth > np.repeat(ends, size)] = -1
    return out
