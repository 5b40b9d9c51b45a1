"""Token-id arrays: cutting at the end token, truncation, padding, masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tuneframe.functions.text import let


def cut_after_eos(ids: Column, eos: int) -> Column:
    """Ids up to and including the first end token; all of them when it is absent."""

    def cut(known: Column) -> Column:
        first = F.array_position(known, F.lit(eos)).cast("int")
        return F.slice(known, F.lit(1), F.when(first > 0, first).otherwise(F.size(known)))

    return let(ids, cut)


def truncate(ids: Column, limit: int, side: str = "left") -> Column:
    """At most ``limit`` ids; ``side`` is the end that gives way."""
    if side == "right":
        return F.slice(ids, 1, limit)
    return let(ids, lambda known: F.slice(known, F.greatest(F.size(known) - limit, F.lit(0)) + 1, F.lit(limit)))


def _fill(ids: Column, width: Column, value: Column) -> Column:
    return F.array_repeat(value, F.greatest(width - F.size(ids), F.lit(0)).cast("int"))


def pad_left(ids: Column, width: Column, value: int) -> Column:
    return F.concat(_fill(ids, width, F.lit(value)), ids)


def pad_right(ids: Column, width: Column, value: int) -> Column:
    return F.concat(ids, _fill(ids, width, F.lit(value)))


def ones(ids: Column) -> Column:
    return F.array_repeat(F.lit(1), F.size(ids))


def zeros(ids: Column) -> Column:
    return F.array_repeat(F.lit(0), F.size(ids))


def is_truncated(ids: Column, eos: int, pad: int) -> Column:
    """Whether the sequence stops without an end or pad token; NULL for an empty one."""
    return ~F.try_element_at(ids, F.lit(-1)).isin(eos, pad)


def truncated_mask(mask: Column, ids: Column, eos: int, pad: int) -> Column:
    """Zero the mask of sequences that were cut off."""
    return F.when(F.coalesce(is_truncated(ids, eos, pad), F.lit(True)), zeros(mask)).otherwise(mask)
