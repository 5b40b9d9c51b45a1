"""Text expressions with Python's idea of white space and line ends, all JVM-side."""

from __future__ import annotations

from functools import reduce
from operator import or_
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from tuneframe.constants import LINE_BREAK_REGEX, OTHER_LINE_BREAKS, PY_SPACE_CHARS, PY_SPACE_CLASS


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(PY_SPACE_CHARS))


def squeeze(text: Column) -> Column:
    """Trim and turn every run of white space into one blank."""
    return strip(F.regexp_replace(text, f"(?U){PY_SPACE_CLASS}+", " "))


def _raw_lines(text: Column) -> Column:
    """Split at every line boundary. Texts that only use line feeds, found out by plain byte
    search, take the splitter that needs no regex."""
    other = [F.contains(text, F.lit(mark)) for mark in OTHER_LINE_BREAKS]
    return F.when(reduce(or_, other), F.split(text, LINE_BREAK_REGEX)).otherwise(F.split(text, "\n"))


def split_lines(text: Column) -> Column:
    """Lines of a text; a final line break does not open another line."""

    def cut(parts):
        return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)

    return let(_raw_lines(text), cut)


def non_empty_lines(text: Column) -> Column:
    """Stripped lines without the blank ones."""
    return F.filter(F.transform(_raw_lines(text), strip), lambda line: line != "")


def line_block(text: Column) -> Column:
    """The non-empty lines joined by, and enclosed in, line feeds.

    A list of lines stands as a contiguous block inside another one exactly when its
    ``line_block`` is a substring of the other's, since no line holds a line feed.
    """
    return F.concat(F.lit("\n"), F.array_join(non_empty_lines(text), "\n"), F.lit("\n"))


def contains_line_block(haystack: Column, needle: Column) -> Column:
    """Whether the needle has lines and they stand as a block in the haystack."""
    found = let(line_block(needle), lambda block: (block != "\n\n") & F.contains(line_block(haystack), block))
    return F.coalesce(found, F.lit(False))


def as_text(value: Column) -> Column:
    """Text form of a value; a missing one reads ``None``."""
    return F.coalesce(value.cast("string"), F.lit("None"))


def fill(template: str, **values: Column) -> Column:
    """Concatenate a template's literal parts and columns. Values are never re-interpreted,
    so ``$``, ``\\`` and braces inside them are safe."""
    parts = []
    for literal, field, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field:
            parts.append(values[field])
    return F.concat(*parts)
