"""Rows of large JSON documents, cut out by many tasks.

A JSON document has no record borders that a reader can seek to: a brace or a comma may stand in a string, and whether it does
depends on all that came before. So a byte range is read without knowing: its lexer is a function from the three states it may be
entered in (outside of strings, in a string, behind a backslash) to the state it is left in and the change of depth. The functions of
a file's ranges, one small row each, are composed in order, which gives every range the state it is really entered in. Then
each range is cut for itself, where an array's elements end. An element that crosses a border is put together from the
end of one range, whole ranges, and the start of a later one.

Ranges come from Spark's text reader, which splits a file over tasks behind any ``}``. They are written once, so that both passes see
the same ranges after a task is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tuneframe.session import written

RANGE_BYTES = 1 << 22

# Lexer states a range may be entered in.
OUTSIDE, STRING, ESCAPED = 0, 1, 2

_SPACE = b" \t\r\n"
_CLASS = np.zeros(256, np.int8)
_CLASS[[ord("{"), ord("[")]] = 1
_CLASS[[ord("}"), ord("]")]] = -1

RANGES = "file string, block long, seq long, data binary, exits array<int>, deltas array<long>, first int"
STATES = "file string, block long, seq long, state int, depth long, in_array boolean, trim boolean"
PARTS = "file string, block long, seq long, at long, border int, text binary"


def lex(data: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """Change of depth at each byte (zero inside strings), and a mask of the bytes outside strings in place of
    the bytes themselves; then the state behind the range."""
    n = len(data)
    index = np.arange(n)
    # Backslashes that stand right before a byte; a run that reaches the start goes on from the range before.
    last = np.maximum.accumulate(np.where(data == 0x5C, -1, index))
    run = index - last
    run[last < 0] += state == ESCAPED
    before = np.append(int(state == ESCAPED), run[:-1])
    quote = (data == 0x22) & (before % 2 == 0)
    turns = np.cumsum(quote)
    start = int(state != OUTSIDE)
    outside = ~quote & ((turns + start) % 2 == 0)
    if (int(turns[-1]) + start) % 2 == 0:
        return outside, OUTSIDE
    return outside, ESCAPED if run[-1] % 2 else STRING


def summary(data: np.ndarray) -> tuple[list[int], list[int]]:
    """For each state of entry: the state of exit and the change of depth."""
    exits, deltas = [], []
    for state in (OUTSIDE, STRING, ESCAPED):
        outside, end = lex(data, state)
        exits.append(end)
        deltas.append(int(_CLASS[data[outside]].sum(dtype=np.int64)))
    return exits, deltas


def cut(data: np.ndarray, state: int, depth: int, in_array: bool) -> list[tuple[int, int]]:
    """(start, end) of the parts of a range: what ends in it, what lies in it, what goes on behind it.

    Parts are the elements of the outermost array or, in a file that does not hold one, the outermost values.
    """
    outside, _ = lex(data, state)
    change = np.where(outside, _CLASS[data], 0).astype(np.int64)
    after = depth + np.cumsum(change)
    if in_array:
        comma = outside & (data == ord(",")) & (after == 1)
        begin = (change == 1) & (after == 1)
        end = (change == -1) & (after == 0)
        at = np.flatnonzero(comma | begin | end)
        return list(zip([0, *(at + 1).tolist()], [*at.tolist(), len(data)]))
    at = (np.flatnonzero((change == -1) & (after == 0)) + 1).tolist()
    return list(zip([0, *at], [*at, len(data)]))


def _ranges(spark: SparkSession, path: str, range_bytes: int) -> DataFrame:
    """The bytes of all files in written ranges, each with its lexer function."""
    text = spark.read.option("lineSep", "}").text(path)
    rows = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, seq, held, size = None, 0, [], 0

        def row():
            data = b"".join(held)
            exits, deltas = summary(np.frombuffer(data, np.uint8))
            start = data.lstrip(_SPACE)[:1]
            columns = [[place[0]], [place[1]], [seq], [data], [exits], [deltas], [start[0] if start else None]]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in RANGES.split(", ")])

        for batch in batches:
            for own, value in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), batch.column(2)):
                if held and (own != place or size >= range_bytes):
                    yield row()
                    seq = seq + 1 if own == place else 0
                    held, size = [], 0
                place = own
                held += [value.as_py(), b"}"]
                size += len(held[-2]) + 1
        if held:
            yield row()

    return written(rows.mapInArrow(gather, RANGES), "json-ranges")


def _entered(ranges: DataFrame) -> DataFrame:
    """The state and depth in which each range is entered: one small row per range, composed file by file."""

    def compose(part: pa.Table) -> pa.Table:
        part = part.sort_by([("block", "ascending"), ("seq", "ascending")])
        state, depth, kind, states, depths = OUTSIDE, 0, None, [], []
        for exits, deltas, first in zip(*(part.column(c).to_pylist() for c in ("exits", "deltas", "first"))):
            kind = first if kind is None else kind
            states.append(state)
            depths.append(depth)
            state, depth = exits[state], depth + deltas[state]
        n = part.num_rows
        # The reader does not say whether the last bytes of a file were followed by a brace. A document that closes once too often was not.
        trim = [False] * (n - 1) + [depth < 0]
        columns = [part.column(c) for c in ("file", "block", "seq")]
        more = [pa.array(states, pa.int32()), pa.array(depths, pa.int64()), pa.array([kind == ord("[")] * n), pa.array(trim)]
        return pa.table([*columns, *more], [f.split()[0] for f in STATES.split(", ")])

    return ranges.select("file", "block", "seq", "exits", "deltas", "first").groupBy("file").applyInArrow(compose, STATES)


def _parts(ranges: DataFrame, states: DataFrame) -> DataFrame:
    """Parts of all ranges. ``border``: null for an element that lies in a range, 0 for what ends an earlier one, 1 for what goes on."""
    keys = ["file", "block", "seq"]

    def run(key, own: pa.Table, entered: pa.Table) -> pa.Table:
        state = {c: entered.column(c)[0].as_py() for c in ("state", "depth", "in_array", "trim")}
        whole = own.column("data")[0].as_py()
        whole = whole[:-1] if state["trim"] else whole
        rows: list[tuple] = []
        if whole:
            spans = cut(np.frombuffer(whole, np.uint8), state["state"], state["depth"], state["in_array"])
            texts = [whole[a:b] for a, b in spans]
            inner = [t for t in texts[1:-1] if t.strip(_SPACE)]
            rows = [(0, 0, texts[0]), *((i, None, t) for i, t in enumerate(inner, 1))]
            if len(texts) > 1:
                rows.append((len(inner) + 1, 1, texts[-1]))
        columns = [list(c) for c in zip(*rows)] or [[], [], []]
        place = [pa.array([k.as_py()] * len(rows), t) for k, t in zip(key, (pa.string(), pa.int64(), pa.int64()))]
        kinds = (pa.int64(), pa.int32(), pa.binary())
        return pa.table([*place, *(pa.array(c, k) for c, k in zip(columns, kinds))], [f.split()[0] for f in PARTS.split(", ")])

    cut_up = ranges.select(*keys, "data").groupBy(*keys).cogroup(states.groupBy(*keys)).applyInArrow(run, PARTS)
    return written(cut_up, "json-parts")


def _elements(ranges: DataFrame) -> DataFrame:
    parts = _parts(ranges, _entered(ranges))
    inner = parts.filter(F.col("border").isNull()).select("file", "block", "seq", "at", "text")
    # Two rows per range: what a range leaves open goes on until the next range that leaves something open.
    borders = parts.filter(F.col("border").isNotNull())
    along = Window.partitionBy("file").orderBy("block", "seq", "border").rowsBetween(Window.unboundedPreceding, 0)
    numbered = borders.withColumn("_n", F.sum("border").over(along))
    pieces = F.sort_array(F.collect_list(F.struct("block", "seq", "border", "at", "text")))
    joined = numbered.groupBy("file", "_n").agg(pieces.alias("_p"))
    first, blank = F.col("_p")[0], r"^[ \t\r\n]*$"
    text = F.aggregate("_p", F.lit(b""), lambda whole, p: F.concat(whole, p["text"]))
    crossing = joined.select("file", first["block"].alias("block"), first["seq"].alias("seq"), first["at"].alias("at"), text.alias("text"))
    whole = inner.unionAll(crossing.filter(~F.regexp_like(F.col("text").cast("string"), F.lit(blank))))
    return whole.select("file", "block", "seq", "at", F.col("text").cast("string").alias("text"))


def json_elements(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``file, block, seq, at, text``: the text of every element of the outermost array, or of every outermost value, of each file.

    ``block, seq, at`` order a file's elements. Blank elements, as behind a last comma, are left out. A document that breaks off
    gives its last element as far as it goes.
    """
    return _elements(_ranges(spark, path, range_bytes))


def read_json_rows(spark: SparkSession, path: str, schema: T.StructType, row_idx: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows of files that hold one JSON array of objects, or objects one after the other, over any lines.

    The same rows as ``spark.read.json(path, multiLine=True)``, read by many tasks a file. An element that is no object, or is malformed, is a row of nulls.
    ``row_idx`` names a column for the dense position of a row, by file and place in it.
    """
    elements = json_elements(spark, path, range_bytes)
    parsed = F.from_json("text", schema).alias("_row")
    if row_idx is None:
        return elements.select(parsed).select("_row.*")
    keys = ["file", "block", "seq"]
    sizes = elements.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    # Added up inside each file, one row per range, and then across files.
    inside = Window.partitionBy("file").orderBy("block", "seq").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("_all").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = sizes.groupBy("file").agg(F.sum("_n").alias("_m")).withColumn("_all", F.lit(0))
    files = files.select("file", F.coalesce(F.sum("_m").over(across), F.lit(0)).alias("_across"))
    offsets = sizes.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(files, "file")
    offsets = offsets.select(*keys, (F.col("_inside") + F.col("_across")).alias("_offset"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("at")) - 1
    placed = elements.select(*keys, rank.alias("_rank"), parsed).join(offsets, keys)
    return placed.select("_row.*", (F.col("_offset") + F.col("_rank")).alias(row_idx))
