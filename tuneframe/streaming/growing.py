"""Lines of files that are still being written, as a streaming source.

Spark's own file source takes a file once, when it first sees it. A log that a running job appends to is read here by byte offsets: the
stream's offset says for each file how far it was read, and a batch is the complete lines from there to the last line end at that moment. A line
without its end yet is held back. Offsets are part of the checkpoint, so a restart goes on where the last committed batch
ended, and a replayed batch reads the same bytes.

Register with ``spark.dataSource.register(GrowingLines)`` and read with ``format("growing_lines")``. Options:

* ``path``: a folder, searched through, or a file; any store that Arrow's file systems reach from driver and executors.
* ``suffix``: only files whose name ends so.
* ``partBytes``: new bytes of a file that one task reads; a task reads the lines that begin in its part.

Columns: ``path`` of the file, ``start`` (byte offset of the line), ``value``. Line ends are ``\\n``, with or without ``\\r``. Bytes
that are no UTF-8 are replaced. A file that became shorter was written anew and is read from its start; its old lines
were read before. A vanished file ends. Offsets hold one entry per file, so move finished runs away now and then.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, start bigint, value string"
PART_BYTES = 64 << 20
_TAIL = 1 << 16
_READ = 1 << 22
_BATCH_LINES = 1 << 14


@dataclass
class Part(InputPartition):
    """Lines of a file that begin in ``[start, end)``; ``first`` where the file's new bytes begin and ``last`` where they end."""

    path: str
    first: int
    start: int
    end: int
    last: int


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def last_line_end(stream, size: int, floor: int) -> int:
    """Offset behind the last line end before ``size``, or ``floor`` if there is none behind it."""
    end = size
    while end > floor:
        begin = max(floor, end - _TAIL)
        stream.seek(begin)
        at = stream.read(end - begin).rfind(b"\n")
        if at >= 0:
            return begin + at + 1
        end = begin
    return floor


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options):
        self.store, self.root = _open(options["path"])
        self.suffix = options.get("suffix", "")
        self.part_bytes = int(options.get("partBytes", PART_BYTES))
        # Only spares looking at old bytes again; what counts are the offsets that Spark keeps.
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        found = self.store.get_file_info(self.root)
        infos = [found] if found.type == fs.FileType.File else self.store.get_file_info(fs.FileSelector(self.root, recursive=True, allow_not_found=True))
        ends = {}
        for info in infos:
            if info.type != fs.FileType.File or not info.base_name.endswith(self.suffix):
                continue
            floor = self.known.get(info.path, 0)
            floor = floor if floor <= info.size else 0
            with self.store.open_input_file(info.path) as stream:
                end = last_line_end(stream, info.size, floor)
            if end:
                ends[info.path] = end
        self.known = ends
        return {"files": json.dumps(ends, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        out = []
        for path, last in sorted(after.items()):
            first = before.get(path, 0)
            first = first if first <= last else 0
            out += [Part(path, first, at, min(at + self.part_bytes, last), last) for at in range(first, last, self.part_bytes)]
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        with self.store.open_input_file(partition.path) as stream:
            for starts, lines in _batches(_lines(stream, partition)):
                columns = [pa.array([partition.path] * len(lines)), pa.array(starts, pa.int64()), pa.array(lines, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["path", "start", "value"])

    def commit(self, end: dict) -> None:
        pass


def _lines(stream, part: Part) -> Iterator[tuple[int, str]]:
    """(offset, line) of the lines that begin in the part."""
    # A line belongs where it begins: unless the byte before is a line end, the first bytes are another part's.
    skip = part.start > part.first
    at = part.start - 1 if skip else part.start
    begin, rest = at, b""
    stream.seek(at)
    while begin < part.end and at < part.last:
        data = stream.read(min(_READ, part.last - at))
        if not data:
            return
        at += len(data)
        *lines, rest = (rest + data).split(b"\n")
        for line in lines:
            if skip:
                skip = False
            elif begin < part.end:
                yield begin, line.removesuffix(b"\r").decode(errors="replace")
            begin += len(line) + 1


def _batches(lines: Iterator[tuple[int, str]]) -> Iterator[tuple[list[int], list[str]]]:
    starts: list[int] = []
    texts: list[str] = []
    for start, text in lines:
        starts.append(start)
        texts.append(text)
        if len(texts) >= _BATCH_LINES:
            yield starts, texts
            starts, texts = [], []
    if texts:
        yield starts, texts


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(self.options)
