"""WARC archives: written as gzip members by Spark's own writer, read back past damage.

**Writing.** Every record is one gzip member with its own check sum; its header holds the digests of the
block and of the payload. Records whose payload is equal to that of a record with a smaller id, and not short,
become ``revisit`` records that name it. Spark's text writer commits the files, so archives can lie in any store
that Spark writes to, and a lost task leaves nothing behind. The writer ends each value with a separator; a
member is handed over without its last byte, the high byte of its length field, and the separator is that byte: zero, as
a member holds less than 16 MB. A longer record goes on in further members.

**Reading.** A record counts when its member unpacks with the right check sum, its header is whole, the block is as long as
stated and closed by two line ends, and its digests agree. Where a check fails the reader searches on, byte by byte, for
the next member or version line that begins a valid record; what lies between is one row, the quarantined gap, with its
place and the failed check. Plain archives and members may be mixed in a file.

* A null payload is empty. A null record id is written as ``null``, and read as null by :func:`read_pages`; it comes after all others when the smallest is
  sought. A null target is left out.
* Rows that repeat an id and a payload are written once each and all count as the first. Very long payloads make several members.
  An empty table gives an archive without records, which reads as no rows.
* Extra columns of the table are neither written nor in the way.
* Files are read whole, one after the other, in a task; the writer closes a file after :data:`FILE_BYTES`.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneframe.llm.registry import query, table
from tuneframe.session import run_folder

FILE_BYTES = 32 << 20
# Shorter payloads are written out every time.
LEAST_REVISIT = 100
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
PAGE = "urn:page:"

# Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"
CLOSE = b"\r\n\r\n"

# Below the 16 MB at which the last byte of a member's length is no longer zero.
MEMBER_BYTES = (1 << 24) - 1
# Longest header that is looked for.
HEADER_BYTES = 1 << 20

RECORDS = (
    "file string, start long, length long, type string, record_id string, target string, refers_to string, payload binary, "
    "payload_bytes long, payload_digest string, gap string"
)
_KINDS = [
    pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(),
    pa.int64(), pa.string(), pa.string(),
]
_NAMES = [f.split()[0] for f in RECORDS.split(", ")]


# ------------------------------------------------------------------ writing


def marked(records: DataFrame, record_id: str, payload: str, least: int = LEAST_REVISIT) -> DataFrame:
    """Add ``payload_bytes``, ``payload_digest`` and ``first_id``: the smallest id with an equal payload of at least ``least`` bytes
    where that is another row's, else null.

    Ids per digest are reduced before the shuffle, and only digests that repeat come back; AQE splits a hot one.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    known = records.withColumns({"_w_bytes": F.octet_length(body).cast("long"), "_w_digest": F.sha2(body, 256)})
    # Null ids after all others: a group of null ids only has no smallest id and no revisits.
    groups = (
        known.filter(F.col("_w_bytes") >= least)
        .groupBy(F.col("_w_digest").alias("_w_key"))
        .agg(F.min(record_id).alias("_w_first"), F.count(F.lit(1)).alias("_w_n"))
        .filter((F.col("_w_n") > 1) & F.col("_w_first").isNotNull())
        .drop("_w_n")
    )
    found = known.join(groups, known["_w_digest"] == groups["_w_key"], "left")
    other = F.when(~F.col(record_id).eqNullSafe(F.col("_w_first")), F.col("_w_first"))
    return found.select(
        *records.columns, F.col("_w_bytes").alias("payload_bytes"), F.col("_w_digest").alias("payload_digest"), other.alias("first_id")
    )


def _line_safe(text: str) -> str:
    """A header value without white space, line ends or control characters."""
    return re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", text)


def record_bytes(record_id: str, target: str | None, payload: bytes, digest: str, first_id: str | None, date: str = DATE) -> bytes:
    """One record: an HTTP response, or a revisit with the response's head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if first_id is not None else head + payload
    lines = [
        f"WARC-Type: {'response' if first_id is None else 'revisit'}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {date}",
    ]
    if target is not None:
        lines.append(f"WARC-Target-URI: {_line_safe(target)}")
    if first_id is not None:
        lines += [f"WARC-Refers-To: <{first_id}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += [
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"Content-Length: {len(block)}",
    ]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + CLOSE + block + CLOSE


def members(data: bytes, level: int = LEVEL) -> bytes:
    """The gzip members of one record; the last byte is zero."""
    out = []
    for at in range(0, len(data), MEMBER_BYTES):
        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
        out += [packer.compress(data[at : at + MEMBER_BYTES]), packer.flush()]
    return b"".join(out)


def write_warc(
    records: DataFrame, path: str, record_id: Column, target: Column, payload: Column, digest: Column, first_id: Column,
    date: str = DATE, compress: bool = True, file_bytes: int = FILE_BYTES,
) -> None:
    """Write archives under ``path``, as gzip members or (``compress=False``) as plain records.

    ``record_id`` and ``first_id`` are URIs; a record with a ``first_id`` is a revisit of it. A task begins a new file after
    ``file_bytes``.
    """
    rows = records.select(
        record_id.alias("i"), target.alias("t"), F.coalesce(payload.cast("binary"), F.lit(b"")).alias("p"), digest.alias("d"), first_id.alias("f")
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 0
        for batch in batches:
            values, files, held = [], [], 0
            for at in range(batch.num_rows):
                data = record_bytes(*(column[at].as_py() for column in batch.columns), date)
                # The separator that Spark writes supplies what is cut off here.
                value = members(data)[:-1] if compress else data[: -len(CLOSE)]
                values.append(value)
                files.append(size // file_bytes)
                size += len(value) + 1
                held += len(value)
                if held > file_bytes or at + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(values, pa.binary()), pa.array(files, pa.int64())], ["value", "file"])
                    values, files, held = [], [], 0

    # The cast keeps the bytes as they are; they are text to the writer only.
    encoded = rows.mapInArrow(encode, "value binary, file long").select(F.col("value").cast("string").alias("value"), "file")
    encoded.write.option("lineSep", "\0" if compress else CLOSE.decode()).partitionBy("file").text(path)


# ------------------------------------------------------------------ reading


class Damage(Exception):
    """A check that a record failed."""


CUT = ("block ends early", "block is not closed", "header does not end")


def unpack(data: bytes, start: int) -> tuple[bytes, int]:
    """Content of the gzip member at ``start`` and where it ends."""
    reader = zlib.decompressobj(31)
    out = []
    at = start
    while not reader.eof:
        piece = data[at : at + (1 << 16)]
        if not piece:
            raise Damage("member ends early")
        try:
            out.append(reader.decompress(piece))
        except zlib.error as error:
            raise Damage("member does not unpack") from error
        at += len(piece)
    return b"".join(out), at - len(reader.unused_data)


_URI = re.compile(r"<[^<>\s]+>")
_VERSION_LINE = re.compile(rb"WARC/\d+\.\d+\r\n")


def _headers(data: bytes, start: int) -> tuple[dict[str, str], int]:
    """Header fields of the record at ``start`` and where its block begins."""
    line = _VERSION_LINE.match(data, start)
    if line is None:
        raise Damage("no version line")
    end = data.find(CLOSE, line.end() - 2, start + HEADER_BYTES)
    if end < 0:
        raise Damage("header does not end")
    fields = {}
    for part in data[line.end() : end].split(b"\r\n"):
        name, colon, value = part.partition(b":")
        if not colon:
            raise Damage("header line without a name")
        try:
            fields[name.strip().decode().lower()] = value.strip().decode()
        except UnicodeDecodeError as error:
            raise Damage("header is not text") from error
    if not fields.get("content-length", "").isascii() or not fields.get("content-length", "").isdigit():
        raise Damage("no content length")
    if not fields.get("warc-type") or not _URI.fullmatch(fields.get("warc-record-id", "")):
        raise Damage("no type or record id")
    return fields, end + len(CLOSE)


def _digest_ok(stated: str | None, data: bytes) -> bool:
    """Whether a stated digest agrees; one of another kind than those known here is not checked."""
    kind, _, value = (stated or "").partition(":")
    return kind.lower() != "sha256" or value.lower() == hashlib.sha256(data).hexdigest()


def parse_record(data: bytes, start: int) -> tuple[dict, int]:
    """The record at ``start`` of unpacked bytes and where it ends."""
    fields, begin = _headers(data, start)
    end = begin + int(fields["content-length"])
    if end > len(data):
        raise Damage("block ends early")
    if data[end : end + len(CLOSE)] != CLOSE:
        raise Damage("block is not closed")
    block = data[begin:end]
    if not _digest_ok(fields.get("warc-block-digest"), block):
        raise Damage("block digest differs")
    kind, payload, size = fields["warc-type"], block, len(block)
    if fields.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(CLOSE)
        size = len(payload)
        if kind == "revisit":
            stated = re.search(rb"(?i)^content-length:\s*(\d+)\s*$", head, re.MULTILINE)
            size = int(stated[1]) if stated else size
    if kind != "revisit" and not _digest_ok(fields.get("warc-payload-digest"), payload):
        raise Damage("payload digest differs")
    algorithm, _, digest = fields.get("warc-payload-digest", "").partition(":")
    digest = digest if algorithm.lower() == "sha256" else None if kind == "revisit" else hashlib.sha256(payload).hexdigest()
    own = {
        "type": kind,
        "record_id": fields["warc-record-id"].strip("<>"),
        "target": fields.get("warc-target-uri"),
        "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
        "payload": None if kind == "revisit" else payload,
        "payload_bytes": size,
        "payload_digest": digest,
    }
    return own, end + len(CLOSE)


def _member_records(data: bytes, start: int) -> tuple[list[tuple[dict | None, str | None]], int]:
    """(record, None) or (None, failed check) for what the member at ``start`` holds, with the members that go on with its last record."""
    content, end = unpack(data, start)
    found: list[tuple[dict | None, str | None]] = []
    at, lost = 0, False
    while at < len(content):
        try:
            own, at = parse_record(content, at)
            found.append((own, None))
            lost = False
        except Damage as damage:
            # Only a record that is cut off can go on in the next member.
            if str(damage) in CUT and (longer := _continued(data, end, content, at)):
                content, end = longer
                continue
            if not lost:
                found.append((None, f"{damage}, in a member"))
                lost = True
            following = _VERSION_LINE.search(content, at + 1)
            at = following.start() if following else len(content)
    if all(own is None for own, _ in found):
        raise Damage(found[0][1] if found else "member without a record")
    return found, end


def _continued(data: bytes, end: int, content: bytes, at: int) -> tuple[bytes, int] | None:
    """``content`` with as many of the members from ``end`` on as its last record lacks; None if they don't go on with it."""
    pieces, begin, missing = [content], end, _missing(content, at)
    while missing > 0 and data.startswith(MAGIC, begin):
        try:
            piece, begin = unpack(data, begin)
        except Damage:
            return None
        if _VERSION_LINE.match(piece):
            return None
        pieces.append(piece)
        missing -= len(piece)
    return (b"".join(pieces), begin) if len(pieces) > 1 and missing <= 0 else None


def _missing(content: bytes, at: int) -> int:
    """Bytes that the record at ``at`` lacks by its own statement; one when its header is cut."""
    try:
        fields, begin = _headers(content, at)
    except Damage:
        return 1
    return begin + int(fields["content-length"]) + len(CLOSE) - len(content)


_BEGIN = re.compile(rb"\x1f\x8b\x08|WARC/\d")


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | None, str | None]]:
    """(start, length, record, None) of every valid record and (start, length, None, failed check) of every gap between them.

    Damage inside a sound member has the member's place.
    """
    at, lost, why = 0, -1, ""
    while at < len(data):
        try:
            if data.startswith(MAGIC, at):
                found, end = _member_records(data, at)
            elif data.startswith(b"WARC/", at):
                own, end = parse_record(data, at)
                found = [(own, None)]
            else:
                raise Damage("no member or version line")
        except Damage as damage:
            if lost < 0:
                lost, why = at, str(damage)
            following = _BEGIN.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if lost >= 0:
            yield lost, at - lost, None, why
            lost = -1
        for own, failed in found:
            yield at, end - at, own, failed
        at = end
    if lost >= 0:
        yield lost, len(data) - lost, None, why


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record (``gap`` null) and per quarantined gap (``gap`` names the failed check): columns :data:`RECORDS`.

    ``start`` and ``length`` are bytes of the stored file; a revisit's ``payload`` is null, ``payload_bytes`` and
    ``payload_digest`` are those of the full payload.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, rows, held = batch.column(0)[i].as_py(), [], 0
                for start, length, own, gap in salvage(batch.column(1)[i].as_py()):
                    own = own or {}
                    rows.append((name, start, length, *(own.get(c) for c in _NAMES[3:-1]), gap))
                    held += len(own.get("payload") or b"")
                    if held > FILE_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return files.mapInArrow(read, RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], _NAMES)


def orphans(rows: DataFrame) -> DataFrame:
    """Revisits whose first record is not among the records that could be read."""
    kept = rows.filter(F.col("gap").isNull())
    whole = kept.filter(F.col("type") != "revisit").select(F.col("record_id").alias("refers_to"))
    return kept.filter(F.col("type") == "revisit").join(whole, "refers_to", "left_anti")


# ------------------------------------------------------------------ pages


def archive_pages(pages: DataFrame, path: str, **options) -> None:
    """Archive ``page_id, url, html``."""
    rows = marked(pages.select("page_id", "url", "html"), "page_id", "html")

    def uri(column):
        return F.concat(F.lit(PAGE), F.coalesce(F.col(column).cast("string"), F.lit("null")))

    first = F.when(F.col("first_id").isNotNull(), uri("first_id"))
    write_warc(rows, path, uri("page_id"), F.col("url"), F.col("html"), F.col("payload_digest"), first, **options)


def read_pages(rows: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of the page records that :func:`read_warc` gives."""

    def number(column):
        return F.substring(column, len(PAGE) + 1, 20).try_cast("long")

    return rows.filter(F.col("gap").isNull() & F.col("record_id").startswith(PAGE)).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), number("refers_to").alias("refers_to")
    )


@query(
    "op13_warc",
    """
    WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p),
    r AS (SELECT *, payload_bytes >= 100 AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id AS again FROM g)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN again THEN first_id END AS refers_to FROM r
    """,
)
def op13(spark, folder):
    path = run_folder(spark, "warc")
    archive_pages(table(spark, folder, "pages"), path)
    return read_pages(read_warc(spark, path))
