"""Leakage audit: does a prompt give its own answer away, and does training text hold
passages of an evaluation set?"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuneframe.constants import LEAK_MARKERS, LEAK_REPORT_IDS
from tuneframe.functions.text import contains_line_block, let, non_empty_lines, strip
from tuneframe.operators.ordering import smallest_ids
from tuneframe.session import written

DETECTORS = ["completion_block", "teacher_equal", "marker"]
DETECTOR_TEXT = {
    "completion_block": "the prompt contains its own completion in rows",
    "teacher_equal": "the teacher prompt was used as prompt in rows",
    "marker": "a teacher marker stands in the prompt of rows",
}


def marker_leak(prompt: Column) -> Column:
    lowered = F.lower(prompt)
    hit = F.lit(False)
    for marker in LEAK_MARKERS:
        hit = hit | F.contains(lowered, F.lit(marker))
    return hit


def completion_block_leak(prompt: Column, completion: Column) -> Column:
    """The completion's non-empty lines stand as one block in the prompt."""
    return contains_line_block(prompt, completion)


def teacher_equal_leak(prompt: Column, teacher_prompt: Column) -> Column:
    """The stripped teacher prompt equals the prompt as it stands."""
    teacher = strip(teacher_prompt)
    return F.coalesce((teacher != "") & (teacher == prompt), F.lit(False))


def flag_leaks(rows: DataFrame) -> DataFrame:
    """Add one boolean column per detector. Narrow: no shuffle. Detectors whose column the
    table lacks never fire."""
    prompt = F.coalesce(F.col("prompt").cast("string"), F.lit(""))
    flags = {"marker": marker_leak(prompt)}
    if "completion" in rows.columns:
        flags["completion_block"] = completion_block_leak(prompt, F.col("completion"))
    if "teacher_prompt" in rows.columns:
        flags["teacher_equal"] = teacher_equal_leak(prompt, F.col("teacher_prompt"))
    return rows.withColumns({name: flags.get(name, F.lit(False)) for name in DETECTORS})


def leak_hits(rows: DataFrame, row_id: str) -> DataFrame:
    """One row per (detector, row) that fires.

    Misses are dropped after the explode: a filter on the array would look through every
    text a second time.
    """
    names = F.array(*[F.when(F.col(name), F.lit(name)) for name in DETECTORS])
    hits = flag_leaks(rows).select(row_id, F.explode(names).alias("detector"))
    return hits.where(F.col("detector").isNotNull())


def leak_report(rows: DataFrame, row_id: str, first: int = LEAK_REPORT_IDS) -> DataFrame:
    """Per detector that fires: number of rows and the first ids, in one pass over the text."""
    return smallest_ids(leak_hits(rows, row_id), ["detector"], row_id, first)


def leak_top10(rows: DataFrame, row_id: str) -> DataFrame:
    """The first ten offending ids of each detector, one per row with their rank."""
    report = leak_report(rows, row_id)
    return report.select("detector", F.posexplode("first_ids").alias("rank", row_id))


def assert_no_leaks(rows: DataFrame, row_id: str) -> None:
    """Raise with the counts and first ids when any detector fires."""
    found = {row["detector"]: row["first_ids"] for row in leak_report(rows, row_id).collect()}
    if found:
        details = [f"{DETECTOR_TEXT[name]} {found[name]}" for name in DETECTORS if name in found]
        raise ValueError("leakage in evaluation rows: " + "; ".join(details))


# ------------------------------------------------------------------ across tables


BLOCK = ["block_a", "block_b"]
LINE = ["line_a", "line_b"]
# Lines of passages that a task holds, and lines of documents that it tries them on.
PART_LINES = 1 << 18
GROUP_LINES = 1 << 19


def _block_key(lines: Column) -> Column:
    """96 bits that stand for a block of lines."""
    return F.struct(F.xxhash64(lines).alias(BLOCK[0]), F.hash(lines).alias(BLOCK[1]))


def _line_keys(lines: Column) -> Column:
    return F.transform(lines, lambda line: F.struct(F.xxhash64(line).alias(LINE[0]), F.hash(line).alias(LINE[1])))


def passage_blocks(passages: DataFrame, passage_id: str, text: str = "text") -> DataFrame:
    """``passage_id, n_lines, line_keys, block_a, block_b`` of every passage with at least one line."""
    sized = let(
        non_empty_lines(F.col(text)),
        lambda lines: F.struct(F.size(lines).alias("n_lines"), _line_keys(lines).alias("line_keys"), _block_key(lines).alias("key")),
    )
    return (
        passages.select(passage_id, sized.alias("_sized"))
        .where(F.col("_sized.n_lines") > 0)
        .select(passage_id, "_sized.n_lines", "_sized.line_keys", "_sized.key.*")
    )


def block_hits(documents: DataFrame, blocks: DataFrame, doc_id: str, text: str = "text") -> DataFrame:
    """``doc_id, block_a, block_b`` for every distinct passage block that stands in a document.

    Each line is hashed once, and only lines that some passage has go on, to the tasks that hold passages with that line. There a
    document is the set of positions of each of its lines, as one number with a bit per position. A passage stands in it where the
    numbers of its lines, each shifted by its place in the passage, have a bit in common. Passages are tried at a document that has all
    their lines only. So the work follows the lines and the hits, also when passages and documents consist of the same
    boilerplate lines over and over; neither pairs nor starts are ever listed.

    Passages are dealt over parts of :data:`PART_LINES` lines and a part's documents over groups of :data:`GROUP_LINES`; passages with
    equal lines count as one block. Rows with equal ids are documents of their own and give an id once.
    """
    distinct = blocks.select(*BLOCK, "n_lines", "line_keys").dropDuplicates(BLOCK)
    n_lines = distinct.agg(F.sum("n_lines")).first()[0] or 0
    part = F.pmod(F.col(BLOCK[0]), F.lit(max(1, -(-n_lines // PART_LINES))).cast("bigint")).alias("_part")
    members = written(distinct.select(part, *BLOCK, F.posexplode("line_keys").alias("_off", "_k")).select("_part", *BLOCK, "_off", "_k.*"), "passage-lines")
    rows = documents.select(F.monotonically_increasing_id().alias("_row"), doc_id, text)
    rows = rows.select("_row", doc_id, F.posexplode(_line_keys(non_empty_lines(F.col(text)))).alias("_pos", "_k"))
    wanted = members.select("_part", *LINE).distinct()
    found = written(rows.select("_row", doc_id, "_pos", "_k.*").join(wanted, LINE), "found-lines")
    groups = max(1, -(-found.count() // GROUP_LINES))
    own = found.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups).cast("bigint")))
    every = members.withColumn("_group", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))))
    kind = documents.schema[doc_id].dataType.simpleString()
    hits = own.groupBy("_part", "_group").cogroup(every.groupBy("_part", "_group")).applyInArrow(_hits(doc_id), f"`{doc_id}` {kind}, {BLOCK[0]} bigint, {BLOCK[1]} int")
    return hits.distinct()


def _hits(doc_id: str):
    def codes(*tables: pa.Table) -> np.ndarray:
        """Small numbers for the line keys of all tables, one after the other."""
        high, low = (np.concatenate([t.column(c).to_numpy() for t in tables]) for c in LINE)
        first = np.unique(high, return_inverse=True)[1].astype(np.int64)
        return np.unique((first << 32) | (low.astype(np.int64) & 0xFFFFFFFF), return_inverse=True)[1]

    def cuts(*columns: np.ndarray) -> list[tuple[int, int]]:
        """(start, end) of the runs of equal rows."""
        n = len(columns[0])
        if not n:
            return []
        new = np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0))
        starts = np.flatnonzero(new).tolist()
        return list(zip(starts, [*starts[1:], n]))

    def run(key, lines: pa.Table, members: pa.Table) -> pa.Table:
        lines = lines.sort_by([("_row", "ascending"), ("_pos", "ascending")])
        members = members.sort_by([*((c, "ascending") for c in BLOCK), ("_off", "ascending")])
        out: list[tuple[int, int, int]] = []
        if lines.num_rows and members.num_rows:
            code = codes(lines, members)
            own, theirs = code[: lines.num_rows], code[lines.num_rows :]
            frequency = np.bincount(own, minlength=int(code.max()) + 1)
            names = [members.column(c).to_numpy() for c in BLOCK]
            # A passage is looked up under its rarest line.
            passages: dict[int, list] = {}
            for start, end in cuts(*names):
                parts = theirs[start:end]
                rarest = int(parts[np.argmin(frequency[parts])])
                if frequency[rarest]:
                    passages.setdefault(rarest, []).append((parts.tolist(), set(parts.tolist()), int(names[0][start]), int(names[1][start])))
            position = lines.column("_pos").to_numpy()
            for start, end in cuts(lines.column("_row").to_numpy()):
                here, at = own[start:end], position[start:end]
                known = set(here.tolist())
                bits: dict[int, int] = {}
                for rarest in known & passages.keys():
                    for parts, needed, block_a, block_b in passages[rarest]:
                        if needed <= known and _stands(parts, here, at, bits):
                            out.append((start, block_a, block_b))
        starts, block_a, block_b = zip(*out) if out else ((), (), ())
        ids = lines.column(doc_id).take(pa.array(starts, pa.int64()))
        return pa.table([ids, pa.array(block_a, pa.int64()), pa.array(block_b, pa.int32())], [doc_id, *BLOCK])

    return run


def _stands(parts: list[int], lines: np.ndarray, at: np.ndarray, bits: dict[int, int]) -> bool:
    """Whether the lines ``parts`` follow each other somewhere; ``bits`` keeps the positions of each line of the document."""
    found = -1
    for i, line in enumerate(parts):
        if line not in bits:
            places = np.zeros(int(at[-1]) + 1, np.uint8)
            places[at[lines == line]] = 1
            bits[line] = int.from_bytes(np.packbits(places, bitorder="little").tobytes(), "little")
        found &= bits[line] >> i
        if not found:
            return False
    return True


def leak_cross(
    documents: DataFrame,
    passages: DataFrame,
    doc_id: str = "doc_id",
    passage_id: str = "item_id",
    first: int = LEAK_REPORT_IDS,
) -> DataFrame:
    """Per leaked passage: the number of documents that hold it as a block of lines, and the
    first document ids. Pairs are never listed, so copies on either side stay linear."""
    blocks = written(passage_blocks(passages, passage_id), "passage-blocks")
    per_block = smallest_ids(block_hits(documents, blocks, doc_id), BLOCK, doc_id, first)
    return blocks.join(per_block, BLOCK).select(
        passage_id, "n_lines", F.col("n").alias("n_docs"), F.col("first_ids").alias("first_docs")
    )


def leak_cross_documents(
    documents: DataFrame, passages: DataFrame, doc_id: str = "doc_id", passage_id: str = "item_id"
) -> DataFrame:
    """Per leaking document: the number of distinct passage blocks in it."""
    hits = block_hits(documents, passage_blocks(passages, passage_id), doc_id)
    return hits.groupBy(doc_id).agg(F.count(F.lit(1)).alias("n_blocks"))
