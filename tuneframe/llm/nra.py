"""Ranked lexical search without random access (NRA) over an impact-sorted index.

**Index.** A first scan counts documents and terms of the whole table. A second one cuts the documents, as they come, into
shards of a bounded number of terms and writes for each term of a shard the documents that hold it in falling order of
impact, the part of the score that does not depend on the term's weight. Nothing is left out: the index holds every term
of every document. Document frequencies are the summed lengths of the lists.

**Search.** Only the lists of the asked terms leave the index, and meet by shard. For each query a shard's lists are read
from the front, a block of each at a time. A document's score is at least what was seen of it, and at most that plus the next
impact of each list in which it was not seen. Documents whose upper limit is below the k-th lower limit are out. Reading
goes on, in those lists only that an open document still needs, until every remaining interval is closed: then
membership, ties and scores are final. No list is ever looked up by document. A shard's k best go on to the ranking
of all shards.

Scores are integers: a term's weight is ``floor(1000 * ln((2 N + 2) / (2 df + 1)))``, its impact
``10^9 tf div (1000 tf + 12 m)`` with ``m = 75 + 25 n N div L``, summed over the query's terms with their repeats.

* A term is a longest run of ASCII letters, digits and characters beyond ASCII; A-Z are lower-cased. A null or empty text has none; it
  is no result, and as a query it has none. Very long texts are split in blocks, and are a shard of their own.
* Equal scores stand by ascending id, a null id last. Every row is a document of its own, also when its id repeats. Repeated
  queries are answered each. Empty tables give no rows.
* Extra columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tuneframe.llm.registry import query, table
from tuneframe.session import written

# A shard is closed when it has as many terms or documents.
SHARD_TERMS = 1 << 22
SHARD_DOCUMENTS = 1 << 14
# Entries of a list that are read at first; later reads are twice as long each.
READ = 512
# Query terms that are searched for together.
QUERY_TERMS = 1 << 16
BLOCK = 1 << 20

INDEX = "shard long, term binary, size long, docs binary, impacts binary, ids array<long>"
_INDEX_KINDS = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
_INDEX_NAMES = [f.split()[0] for f in INDEX.split(", ")]
_TERM = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()


def terms(text: bytes | None) -> Iterator[list[bytes]]:
    """Terms of a text in order, in blocks of about a million bytes."""
    plain = (text or b"").translate(_TERM)
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + BLOCK)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def totals(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all terms."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [sum(map(len, terms(text.as_py()))) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([sum(n > 0 for n in sizes)], pa.int64()), pa.array([sum(sizes)], pa.int64())], ["held", "size"])

    row = docs.select(F.col("text").cast("binary")).mapInArrow(measure, "held long, size long").agg(F.sum("held"), F.sum("size")).first()
    return row[0] or 0, row[1] or 0


class Shard:
    """Documents and term counts of a shard in the making."""

    def __init__(self, held: int, size: int):
        self.held, self.size = held, size
        self.clear()

    def clear(self) -> None:
        self.vocabulary: dict[bytes, int] = defaultdict(count().__next__)
        self.ids: list[int | None] = []
        self.spread: list[int] = []
        self.entries: list[tuple[np.ndarray, np.ndarray]] = []
        self.terms = 0

    def add(self, doc_id: int | None, text: bytes | None) -> None:
        number, parts = self.vocabulary.__getitem__, []
        for block in terms(text):
            own = np.fromiter(map(number, block), np.int32, len(block))
            parts.append(np.unique(own, return_counts=True))
        n = int(sum(c.sum() for _, c in parts))
        if n == 0:
            return
        if len(parts) > 1:
            own, at = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
            found = (own, np.bincount(at, np.concatenate([c for _, c in parts])).astype(np.int64))
        else:
            found = parts[0]
        self.entries.append(found)
        self.ids.append(doc_id)
        self.spread.append(100 - 25 + (25 * n * self.held) // self.size)
        self.terms += n

    def full(self) -> bool:
        return self.terms >= SHARD_TERMS or len(self.ids) >= SHARD_DOCUMENTS

    def rows(self, shard: int) -> pa.RecordBatch:
        """A row for each term, its list in falling order of impact, and one of the documents' ids."""
        term = np.concatenate([t for t, _ in self.entries])
        tf = np.concatenate([c for _, c in self.entries]).astype(np.int64)
        doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), [len(t) for t, _ in self.entries])
        impact = (10**9 * tf) // (1000 * tf + 12 * np.array(self.spread, np.int64)[doc])
        order = np.lexsort((doc, -impact, term))
        sizes = np.bincount(term, minlength=len(self.vocabulary))
        ends = np.concatenate(([0], np.cumsum(sizes)))

        def lists(values: np.ndarray) -> list[bytes | None]:
            flat = values[order].astype(np.int32).tobytes()
            return [flat[4 * a : 4 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())] + [None]

        columns = [
            [shard] * (len(sizes) + 1), [*self.vocabulary, None], [*sizes.tolist(), len(self.ids)],
            lists(doc), lists(impact), [None] * len(sizes) + [self.ids],
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _INDEX_KINDS)], _INDEX_NAMES)


class Index:
    """The written index of a table with columns ``doc_id, text``."""

    def __init__(self, docs: DataFrame):
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
        held, size = totals(docs)
        self.held, self.size = held, size

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, serial = TaskContext.get().partitionId() << 32, count()
            shard = Shard(held, size)
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    shard.add(doc_id, text.as_py())
                    if shard.full():
                        yield shard.rows(first + next(serial))
                        shard.clear()
            if shard.ids:
                yield shard.rows(first + next(serial))

        self.rows = written(docs.mapInArrow(build, INDEX), "impact-index")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """``item_id, rank, doc_id, score`` of the ``k`` best documents of each row of ``queries`` (item_id, text)."""
        spark = queries.sparkSession
        asked = written(queries.select(F.monotonically_increasing_id().alias("item"), "item_id", F.col("text").cast("binary").alias("text")), "nra-queries")
        weighted = written(self._weighted(asked), "nra-terms")
        blocks = max(1, -(-weighted.count() // QUERY_TERMS))
        best = None
        for block in range(blocks):
            own = weighted.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
            # Bounded by the size of a block.
            rows = [(r["item"], bytes(r["term"]), r["weight"]) for r in own.select("item", "term", "weight").collect()]
            found = self._found(spark, rows, k)
            best = found if best is None else best.unionAll(found)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        return asked.select("item", "item_id").join(ranked, "item").select("item_id", "rank", "doc_id", "score")

    def _weighted(self, asked: DataFrame) -> DataFrame:
        """``item, term, weight``: the term's weight times its occurrences in the query. Terms that no document holds have no lists."""

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for item, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    held: Counter = Counter()
                    for block in terms(text.as_py()):
                        held.update(block)
                    columns = [pa.array([item] * len(held), pa.int64()), pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["item", "term", "times"])

        wanted = asked.select("item", "text").mapInArrow(split, "item long, term binary, times long")
        frequency = self.rows.filter(F.col("term").isNotNull()).join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("size").alias("df"))
        above, below = F.lit(2 * self.held + 2).cast("double"), (2 * F.col("df") + 1).cast("double")
        weight = F.floor(1000 * F.log(above / below)).cast("long") * F.col("times")
        return wanted.join(frequency, "term").select("item", "term", weight.alias("weight")).filter("weight > 0")

    def _found(self, spark, rows: list[tuple[int, bytes, int]], k: int) -> DataFrame:
        """``item, doc_id, score`` of the k best of each shard."""
        numbers = {term: i for i, term in enumerate(dict.fromkeys(term for _, term, _ in rows))}
        wanted = spark.createDataFrame([(bytearray(t), i) for t, i in numbers.items()], "term binary, number int")
        lists = self.rows.filter(F.col("term").isNotNull()).join(wanted, "term").select("shard", "number", "docs", "impacts", "ids")
        heads = self.rows.filter(F.col("term").isNull()).select("shard", F.lit(None).cast("int").alias("number"), "docs", "impacts", "ids")
        queries: dict[int, list[tuple[int, int]]] = {}
        for item, term, weight in rows:
            queries.setdefault(item, []).append((numbers[term], weight))

        def search(part: pa.Table) -> pa.Table:
            held, ids = {}, []
            for number, docs, impacts, own in zip(*(part.column(c).to_pylist() for c in ("number", "docs", "impacts", "ids"))):
                if number is None:
                    ids = own
                else:
                    held[number] = (np.frombuffer(docs, np.int32), np.frombuffer(impacts, np.int32).astype(np.int64))
            place = np.empty(len(ids), np.int64)
            place[sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))] = np.arange(len(ids))
            out: list[tuple] = []
            for item, wants in queries.items():
                own = [(*held[number], weight) for number, weight in wants if number in held]
                if own:
                    out += [(item, ids[doc], score) for doc, score in nra(own, place, k)]
            columns = list(zip(*out)) or [(), (), ()]
            return pa.table([pa.array(c, pa.int64()) for c in columns], ["item", "doc_id", "score"])

        return lists.unionAll(heads).groupBy("shard").applyInArrow(search, "item long, doc_id long, score long")


def nra(lists: list[tuple[np.ndarray, np.ndarray, int]], place: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The ``k`` best (document, score), best first; ties by ``place``.

    ``lists`` holds documents and impacts in falling order of impact, and the weight of each list.
    """
    low = np.zeros(len(place), np.int64)
    seen = np.zeros((len(lists), len(place)), bool)
    at = [0] * len(lists)
    # The most that a list can still add to a document that was not seen in it.
    front = np.array([weight * int(impacts[0]) for _, impacts, weight in lists], np.int64)
    needed = np.ones(len(lists), bool)
    # Open documents; at first, and while an unseen one may still be among the best, all.
    alive = np.arange(len(place))
    read = READ
    while needed.any():
        for i in np.flatnonzero(needed).tolist():
            docs, impacts, weight = lists[i]
            part = docs[at[i] : at[i] + read]
            low[part] += weight * impacts[at[i] : at[i] + read]
            seen[i, part] = True
            at[i] += len(part)
            front[i] = weight * int(impacts[at[i]]) if at[i] < len(docs) else 0
        read *= 2
        own = low[alive]
        high = own + front.sum() - front @ seen[:, alive]
        least = np.partition(own, len(own) - k)[len(own) - k] if len(own) > k else 0
        alive = alive[high >= max(int(least), 1)]
        needed = (front > 0) & ~seen[:, alive].all(axis=1)
    alive = alive[low[alive] > 0]
    order = np.lexsort((place[alive], -low[alive]))[:k]
    return [(int(d), int(low[d])) for d in alive[order]]


@query(
    "op11_nra",
    r"""
    WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
    s AS (SELECT count(*)::BIGINT AS N, sum(len(t))::BIGINT AS L FROM docs WHERE len(t) > 0),
    m AS (SELECT doc_id, t, 100 - 25 + (25 * len(t) * s.N) // s.L AS m FROM docs, s WHERE len(t) > 0),
    tf AS (SELECT doc_id, term, any_value(m) AS m, count(*)::BIGINT AS tf FROM (SELECT doc_id, m, unnest(t) AS term FROM m) GROUP BY doc_id, term),
    df AS (SELECT term, floor(1000 * ln((2 * any_value(s.N) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, s GROUP BY term),
    q AS (SELECT item_id, term, count(*)::BIGINT AS c FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term),
    scored AS (SELECT item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM q JOIN df USING (term) JOIN tf USING (term) GROUP BY item_id, doc_id),
    ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored WHERE score > 0)
    SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 20
    """,
)
def op11(spark, folder):
    return Index(table(spark, folder, "documents")).search(table(spark, folder, "benchmark"), 20)
