"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest. A new batch is reduced to one row per
digest, anti-joined with the index bucket by bucket (sort-merge, the index side needs no
shuffle) and what is new is appended. Only digests and ids are ever moved, never texts.

* Null counts as the empty text; an empty table gives no rows.
* Repeated rows: rows of equal text and equal id are all kept or all dropped together in the
  report; ``dedup`` keeps one of them, the smallest by text and then by its plain columns.
* Extra columns are carried by ``dedup``; the working names start with ``_x_``, so a table's own
  ``digest`` or ``keep_id`` column does not clash.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneframe.llm.registry import query, table
from tuneframe.llm.text import ascii_lower
from tuneframe.session import run_folder, written

BUCKETS = 64


def text_digest(text):
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))).cast("binary"), 256)


class DigestIndex:
    """Digests seen so far, each with the id that keeps it and the batch that brought it.

    An index that is there already keeps the number of buckets it was made with, whatever ``buckets`` says.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path
        self.buckets = buckets = self._buckets(buckets)
        self.name = "digest_index_" + hashlib.sha256(path.encode()).hexdigest()[:32]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest STRING, keep_id BIGINT, group_size BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def _buckets(self, wanted: int) -> int:
        """Number of buckets that the index was made with, kept beside its files; ``wanted`` for a new one."""
        context = self.spark.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(self.path)
        store = folder.getFileSystem(context._jsc.hadoopConfiguration())
        marks = store.globStatus(context._jvm.org.apache.hadoop.fs.Path(folder, "_buckets-*"))
        if marks:
            return int(marks[0].getPath().getName().rpartition("-")[2])
        store.mkdirs(folder)
        store.createNewFile(context._jvm.org.apache.hadoop.fs.Path(folder, f"_buckets-{wanted}"))
        return wanted

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, groups: DataFrame) -> DataFrame:
        """Rows of ``groups`` (digest, ...) whose digest the index lacks."""
        return groups.hint("merge").join(self.read().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame, batch: str) -> None:
        """Add what is new of ``groups`` (digest, keep_id, group_size); appending a batch twice adds nothing."""
        fresh = self.unseen(groups).withColumn("batch", F.lit(batch))
        fresh = fresh.select("digest", "keep_id", "group_size", "batch").repartition(self.buckets, "digest")
        fresh.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option(
            "path", self.path
        ).saveAsTable(self.name)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of every row."""
    return docs.select("doc_id", text_digest(F.col("text")).alias("digest"))


def groups_of(marked: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size): summed before the shuffle, so a hot text is one row per task."""
    return marked.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def dedup_report(docs: DataFrame, index: DigestIndex | None = None, batch: str = "0") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    With an index of earlier batches ``keep_id`` is the id that the index keeps, and
    ``group_size`` counts the batch that brought the text. A null doc_id is never the largest.
    """
    spark = docs.sparkSession
    index = index or DigestIndex(spark, run_folder(spark, "digest-index"))
    marked = written(digests(docs), "digests")
    index.append(groups_of(marked), batch)
    kept = index.read().select("digest", "keep_id", "group_size", F.col("batch").alias("_x_batch"))
    # The larger side is streamed, so AQE can split the partition of a hot text.
    joined = marked.join(kept, "digest")
    mine = (F.col("_x_batch") == batch) & (F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return joined.select("doc_id", "keep_id", "group_size", mine.alias("kept"), F.col("digest").alias("text_sha256"))


def dedup(docs: DataFrame, index: DigestIndex | None = None, batch: str = "0") -> DataFrame:
    """The rows of ``docs`` that stay: of equal texts one row of the largest doc_id."""
    report = dedup_report(docs, index, batch)
    # Which ids stay, and of which text: one row per distinct text.
    stay = report.filter("kept").select(F.col("doc_id").alias("_x_id"), F.col("text_sha256").alias("_x_digest")).distinct()
    named = docs.withColumns({"_x_id": F.col("doc_id"), "_x_digest": text_digest(F.col("text"))})
    found = named.join(stay, named["_x_id"].eqNullSafe(stay["_x_id"]) & (named["_x_digest"] == stay["_x_digest"]), "left_semi")
    plain = [c for c, kind in docs.dtypes if not kind.startswith(("map", "array", "struct", "variant"))]
    order = F.struct("text", *sorted(c for c in plain if c != "text"))
    row = F.min_by(F.struct(*docs.columns), order)
    return found.groupBy("_x_id", "_x_digest").agg(row.alias("_x_row")).select("_x_row.*")


@query(
    "op9_exact_dedup",
    """
    WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
    g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
    SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
    """,
)
def op9(spark, folder):
    return dedup_report(table(spark, folder, "documents"))
