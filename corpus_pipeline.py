"""Training-data pipeline over ``documents``: each stage works on what its predecessor kept.

Every stage takes and, but for the last, returns the columns of ``documents``; columns beyond them are not carried, whatever their
names. An empty table gives an empty one. What nulls, repeated rows and very long texts become is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneframe.llm import exact, jaccard, langid, mixing, packing
from tuneframe.session import ship_package, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


# A text whose recognised share of n-grams is below this is no language that was learned.
MIN_SCORE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled documents; texts of no learned language go.

    Null and empty texts, texts without a letter or too short for an n-gram go as well. Rows without a language teach nothing and are
    judged like all others; repeated rows stay or go together. Texts are read whole.
    """
    model = langid.fit(docs.select("text", "lang"))
    judged = langid.identify(docs, model).filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_SCORE))
    return judged.select(*COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, null counting as empty, the row with the largest doc_id stays, a null id counting as the smallest. Rows that
    repeat that id and text are one row."""
    return exact.dedup(docs).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 80 % of their five-word shingles, directly or over others, the smallest id stays.

    A null id comes after all others. Texts without words are near nothing and stay. Rows that repeat an id and a text stay or go together.
    """
    # Rows are told apart by id and text, as ids may repeat; a null id comes after all others.
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("text_hash"))
    groups = jaccard.near_duplicates(docs.select(row.alias("doc_id"), "text"), k=5, num=80, den=100)
    gone = groups.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("row"))
    return docs.select(*COLUMNS, row.alias("row")).join(gone, "row", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents drawn to the source targets; a document drawn twice is two rows. Rows leave in the order of the mix.

    A null source is one of its own. Null and empty texts have no words and are never drawn.
    """
    mixed = mixing.mix(docs, whole_documents=True)
    return mixing.shuffled_rows(mixed, COLUMNS).select(*COLUMNS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows, with their ids. A null or empty text is its end id alone; a long one is cut over several windows."""
    return packing.pack(docs, keep=["doc_id", "source"])


STAGES = [
    ("language id", language_id),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mix sources", mix_sources),
    ("packing", pack_windows),
]

# Learned models, hashes and greedy packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
