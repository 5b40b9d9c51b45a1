"""Order as data: positions, shuffles, first / latest rows.

Rows of a DataFrame have no order, so order lives in columns. Global positions come from
bucket counts plus a row number inside a bucket. A bucket is a pure function of the key,
so both passes agree after a task is retried, and no bucket grows with the table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Keys per bucket (2**20) of id order, and hex digits of a bucket of hash order.
ID_BITS = 20
HASH_DIGITS = 4
# Rows that a task of latest_n gathers before it drops what cannot be among the last.
HEAP_ROWS = 1 << 17


def shuffle_key(seed: int | str, row_id: Column) -> Column:
    """Sort key of a seeded permutation: another seed gives another order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), row_id.cast("string")))


def _before(counts: DataFrame, n: str, name: str, groups: Sequence[str], order: str) -> DataFrame:
    """Add the sum of ``n`` over the preceding rows of a group."""
    preceding = Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(name, F.coalesce(F.sum(n).over(preceding), F.lit(0)))


def _offsets(counts: DataFrame, sparse: bool) -> DataFrame:
    """``_bucket, _offset`` from one row per bucket.

    Hash buckets are at most ``16 ** HASH_DIGITS`` rows and are added up directly. Buckets of
    ids may be many when ids have gaps, so they are added up inside blocks of 2**20
    neighbours first and then across blocks.
    """
    if sparse:
        counts = counts.withColumn("_block", F.shiftright("_bucket", ID_BITS))
        blocks = counts.groupBy("_block").agg(F.sum("_n").alias("_m")).withColumn("_all", F.lit(0))
        blocks = _before(blocks, "_m", "_across", ["_all"], "_block")
        counts = _before(counts, "_n", "_inside", ["_block"], "_bucket").join(blocks, "_block")
        offset = F.col("_inside") + F.col("_across")
    else:
        counts = _before(counts.withColumn("_all", F.lit(0)), "_n", "_across", ["_all"], "_bucket")
        offset = F.col("_across")
    return counts.select("_bucket", offset.alias("_offset"))


def _positions(df: DataFrame, bucket: Column, order: Sequence[str], name: str, sparse: bool) -> DataFrame:
    df = df.withColumn("_bucket", bucket)
    counts = df.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    numbered = df.withColumn("_rn", F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)))
    return (
        # Dealt by bucket first: the offsets end in one partition, and the rows would be sent there to meet them.
        numbered.join(_offsets(counts, sparse).repartition("_bucket"), "_bucket")
        .withColumn(name, F.col("_offset") + F.col("_rn") - 1)
        .drop("_bucket", "_rn", "_offset")
    )


def position_by_id(df: DataFrame, row_id: str = "row_idx", name: str = "pos") -> DataFrame:
    """Dense 0-based position in the order of a unique, non-negative integer id."""
    return _positions(df, F.shiftright(F.col(row_id), ID_BITS), [row_id], name, sparse=True)


def seeded_shuffle(
    df: DataFrame, seed: int | str, row_id: str = "row_idx", name: str = "pos", digits: int = HASH_DIGITS
) -> DataFrame:
    """Dense 0-based position in a permutation drawn from ``seed``.

    The hash spreads unique ids evenly, so its leading digits are ``16 ** digits`` balanced buckets. Their number is
    fixed and they grow with the table: five digits suit 10^11 rows, six 10^12.
    """
    df = df.withColumn("_key", shuffle_key(seed, F.col(row_id)))
    bucket = F.conv(F.substring("_key", 1, digits), 16, 10).cast("bigint")
    return _positions(df, bucket, ["_key", row_id], name, sparse=False).drop("_key")


def in_order(df: DataFrame, name: str = "pos") -> DataFrame:
    """Range-partitioned sort for writing or reading a table in order."""
    return df.orderBy(name)


def _highest(rows: DataFrame, n: int, order: str, groups: Sequence[str]) -> DataFrame:
    """At most the ``n`` highest values of each group that a task reads; ``rows`` holds groups and ``order`` only.

    Each task keeps, as a heap would, what may still be among the ``n`` highest of a group and drops the rest whenever it has doubled.
    """
    groups = list(groups)

    def best(table: pa.Table) -> pa.Table:
        # Falling order with NaN first, as Spark has it.
        values = table.column(order)
        keys = {"v": values, "nan": pc.is_nan(values) if pa.types.is_floating(values.type) else pa.array(np.zeros(len(values), bool))}
        table = table.take(pc.sort_indices(pa.table(keys), [("nan", "descending"), ("v", "descending")]))
        code = np.zeros(table.num_rows, np.int64)
        for name in groups:
            column = table.column(name).combine_chunks().dictionary_encode(null_encoding="encode")
            code = np.unique(code * len(column.dictionary) + column.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        by = np.argsort(code, kind="stable")
        first = np.append(True, code[by][1:] != code[by][:-1])
        starts = np.flatnonzero(first)
        rank = np.arange(len(by)) - starts[np.cumsum(first) - 1]
        return table.take(pa.array(by[rank < n]))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, limit = [], 0, HEAP_ROWS
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= limit:
                held = best(pa.Table.from_batches(held)).to_batches()
                size = sum(b.num_rows for b in held)
                limit = max(HEAP_ROWS, 2 * size)
        if held:
            yield from best(pa.Table.from_batches(held)).to_batches()

    return rows.mapInArrow(keep, rows.schema)


def latest_n(df: DataFrame, n: int, order: str, groups: Sequence[str]) -> DataFrame:
    """The last ``n`` rows of each group by ``order``, a column of numbers, times or texts; NULL comes before all values. Of equal values any.

    Works the same for any ``n``: the ``n``-th highest value of each large group is found from the order column
    alone, in tasks, then per group and input partition, then per group. Only rows from there on are moved, and they are
    cut to ``n`` per group and input partition before they meet, so that many equal values do no harm.
    """
    groups = list(groups)
    if not groups:
        return df.orderBy(F.desc_nulls_last(order)).limit(n)
    salt = F.spark_partition_id()
    # NULL is below every value, so a group whose n-th value is NULL, or that has fewer than n, has no threshold.
    thin = _highest(df.where(F.col(order).isNotNull()).select(*groups, order), n, order, groups).withColumn("_salt", salt)

    def ranked(rows: DataFrame, *by: str) -> DataFrame:
        return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc_nulls_last(order))))

    few = ranked(thin, *groups, "_salt").where(F.col("_rn") <= n).drop("_rn", "_salt")
    least = ranked(few, *groups).where(F.col("_rn") == n).select(*[F.col(g).alias(f"_g_{g}") for g in groups], F.col(order).alias("_least"))
    same = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups]
    near = df.join(least, reduce(and_, same), "left")
    rows = near.where(F.col("_least").isNull() | (F.col(order) >= F.col("_least"))).select(*df.columns, salt.alias("_salt"))
    rows = ranked(rows, *groups, "_salt").where(F.col("_rn") <= n).drop("_rn", "_salt")
    return ranked(rows, *groups).where(F.col("_rn") <= n).drop("_rn")


def first_per_key(df: DataFrame, key: Column, order: str, groups: Sequence[str] = ()) -> DataFrame:
    """The earliest row of each key within each of ``groups``; hot keys are reduced to one row before the shuffle."""
    # JSON keeps different lists and structs apart, which their plain text form does not.
    rows = df.groupBy(*groups, F.md5(F.to_json(F.struct(key.alias("k")))).alias("_key")).agg(
        F.min_by(F.struct(*df.columns), F.col(order)).alias("_row")
    )
    return rows.select("_row.*")


def drop_duplicate_prompts(
    df: DataFrame, order: str, prompt: str = "prompt", groups: Sequence[str] = ("run_id", "mode", "step")
) -> DataFrame:
    """The first row of each prompt per log event. ``groups`` name the event; those that the table lacks do not count."""
    return first_per_key(df, F.col(prompt), order, [g for g in groups if g in df.columns])


def smallest_ids(df: DataFrame, groups: Sequence[str], row_id: str, k: int, name: str = "first_ids") -> DataFrame:
    """Per group: row count ``n`` and the ``k`` smallest ids, in one pass over ``df``.

    Ids are cut to ``k`` per input partition and again per block of partitions, so no
    task holds more than one input partition's ids of a group.
    """

    def merge(parts: DataFrame, keys) -> DataFrame:
        return parts.groupBy(*keys).agg(
            F.sum("n").alias("n"),
            F.slice(F.sort_array(F.flatten(F.collect_list(name))), 1, k).alias(name),
        )

    parts = (
        df.withColumn("_part", F.spark_partition_id())
        .groupBy(*groups, "_part")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.slice(F.sort_array(F.collect_list(row_id)), 1, k).alias(name),
        )
        .withColumn("_part", F.shiftright("_part", 8))
    )
    return merge(merge(parts, [*groups, "_part"]), groups)


def dedup_expand(df: DataFrame, key: Column, work, keep: Sequence[str] | None = None) -> DataFrame:
    """Run ``work`` once per distinct key and spread its columns back to every row.
    ``keep`` names the columns of ``df`` that the result carries, all by default: leave long texts out, and
    the way back moves only key ids and those columns.

    ``work`` maps a DataFrame with columns ``key_id`` and ``key`` to one that keeps
    ``key_id``. Copies collapse before the shuffle; on the way back the side with one row
    per key is the small one, and AQE splits a hot key of the other side.
    """
    key_id = F.md5(key.cast("string")).alias("key_id")
    distinct = df.select(key_id, key.alias("key")).groupBy("key_id").agg(F.any_value("key").alias("key"))
    rows = df.select(*(df.columns if keep is None else keep), key_id)
    return rows.join(work(distinct).drop("key"), "key_id", "left").drop("key_id")
