"""Near-duplicate groups by the Jaccard similarity of word shingles: a parity-sketch join.

Documents with the same shingle set are one class. A class XORs its shingle hashes into a sketch of
``m`` words, each shingle into one of them, so two sketches differ in at most as many words as the
sets differ in shingles. A required similarity bounds that difference by ``d``; of ``m`` words at
least ``m - d`` agree, and under one fixed order of all word values (most shingles first, so
that words of little content come last) the first ``d + 1`` words of both sets share one. Those
are the join keys, about a fifth as many as there are shingles, per band of sizes. A second sketch
of parity bits, whose Hamming distance is a lower bound too, discards candidates before the exact
sets are compared.

A group of copies or near copies is never expanded into pairs. Every key first links its classes
to the one that shares most; what these links connect needs no further candidates, and only classes that
share a key across components are paired after that, all that sizes and parity bits allow.

* Fewer words than ``k``: the whole sequence is the one shingle. No words or null: an empty set,
  linked with nothing; its component is its own id. An empty table gives no rows.
* Ties and repeated rows: equal sets are one class; a component is named by its smallest id. A null
  id is never smallest; alone it names a null component.
* Sets and classes are told apart by 64-bit hashes. Other input columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneframe.llm.components import components
from tuneframe.llm.registry import query, table
from tuneframe.llm.text import U64, byte_rows, lowered, mix, shingle_hashes, word_hashes
from tuneframe.session import lean, written

PARITY_BITS = 1024


class Rule:
    """Similarity of at least ``num / den`` on sets, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def largest_partner(self, n: int) -> int:
        return n * self.den // self.num

    def difference(self, total: int) -> int:
        """Most shingles in which two sets of ``total`` elements together may differ."""
        return total * (self.den - self.num) // (self.den + self.num)

    def reach(self, n: int) -> int:
        return self.difference(n + self.largest_partner(n))

    def words(self, band: int) -> int:
        """Sketch words for sets of a band [2**band, 2**(band + 1)) and partners from the band above."""
        top = self.reach(self.largest_partner((2 << band) - 1) + 1)
        return top + 1 + max(6, top // 6)

    def bands(self, n: int) -> list[int]:
        own = n.bit_length() - 1
        smallest = -(-n * self.num // self.den)
        return [own] if own == 0 or smallest >= 1 << own else [own, own - 1]


def shingle_set(data: np.ndarray, k: int) -> np.ndarray:
    return shingle_hashes(word_hashes(lowered(data)), k)


def class_of(shingles: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(mix(shingles * U64(0xD6E8FEB86659FD93)).sum(dtype=U64) + U64(len(shingles))).view(np.int64))


def sketch_keys(shingles: np.ndarray, rule: Rule) -> np.ndarray:
    """Join keys of a sorted set: for each of its bands the first ``reach + 1`` sketch words."""
    out = []
    n = len(shingles)
    need = rule.reach(n) + 1
    value = mix(shingles + U64(1))
    for band in rule.bands(n):
        m = rule.words(band)
        word = ((shingles >> U64(32)) * U64(m)) >> U64(32)  # rises with the sorted hashes
        start = np.flatnonzero(np.concatenate((np.ones(1, bool), word[1:] != word[:-1])))
        count = np.diff(np.append(start, n))
        own = word[start]
        with np.errstate(over="ignore"):
            key = mix(np.bitwise_xor.reduceat(value, start) + mix(own + U64(band << 32)) * U64(3))
        first = np.lexsort((key, -count))[:need]
        out.append(key[first])
        if len(start) < need:  # then words without shingles belong to the first ones too
            empty = np.setdiff1d(np.arange(m, dtype=U64), own)
            with np.errstate(over="ignore"):
                out.append(np.sort(mix(mix(empty + U64(band << 32)) * U64(5)))[: need - len(start)])
    return np.concatenate(out)


def parity_bits(shingles: np.ndarray) -> np.ndarray:
    odd = np.bincount((shingles & U64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketches(docs: DataFrame, k: int, rule: Rule) -> DataFrame:
    """(doc_id, n_shingles, class, bits, keys) per document; keys and bits once per class and task's batch."""
    schema = "n_shingles long, class long, bits array<long>, keys array<long>"
    num, den = rule.num, rule.den

    def run(batches):
        own = Rule(num, den)
        for batch in batches:
            n, classes, bits, offsets, keys, seen = [], [], [], [0], [], set()
            for data in byte_rows(batch.column(0)):
                shingles = shingle_set(data, k)
                name = class_of(shingles) if len(shingles) else None
                n.append(len(shingles))
                classes.append(name)
                if name is None or name in seen:
                    bits.append(None)
                else:
                    seen.add(name)
                    bits.append(parity_bits(shingles))
                    keys.append(sketch_keys(shingles, own).view(np.int64))
                offsets.append(offsets[-1] + (len(keys[-1]) if bits[-1] is not None else 0))
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(n, pa.int64()), pa.array(classes, pa.int64()), pa.array(bits, pa.list_(pa.int64())),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)],
                ["doc_id", "n_shingles", "class", "bits", "keys"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("text", "doc_id").mapInArrow(lean(run), f"doc_id {kind}, {schema}")


def _side(info: DataFrame, name: str) -> DataFrame:
    """Class ``name`` with its size and the words of its parity bits as plain columns, for use in a join's condition."""
    bits = [F.get("bits", F.lit(i)).alias(f"{name}_b{i}") for i in range(PARITY_BITS // 64)]
    return info.select(F.col("class").alias(name), F.col("n").alias(f"{name}_n"), *bits)


def _may_link(rule: Rule, a: str, b: str):
    """Sizes fit, and the parity bits differ in no more places than two similar sets may."""
    x, y = F.col(f"{a}_n"), F.col(f"{b}_n")
    distance = sum((F.bit_count(F.col(f"{a}_b{i}").bitwiseXOR(F.col(f"{b}_b{i}"))) for i in range(PARITY_BITS // 64)), F.lit(0))
    fits = F.least(x, y) * rule.den >= F.greatest(x, y) * rule.num
    return fits & (distance * (rule.den + rule.num) <= (x + y) * (rule.den - rule.num))


def _verified(pairs: DataFrame, info: DataFrame, docs: DataFrame, k: int, rule: Rule) -> DataFrame:
    """The pairs (u, v) of classes whose sets are similar: sizes, then parity bits, then the sets."""
    num, den = rule.num, rule.den
    sized = pairs.join(_side(info, "u"), "u").join(_side(info, "v"), "v").filter(_may_link(rule, "u", "v"))
    likely = written(sized.select("u", "v"), "jaccard-candidates")
    wanted = likely.select(F.col("u").alias("class")).union(likely.select("v")).distinct()
    # One document stands for a class; only texts of classes with a candidate are turned into sets again.
    chosen = info.join(wanted, "class").select("class", "doc_id")

    def sets(batches):
        for batch in batches:
            names, found = [], []
            for name, data in zip(batch.column(0).to_pylist(), byte_rows(batch.column(1))):
                shingles = shingle_set(data, k)
                if len(shingles) and class_of(shingles) == name:  # an id may stand on rows of other texts too
                    names.append(name)
                    found.append(shingles.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(found, pa.binary())], ["class", "set"])

    chosen = chosen.withColumnRenamed("doc_id", "chosen_id")
    texts = docs.select("doc_id", "text").join(chosen, F.col("doc_id").eqNullSafe(F.col("chosen_id")))
    exact = texts.select("class", "text").mapInArrow(lean(sets), "class long, set binary").dropDuplicates(["class"])
    exact = written(exact, "jaccard-sets")

    def compare(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    pairs = likely.join(exact.select(F.col("class").alias("u"), F.col("set").alias("s_u")), "u")
    pairs = pairs.join(exact.select(F.col("class").alias("v"), F.col("set").alias("s_v")), "v")
    return written(pairs.select("u", "v", "s_u", "s_v").mapInArrow(lean(compare), "u long, v long"), "jaccard-links")


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per document: doc_id, n_shingles, class (null for an empty set), component_id.

    Documents are linked at a similarity of ``num / den`` or more on their sets of ``k``-word shingles.
    """
    rule = Rule(num, den)
    marked = written(sketches(docs, k, rule), "jaccard-sketches")
    full = marked.filter(F.col("class").isNotNull())
    info = full.groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("bits", ignorenulls=True).alias("bits"))
    info = written(info, "jaccard-classes")
    keys = full.select(F.explode("keys").alias("key"), "class")
    shared = keys.groupBy("key").agg(F.min("class").alias("first"), F.max("class").alias("last"), F.count(F.lit(1)).alias("size")).filter("first < last")
    shared = written(keys.join(shared.select("key", "size"), "key").distinct(), "jaccard-shared")
    # A key's hub is its class that shares most: of near copies that differ from each other, the one in the middle.
    score = shared.groupBy("class").agg(F.sum("size").alias("score"))
    hubs = shared.join(score, "class").groupBy("key").agg(F.max(F.struct("score", "class"))["class"].alias("hub"))
    stars = shared.join(hubs, "key").filter("class <> hub")
    stars = written(stars.select(F.least("hub", "class").alias("u"), F.greatest("hub", "class").alias("v")).distinct(), "jaccard-stars")
    links = _verified(stars, info, docs, k, rule)
    known = components(links)
    # Keys that still hold classes of several components: every pair across components, once.
    placed = shared.select("key", "class").join(known, F.col("class") == F.col("node"), "left")
    placed = placed.select("key", "class", F.coalesce("component", "class").alias("part"))
    mixed = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high").select("key")
    placed = written(placed.join(mixed, "key", "left_semi"), "jaccard-open")
    # The largest component of a key needs no pairs within, so the others meet all of the key.
    largest = placed.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("part", "n").alias("main"))
    # Sizes and parity bits are looked at inside the join, so pairs that cannot link are never made.
    minor = placed.join(largest, "key").filter("part <> main").select("key", F.col("class").alias("a"), F.col("part").alias("p"), "main")
    minor = minor.join(_side(info, "a"), "a")
    others = placed.select("key", F.col("class").alias("b"), F.col("part").alias("q")).join(_side(info, "b"), "b")
    apart = F.expr("p <> q AND (q = main OR a < b)")
    meets = minor.withColumnRenamed("key", "k").join(others, (F.col("k") == F.col("key")) & apart & _may_link(rule, "a", "b"))
    pairs = meets.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    pairs = pairs.join(stars, ["u", "v"], "left_anti")
    more = _verified(written(pairs, "jaccard-pairs"), info, docs, k, rule)
    known = components(links.unionByName(more))
    named = info.select("class", "doc_id").join(known, F.col("class") == F.col("node"), "left")
    named = named.select("class", "doc_id", F.coalesce("component", "class").alias("part"))
    first = named.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    by_class = written(named.join(first, "part").select("class", "component_id"), "jaccard-components")
    found = marked.select("doc_id", "n_shingles", "class").join(by_class, "class", "left")
    return found.select("doc_id", "n_shingles", "class", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


@query("op5_jaccard")
def op5(spark, folder):
    found = near_duplicates(table(spark, folder, "documents"), k=4, num=85, den=100)
    return found.select("doc_id", "n_shingles", "component_id")
