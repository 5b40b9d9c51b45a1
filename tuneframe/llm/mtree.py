"""Exact top-k by inner product with M-trees.

Inner products are turned into distances: a vector gets one more component that lifts it to the
largest norm, a query gets a zero, and then the nearest points are the highest products. Vectors are
cut into shards of a fixed size. A shard is bulk-loaded into an M-tree stored as pages, one row
per node: routing object, covering radius, distance to the parent, and for leaves the members
with their distances to the routing object. A search opens pages best-first by the smallest
distance they may hold and stops when that exceeds the k-th best; a page or member is skipped
without a distance when the stored distances already rule it out by the triangle inequality.

Each task holds one shard's pages and one block of queries, both of fixed size, so nothing
grows with the data but the number of tasks. A query's best k of each shard are merged by Spark,
which keeps k rows of a query in each task.

* Vectors that are null, empty, or hold null or non-finite components take no part. Vectors of
  another dimension than the query's are no candidates of it.
* Components are 64-bit integers and products are exact. A product that 64 bits cannot hold, among the k best, is an error.
* A query's own id is never its answer; repeated rows with that id are left out too. Ties go to the
  smaller id. With fewer than k candidates all are returned. Empty tables give no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tuneframe.llm.registry import query, table
from tuneframe.session import written

SHARD = 1 << 14
QUERY_BLOCK = 512
PAGE = 512
PAGES = (
    "dim int, shard long, node int, parent int, leaf boolean, radius double, to_parent double, pivot binary, "
    "ids binary, members binary, distances binary"
)
_SLACK = 1e-6


def _distances(points: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((points - pivot) ** 2).sum(1), 0))


def lift(vectors: np.ndarray, norm2: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(norm2 - (vectors * vectors).sum(1), 0))
    return np.hstack((vectors, rest[:, None]))


class Node:
    __slots__ = ("children", "distances", "ids", "leaf", "members", "pivot", "pivots", "radii", "radius", "to_parent", "to_pivots")


def bulk_load(ids: np.ndarray, vectors: np.ndarray, seed: int = 1) -> list[tuple]:
    """Pages of an M-tree over integer vectors: (node, parent, leaf, radius, to_parent, pivot, ids, members, distances).

    Top down: a set is split around farthest-first routing objects until it fits a page. A set of
    equal points is cut by count.
    """
    norm2 = float((vectors.astype(np.float64) ** 2).sum(1).max()) if len(vectors) else 0.0
    points = lift(vectors.astype(np.float64), norm2)
    pages: list[tuple] = []
    stack = [(np.arange(len(ids)), -1, None)]
    while stack:
        own, parent, above = stack.pop()
        center = points[own].mean(0)
        pivot = points[own[np.argmin(_distances(points[own], center))]]
        away = _distances(points[own], pivot)
        number, radius = len(pages), float(away.max())
        to_parent = float(np.sqrt(((pivot - above) ** 2).sum())) if above is not None else 0.0
        if len(own) <= PAGE:
            rising = np.argsort(away, kind="stable")
            own, away = own[rising], away[rising]
            pages.append((number, parent, True, radius, to_parent, pivot, ids[own], vectors[own], away))
            continue
        pages.append((number, parent, False, radius, to_parent, pivot, ids[:0], vectors[:0], away[:0]))
        fan = min(16, -(-len(own) // PAGE))
        nearest, group = np.full(len(own), np.inf), np.zeros(len(own), np.int64)
        at = int(np.argmax(away))
        for i in range(fan):
            d = _distances(points[own], points[own[at]])
            closer = d < nearest
            nearest[closer], group[closer] = d[closer], i
            at = int(np.argmax(nearest))
        parts = [own[group == i] for i in range(fan)]
        parts = [p for p in parts if len(p)]
        if len(parts) == 1:
            parts = np.array_split(own, fan)
        stack.extend((p, number, pivot) for p in parts)
    return pages


class MTree:
    """A shard's pages in memory."""

    def __init__(self, pages: pd.DataFrame, dim: int):
        self.nodes: dict[int, Node] = {}
        self.norm2, self.largest = 0.0, 0
        children: dict[int, list[int]] = {}
        for row in pages.itertuples():
            node = Node()
            node.leaf, node.radius, node.to_parent = row.leaf, row.radius, row.to_parent
            node.pivot = np.frombuffer(row.pivot, np.float64)
            node.ids, node.distances = np.frombuffer(row.ids, np.int64), np.frombuffer(row.distances, np.float64)
            node.members = np.frombuffer(row.members, np.int64).reshape(-1, dim)
            if len(node.members):
                self.largest = max(self.largest, int(node.members.max()), -int(node.members.min()))
            self.nodes[row.node] = node
            children.setdefault(row.parent, []).append(row.node)
            self.norm2 = max(self.norm2, float((node.pivot**2).sum()))
        for number, node in self.nodes.items():
            node.children = np.array(children.get(number, []), np.int64)
            node.pivots = np.array([self.nodes[c].pivot for c in node.children]).reshape(-1, dim + 1)
            node.radii = np.array([self.nodes[c].radius for c in node.children])
            node.to_pivots = np.array([self.nodes[c].to_parent for c in node.children])
        self.computed = self.skipped = 0
        self.dim, self.kinds = dim, {}

    def _products(self, node: Node, kind, low: int, high: int, vector: np.ndarray) -> np.ndarray:
        """Inner products in ``kind``: doubles or 64-bit integers where every sum is exact in them, else Python's integers."""
        members = self.kinds.get((id(node), kind))
        if members is None:
            members = self.kinds[id(node), kind] = node.members if kind is np.int64 else node.members.astype(kind)
        return members[low:high] @ vector

    def search(self, own_id: int, vector: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k highest (product, -id) of one query, a vector of integers, best first."""
        most = self.largest * max(map(abs, vector.tolist()), default=0) * self.dim
        kind = np.float64 if most < 2**53 else np.int64 if most < 2**63 else object
        exact, vector = vector.astype(kind), vector.astype(np.float64)
        q = np.append(vector, 0.0)
        q2 = float((vector * vector).sum())
        # Rounding of squares leaves distances as inexact as this.
        slack = 1e-7 * float(np.sqrt(q2 + self.norm2))
        best: list[tuple[int, int]] = []  # heap of (product, -id)
        limit = np.inf  # distance of the k-th best
        root = self.nodes[0]
        d0 = float(np.sqrt(((q - root.pivot) ** 2).sum()))
        open_pages = [(max(0.0, d0 - root.radius), 0, d0)]
        while open_pages:
            nearest, number, to_pivot = heapq.heappop(open_pages)
            if nearest > limit + _SLACK * (1 + limit) + slack:
                break
            node = self.nodes[number]
            bound = limit + _SLACK * (1 + limit) + slack if len(best) == k else np.inf
            if node.leaf:
                # Members stand by distance to the routing object: those in reach are one run.
                low = int(np.searchsorted(node.distances, to_pivot - bound, "left"))
                high = int(np.searchsorted(node.distances, to_pivot + bound, "right"))
                self.skipped += len(node.distances) - (high - low)
                self.computed += high - low
                if low >= high:
                    continue
                ids, products = node.ids[low:high], self._products(node, kind, low, high, exact)
                keep = ids != own_id
                if len(best) == k:
                    keep &= products >= best[0][0]
                elif len(ids) > 4 * k:  # at first only those that can be among the k best of the page
                    lowest = products.min()
                    keep &= products >= np.partition(np.where(keep, products, lowest), len(ids) - k)[len(ids) - k]
                at = np.flatnonzero(keep)
                for entry in zip(map(int, products[at].tolist()), (-ids[at]).tolist()):
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
                if len(best) == k:
                    limit = float(np.sqrt(max(0.0, q2 + self.norm2 - 2.0 * best[0][0])))
                continue
            near = np.flatnonzero(np.abs(to_pivot - node.to_pivots) - node.radii <= bound)
            self.skipped += len(node.children) - len(near)
            self.computed += len(near)
            if len(near):
                d = _distances(node.pivots[near], q)
                for i, x in zip(near.tolist(), d.tolist()):
                    low = max(0.0, x - node.radii[i])
                    if low <= bound:
                        heapq.heappush(open_pages, (low, int(node.children[i]), x))
        return sorted(best, reverse=True)


def _rows(vectors: DataFrame) -> DataFrame:
    good = F.col("values").isNotNull() & (F.size("values") > 0) & ~F.exists("values", lambda x: x.isNull() | F.abs(x).isin(float("inf")) | F.isnan(x))
    return vectors.filter(F.col("id").isNotNull() & good).select("id", "values", F.size("values").alias("dim"))


def build_pages(vectors: DataFrame, shard: int = SHARD) -> DataFrame:
    """M-tree pages of (id, values: array of integers), a tree for each shard of about ``shard`` vectors; written."""
    rows = written(_rows(vectors), "mtree-vectors")
    shards = max(1, -(-rows.count() // shard))
    # The whole row is hashed, with a random part for repeated rows, so that no shard outgrows its size.
    home = F.pmod(F.xxhash64("id", "values", F.monotonically_increasing_id()), F.lit(shards))

    def load(key, part):
        ids = part.column("id").to_numpy()
        dim = key[0].as_py()
        values = part.column("values").combine_chunks().flatten().to_numpy().reshape(-1, dim).astype(np.int64)
        out = [
            (dim, key[1].as_py(), n, parent, leaf, radius, up, pivot.tobytes(), own.astype(np.int64).tobytes(), members.astype(np.int64).tobytes(), away.tobytes())
            for n, parent, leaf, radius, up, pivot, own, members, away in bulk_load(ids, values)
        ]
        names = [f.split()[0] for f in PAGES.split(", ")]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.float64(), pa.float64(), *[pa.binary()] * 4]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    placed = rows.withColumn("shard", home)
    return written(placed.groupBy("dim", "shard").applyInArrow(load, PAGES), "mtree-pages")


def top_k(pages: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest products for each query (id, values)."""
    asked = _rows(queries)
    n = max(1, -(-asked.count() // block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id", "values"), F.lit(n)))
    # One group per task: every shard's tree meets every block of queries of its dimension.
    shards = pages.groupBy("dim").agg(F.max("shard").alias("last"))
    asked = asked.join(shards, "dim").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), "last"))).drop("last")
    held = pages.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))

    def search(key, own, part):
        out = []
        if own.num_rows and part.num_rows:
            tree = MTree(own.to_pandas(), key[0].as_py())
            for own_id, values in zip(part.column("id").to_pylist(), part.column("values").to_pylist()):
                found = tree.search(own_id, np.array(values, np.int64), k)
                if found:
                    out.append((own_id, [{"score": s, "vec_id": -i} for s, i in found]))
        kind = pa.list_(pa.struct([("score", pa.int64()), ("vec_id", pa.int64())]))
        return pa.table([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], kind)], ["query_id", "found"])

    keys = ["dim", "shard", "block"]
    found = held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(search, "query_id long, found array<struct<score:long,vec_id:long>>")
    # k rows per query and shard at most; Spark limits a query's rows to k in every task before it shuffles them.
    rows = found.select("query_id", F.explode("found").alias("f")).select("query_id", "f.vec_id", "f.score")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def quantized(embeddings: DataFrame, scale: float = 64.0) -> DataFrame:
    """(id, values): floor(scale * x) of every component, as integers."""
    safe = F.transform("embedding", lambda x: x.cast("double"))
    return embeddings.select(F.col("vec_id").alias("id"), safe.alias("x")).select("id", F.transform("x", lambda x: F.when(F.abs(x) < float("inf"), F.floor(x * scale))).alias("values"))


@query(
    "op6_topk",
    """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
    """,
)
def op6(spark, folder):
    vectors = quantized(table(spark, folder, "embeddings"))
    return top_k(build_pages(vectors), vectors.filter(F.col("id") % 20 == 0), 20)
