"""Exact top-k search by inner product: a ball tree for each shard of vectors, searched by branch and bound.

A node's bound for a query q is q . centre + |q| * radius. Nodes are met in falling order of bound; the search ends
when the best bound left is under the score that is k-th so far. Queries are first searched in one shard, whose
k-th score is then where the search of every other shard starts.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, pick

LEAF = 48
#: Vectors of a shard and queries of a block, in rows: what one task holds.
SHARD_ROWS, BLOCK_ROWS = 16_384, 4_096
SCALE = 1024


class BallTree:
    """ids and integer vectors (rows, held as doubles: sums stay whole while they are under 2**53)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.leaf = ids[order], vectors[order], leaf
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        self.children: list[tuple[int, int] | None] = []
        self.rows: list[np.ndarray | None] = []
        if len(ids):
            self._grow(np.arange(len(ids)))
            self.centres, self.radii = np.array(self.centre), np.array(self.radius)

    def _grow(self, rows: np.ndarray) -> None:
        todo = [(rows, -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            me, v = len(self.centre), self.vectors[rows]
            centre = v.mean(axis=0)
            far = np.sqrt(((v - centre) ** 2).sum(axis=1))
            self.centre.append(centre)
            self.radius.append(float(far.max()))
            self.children.append(None)
            self.rows.append(rows)
            if parent >= 0:
                pair = self.children[parent] or (-1, -1)
                self.children[parent] = (me, pair[1]) if side == 0 else (pair[0], me)
            if len(rows) <= self.leaf or self.radius[me] == 0.0:  # equal vectors are one leaf
                continue
            a = v[far.argmax()]
            b = v[((v - a) ** 2).sum(axis=1).argmax()]
            along = v @ (b - a)
            half = np.argpartition(along, len(rows) // 2)
            cut = along[half[len(rows) // 2]]
            left = along < cut
            if not left.any() or left.all():
                left = along <= cut
            if left.all():
                continue
            self.rows[me] = None
            todo += [(rows[left], me, 0), (rows[~left], me, 1)]

    def search(self, query: np.ndarray, own: int | None, k: int, least: float = -np.inf) -> list[tuple[int, int]]:
        """(score, id) of the k highest, ties to the smaller id; rows of id own take no part. Only scores of least or more
        are of interest."""
        if not len(self.ids):
            return []
        length = float(np.sqrt(query @ query))
        bounds = self.centres @ query + length * self.radii
        slack = 1e-9 * (1.0 + length * float(self.radii[0])) + 1e-9 * float(np.abs(bounds).max()) + 1e-6
        best: list[tuple[float, int]] = []  # a heap of (score, -id), the worst first
        queue = [(-bounds[0], 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            kth = max(least, best[0][0]) if len(best) == k else least
            if -bound + slack < kth:
                break
            rows = self.rows[node]
            if rows is None:
                for child in self.children[node]:
                    if bounds[child] + slack >= kth:
                        heapq.heappush(queue, (-bounds[child], child))
                continue
            scores = self.vectors[rows] @ query
            good = np.flatnonzero(scores >= kth)
            if len(good) > 2 * k:  # rows are in order of id, so of equal scores the first are kept
                good = good[self.ids[rows[good]] != own]
                good = good[np.argsort(-scores[good], kind="stable")[:k]]
            for i in good:
                item = (float(scores[i]), -int(self.ids[rows[i]]))
                if -item[1] == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return [(int(s), -i) for s, i in sorted(best, reverse=True)]


def integers(vector: Column) -> Column:
    """floor(SCALE * x) of each component, as double; null where the vector is null or has a null or non-finite component. Components of
    2**53 or more come out smaller than they are; top_k refuses them."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    plain = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(F.coalesce(plain, F.lit(False)), whole)


def _matrix(values: pd.Series) -> np.ndarray:
    return np.array(values.tolist(), dtype=np.float64) if len(values) else np.zeros((0, 0))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k rows with the highest integer inner products, ties to the smaller id.

    is_query is a condition on the column vec_id. Rows with a null id, or a null, empty or unfit vector, take no part; vectors of
    different lengths are compared only with their like. Candidates are all rows but those with the query's own id. Repeated rows
    are candidates as often as they occur; a query id that is repeated is answered once, for the least of its vectors. Scores are sums of
    doubles, exact under 2**53: vectors whose products could reach that are an error.

    Vectors are dealt to shards of about shard_rows by a hash of id and vector, queries to blocks of block_rows; a task holds one shard
    and one block, whatever the size of either table. What is passed on is k rows for each query and shard."""
    tables = Tables(vectors.sparkSession, "topk")
    plain = pick(vectors, vec_id=vec_id, embedding=embedding).select("vec_id", integers(F.col("embedding")).alias("v"))
    plain = plain.where(F.col("vec_id").isNotNull() & (F.size("v") > 0)).withColumn("dim", F.size("v"))
    plain = tables.write(plain, "vectors")
    queries = plain.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    queries = tables.write(queries, "queries")
    n, size, dim = plain.agg(F.count("*"), F.max(F.array_max(F.transform("v", F.abs))), F.max("dim")).first()
    if n and size * size * dim >= 2.0**53:
        raise ValueError(f"components up to {size / SCALE:g} make products that doubles do not hold exactly")
    n_shards = max(1, -(-n // shard_rows))
    n_blocks = max(1, -(-queries.count() // block_rows))
    # Rows are numbered within their input partition, so that equal rows are spread too.
    shard = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(n_shards))
    dealt = tables.write(plain.withColumn("shard", shard), "dealt")
    asked = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)))
    home = asked.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_shards))).withColumn("least", F.lit(float("-inf")))
    each_block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block")
    spread = dealt.select("*", each_block) if n_blocks > 1 else dealt.withColumn("block", F.lit(0).cast("long"))
    schema = "query_id long, vec_id long, score long"

    def search(key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
        tree = BallTree(rows["vec_id"].to_numpy(), _matrix(rows["v"].to_pandas()))
        out: list[tuple[int, int, int]] = []
        if len(tree.ids):
            for q, v, least in zip(queries["vec_id"].to_pylist(), _matrix(queries["v"].to_pandas()), queries["least"].to_pylist(), strict=True):
                out += [(q, i, s) for s, i in tree.search(v, q, k, least)]
        return pa.table({n: pa.array([x[j] for x in out], pa.int64()) for j, n in enumerate(("query_id", "vec_id", "score"))})

    def searched(queries: DataFrame) -> DataFrame:
        keys = ("shard", "block", "dim")
        return spread.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(search, schema)

    first = tables.write(searched(home.select("vec_id", "v", "dim", "least", "shard", "block")), "first")
    kth = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    known = asked.join(kth.where(F.col("n") == k), asked.vec_id == kth.query_id, "left")
    others = known.select("vec_id", "v", "dim", F.coalesce(F.col("least").cast("double"), F.lit(float("-inf"))).alias("least"), "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long"))).alias("shard"))
    others = others.where(F.col("shard") != F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_shards)))
    found = first if n_shards == 1 else first.union(searched(others))
    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
