"""Exact nearest neighbours in blocks, and the vote."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import squared_distance
from ..schemas import DIMS, K

#: Pairs that are worked out at once: bounds a task's temporary arrays.
PAIRS = 2_000_000
#: References of a shard and queries of a block, in rows: what one task holds, whatever the size of either table.
SHARD_ROWS, BLOCK_ROWS = 16_384, 4_096
FOUND = "qid long, ref_id long, d double, y int"
#: Rows of references up to which the pair plan may broadcast them.
BROADCAST_ROWS = 50_000


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Dimension by dimension from the left, as a fold over columns adds up: results are equal to the last bit."""
    total = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        x, y = a[:, i, None], b[None, :, i]
        total += (x - y) ** 2 if metric == "l2" else np.abs(x - y) if metric == "l1" else x * y
    if metric == "cosine":
        norms = [np.sqrt(_fold(m)) for m in (a, b)]
        scale = norms[0][:, None] * norms[1][None, :]
        total = 1.0 - total / np.where(scale == 0, 1.0, scale)
    return total


def _fold(m: np.ndarray) -> np.ndarray:
    total = np.zeros(len(m))
    for i in range(m.shape[1]):
        total += m[:, i] * m[:, i]
    return total


def nearest(a: np.ndarray, qids: np.ndarray, b: np.ndarray, ids: np.ndarray, k: int, metric: str, skip_own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of a, row of b and distance of the k nearest of each row of a; ties to the smaller of ids, which are in order. For l2 a matrix
    product finds what may be among them, within its rounding, and the folded distance decides."""
    if metric == "l2":
        x, y = (a * a).sum(axis=1)[:, None], (b * b).sum(axis=1)[None, :]
        rough, slack = x + y - 2.0 * (a @ b.T), 1e-10 * (1.0 + x.max() + y.max())
    else:
        rough, slack = distances(a, b, metric), 0.0
    if skip_own:
        low, high = np.searchsorted(ids, qids), np.searchsorted(ids, qids, "right")
        for i in np.flatnonzero(high > low):
            rough[i, low[i] : high[i]] = np.inf
    n = min(k, len(b))
    bar = np.partition(rough, n - 1, axis=1)[:, n - 1]
    row, at = np.nonzero((rough <= bar[:, None] + 2 * slack) & np.isfinite(rough))
    d = rough[row, at]
    if metric == "l2":
        d = np.zeros(len(row))
        for i in range(a.shape[1]):
            d += (a[row, i] - b[at, i]) ** 2
    order = np.lexsort((at, d, row))
    row, at, d = row[order], at[order], d[order]
    good = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[good], at[good], d[good]


def group_search(k: int, metric: str = "l2", skip_own: bool = False) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """What a task does with a block of queries (qid, qv) and a shard of references (ref_id, v, y), as FOUND rows."""

    def run(key: tuple, q: pa.Table, r: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if q.num_rows and r.num_rows:
            order = np.argsort(r["ref_id"].to_numpy(), kind="stable")
            ids, labels, b = r["ref_id"].to_numpy()[order], r["y"].to_numpy()[order], _matrix(r["v"])[order]
            a, qids = _matrix(q["qv"]), q["qid"].to_numpy()
            step = max(1, PAIRS // len(b))
            for start in range(0, len(a), step):
                row, at, d = nearest(a[start : start + step], qids[start : start + step], b, ids, k, metric, skip_own)
                out.append((qids[start + row], ids[at], d, labels[at]))
        types = (pa.int64(), pa.int64(), pa.float64(), pa.int32())
        return pa.table({c: pa.array(np.concatenate([x[i] for x in out]) if out else [], t) for i, (c, t) in enumerate(zip(("qid", "ref_id", "d", "y"), types, strict=True))})

    return run


def knn(queries: DataFrame, refs: DataFrame, k: int = K, metric: str = "l2", shards: int | None = None, query_blocks: int | None = None, skip_own: bool = False) -> DataFrame:
    """qid, rank, ref_id, d, y for queries (qid, v) and refs (ref_id, v, y): the k nearest, ties to the smaller ref_id. d is the
    squared distance for l2. skip_own: a reference with the query's own id is none of its neighbours.

    References are dealt to shards by a hash of their id, every shard meets every block of queries, and a task keeps k rows
    for each query; a ranking window over these finds the result. Nothing is broadcast: what is shuffled is the references once for
    each block and the queries once for each shard. Both numbers follow from counts, so a task's size is a constant; pass tables that are
    cheap to count."""
    shards = shards or max(1, -(-refs.count() // SHARD_ROWS))
    query_blocks = query_blocks or max(1, -(-queries.count() // BLOCK_ROWS))
    block = F.pmod(F.xxhash64("qid"), F.lit(query_blocks))
    number = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    q = queries.select("qid", F.col("v").alias("qv"), block.alias("qblock"), number(shards).alias("qshard"))
    r = refs.select("ref_id", "v", "y", F.pmod(F.xxhash64("ref_id"), F.lit(shards)).alias("shard"), number(query_blocks).alias("block"))

    near = q.groupBy("qshard", "qblock").cogroup(r.groupBy("shard", "block")).applyInArrow(group_search(k, metric, skip_own), FOUND)
    return rank(near, k)


def rank(near: DataFrame, k: int) -> DataFrame:
    """The k best of each query by (d, ref_id)."""
    place = Window.partitionBy("qid").orderBy("d", "ref_id")
    return near.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("qid", "rank", "ref_id", "d", "y")


def knn_pairs(queries: DataFrame, refs: DataFrame, k: int = K, dims: list[str] = DIMS, skip_own: bool = False) -> DataFrame:
    """The same result as a plan of joins alone, over scalar columns: all pairs, and a ranking window whose limit is applied
    before the shuffle. For small references: over BROADCAST_ROWS rows cells.knn() takes over."""
    if refs.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        array = lambda df: df.withColumn("v", F.array(*dims))
        from . import cells

        return cells.knn(array(queries), array(refs), k, skip_own=skip_own)
    r = F.broadcast(refs.select("ref_id", "y", *[F.col(c).alias(f"r_{c}") for c in dims]))
    pairs = queries.select("qid", *dims).join(r, F.col("qid") != F.col("ref_id") if skip_own else None)
    d = squared_distance([F.col(c) for c in dims], [F.col(f"r_{c}") for c in dims])
    return rank(pairs.select("qid", "ref_id", d.alias("d"), "y"), k)


def vote(neighbours: DataFrame, k: int = K) -> DataFrame:
    """qid, fraud_score: share of fraud among k, also where fewer neighbours are there."""
    return neighbours.groupBy("qid").agg((F.sum("y") / F.lit(float(k))).alias("fraud_score"))
