"""Training: k-means centroids, truncated SVD, trees and forests, threshold search."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import DIMS
from . import evaluate
from .models import Node

#: Rows that a tree ensemble is grown from on the driver; a documented bound, the first by a hash of the row.
SAMPLE_ROWS = 50_000


def first_of_each_class(rows: DataFrame, n: int, order: str = "event_id") -> DataFrame:
    """The first n rows of each class by id; the limit is applied in each task before the shuffle."""
    place = F.row_number().over(Window.partitionBy("y").orderBy(order))
    return rows.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def kmeans_centroids(rows: DataFrame, k: int, seed: int = 42, iterations: int = 10) -> DataFrame:
    """cluster_id, c of (v)."""
    model = KMeans(k=k, seed=seed, maxIter=iterations, featuresCol="x").fit(rows.select(array_to_vector("v").alias("x")))
    centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return rows.sparkSession.createDataFrame(centres, "cluster_id long, c array<double>")


def gram(rows: DataFrame, names: Sequence[str] = DIMS) -> DataFrame:
    """i, j, total for i <= j: sums of products of columns, as one aggregation inside the JVM."""
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    wide = rows.agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"g_{i}_{j}") for i, j in pairs])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"g_{i}_{j}").alias("total")) for i, j in pairs])).alias("x")).select("x.*")


def truncated_svd(rows: DataFrame, k: int, names: Sequence[str] = DIMS) -> list[list[float]]:
    """The k first right singular vectors of the uncentred rows, as rows; the entry of largest size is positive. They are the
    eigenvectors of gram(), which has as many entries as the columns squared. Without rows: an error."""
    products = np.zeros((len(names), len(names)))
    for r in gram(rows, names).collect():
        if r["total"] is None:
            raise ValueError("no rows to decompose")
        products[r["i"], r["j"]] = products[r["j"], r["i"]] = r["total"]
    v = np.linalg.eigh(products)[1][:, ::-1].T[:k]
    signs = np.sign(v[np.arange(len(v)), np.abs(v).argmax(axis=1)])
    return (v * signs[:, None]).tolist()


def _labelled(rows: DataFrame) -> DataFrame:
    """Features, label and weights that balance the classes: n / (2 n_c)."""
    counts = rows.groupBy("y").agg(F.count("*").alias("nc"))
    total = counts.agg(F.sum("nc").alias("n"))
    weights = counts.join(F.broadcast(total)).select("y", (F.col("n") / (2.0 * F.col("nc"))).alias("weight"))  # two rows
    assembled = VectorAssembler(inputCols=list(DIMS), outputCol="x").transform(rows.select("y", *DIMS))
    return assembled.join(F.broadcast(weights), "y").select("x", F.col("y").cast("double").alias("label"), "weight", "y")


def tree_nodes(java_root: object, tree: int = 0) -> list[Node]:
    """A Spark tree as node rows, children after parents."""
    out: list[list] = []

    def add(node) -> int:
        me, kind = len(out), node.getClass().getSimpleName()
        stats = node.impurityStats().stats()
        total = sum(stats)
        out.append([tree, me, -1, 0.0, -1, -1, float(stats[1] / total) if total else 0.0])
        if kind == "InternalNode":
            out[me][2:4] = [int(node.split().featureIndex()), float(node.split().threshold())]
            out[me][4] = add(node.leftChild())
            out[me][5] = add(node.rightChild())
        return me

    add(java_root)
    return [tuple(x) for x in out]


def train_cart(rows: DataFrame, depth: int = 12, leaf: int = 50) -> list[Node]:
    """A balanced Gini tree. Splits are binned, so trees differ from those of exact splitters."""
    model = DecisionTreeClassifier(featuresCol="x", labelCol="label", weightCol="weight", maxDepth=depth, minInstancesPerNode=leaf, impurity="gini", seed=42).fit(_labelled(rows))
    return tree_nodes(model._java_obj.rootNode())


def forest_search(rows: DataFrame, grid: Sequence[tuple[int, int]], thresholds: Sequence[float] | None = None, leaf: int = 1) -> tuple[int, int, float, int]:
    """(trees, depth, threshold, penalty) of the lowest penalty; thresholds of a model are swept in one pass."""
    thresholds = thresholds or [round(0.3 + i * 0.005, 3) for i in range(81)]
    data, best = _labelled(rows).persist(), None
    try:
        for trees, depth in grid:
            forest = RandomForestClassifier(featuresCol="x", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=42).fit(data)
            scored = forest.transform(data).select(vector_to_array("probability")[1].alias("probability"), F.col("y").alias("expected"))
            row = evaluate.best(evaluate.sweep(scored, thresholds)).first()
            found = (trees, depth, float(row["threshold"]), int(row["penalty"]))
            if best is None or found[3] < best[3]:
                best = found
    finally:
        data.unpersist()
    return best


def train_extra_trees(rows: DataFrame, trees: int = 20, depth: int = 8, leaf: int = 5, seed: int = 42, most: int = SAMPLE_ROWS) -> list[Node]:
    """Extremely randomized trees, which Spark ML lacks: random cuts of random features, the best by Gini. Grown on the driver from
    at most so many rows."""
    sample = rows.select("y", *DIMS).orderBy(F.xxhash64(*DIMS), *DIMS).limit(most).toPandas()
    x, y, rng = sample[DIMS].to_numpy(np.float32), sample["y"].to_numpy(float), np.random.default_rng(seed)
    out: list[Node] = []

    def grow(tree: int, nodes: list[list], at: np.ndarray, left: int) -> int:
        me, share = len(nodes), float(y[at].mean()) if len(at) else 0.0
        nodes.append([tree, me, -1, 0.0, -1, -1, share])
        if not left or len(at) < 2 * leaf or share in (0.0, 1.0):
            return me
        best = None
        for f in rng.choice(x.shape[1], 4, replace=False):
            low, high = x[at, f].min(), x[at, f].max()
            if low < high:
                cut = np.float32(rng.uniform(low, high))
                goes = x[at, f] <= cut
                n, m = goes.sum(), (~goes).sum()
                if min(n, m) >= leaf:
                    p, q = y[at][goes].mean(), y[at][~goes].mean()
                    gini = n * p * (1 - p) + m * q * (1 - q)
                    if best is None or gini < best[0]:
                        best = (gini, int(f), float(cut), goes)
        if best is None:
            return me
        nodes[me][2:4] = best[1:3]
        nodes[me][4] = grow(tree, nodes, at[best[3]], left - 1)
        nodes[me][5] = grow(tree, nodes, at[~best[3]], left - 1)
        return me

    for t in range(trees):
        nodes: list[list] = []
        grow(t, nodes, np.arange(len(x)), depth)
        out += [tuple(n) for n in nodes]
    return out
