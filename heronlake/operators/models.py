"""Scores and decisions of models: linear, trees and forests, rules, centroids, Mahalanobis; gates and hybrids of them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import dot, fold_sum
from ..schemas import DIMS

#: Fixed: the predicates' weights in hundredths, added as whole numbers so that cuts are exact.
RISK_WEIGHTS = (15, 10, 15, 15, 15, 10, 10, 10)


def columns(names: Sequence[str] = DIMS) -> list[Column]:
    return [F.col(n) for n in names]


def linear_score(weights: Sequence[float], intercept: float, names: Sequence[str] = DIMS) -> Column:
    return dot(columns(names), list(weights)) + intercept


def risk_points() -> Column:
    """Hundredths of risk by eight rules."""
    d = columns()
    rules = [d[0] > 0.7, d[1] > 0.6, d[2] > 0.8, d[7] > 0.7, d[11] == 1, d[12] > 0.6, d[8] > 0.8, (d[5] == -1.0) & (d[0] > 0.5)]
    return fold_sum([F.when(r, w).otherwise(0) for r, w in zip(rules, RISK_WEIGHTS, strict=True)])


def fast_path(points: Column, legit: int = 15, fraud: int = 70) -> Column:
    """legit_fast, fraud_fast or miss. Cuts in hundredths."""
    d = columns()
    safe = (points < legit) & (d[10] == 1) & (d[11] == 0) & (d[0] < 0.3)
    return F.when(safe, "legit_fast").when(points > fraud, "fraud_fast").otherwise("miss")


def ratio_of(legit: Column, fraud: Column) -> Column:
    return legit / (fraud + legit + 1e-10)


def cut_ratio(ratio: Column, high: float, low: float) -> Column:
    return F.when(ratio > high, "fraud").when(ratio < low, "legit").otherwise("knn")


def class_means(rows: DataFrame, names: Sequence[str] = DIMS) -> DataFrame:
    """y, n and the mean of each column."""
    return rows.groupBy("y").agg(F.count("*").alias("n"), *[F.avg(n).alias(n) for n in names])


def class_covariances(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """y, i, j, cov for i <= j: one pass, one row of moments for each class, unpivoted."""
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    wide = rows.groupBy("y").agg(*[F.covar_samp(names[i], names[j]).alias(f"c_{i}_{j}") for i, j in pairs])
    return wide.select("y", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c_{i}_{j}").alias("cov")) for i, j in pairs])).alias("x")).select("y", "x.*")


def pooled_covariance(rows: DataFrame, names: Sequence[str] = DIMS, ridge: float = 0.01) -> DataFrame:
    """i, j, cov for i <= j: the mean of the two classes' covariances, with a ridge on the diagonal."""
    ridged = F.when(F.col("i") == F.col("j"), ridge).otherwise(0.0)
    return class_covariances(rows, names).groupBy("i", "j").agg((F.sum("cov") / 2.0).alias("cov")).select("i", "j", (F.col("cov") + ridged).alias("cov"))


@dataclass
class Moments:
    """Means and covariances of the two classes: a bounded result of one aggregation, for solving on the driver."""

    n: dict[int, int]
    mean: dict[int, np.ndarray]
    cov: dict[int, np.ndarray]

    @staticmethod
    def of(rows: DataFrame, names: Sequence[str] = DIMS) -> Moments:
        size = len(names)
        means = {r["y"]: r for r in class_means(rows, names).collect()}
        cov = {y: np.zeros((size, size)) for y in means}
        for r in class_covariances(rows, names).collect():
            cov[r["y"]][r["i"], r["j"]] = cov[r["y"]][r["j"], r["i"]] = r["cov"] or 0.0
        return Moments({y: r["n"] for y, r in means.items()}, {y: np.array([r[n] for n in names]) for y, r in means.items()}, cov)

    def pooled(self, ridge: float = 0.01) -> np.ndarray:
        return (self.cov[0] + self.cov[1]) / 2 + ridge * np.eye(len(self.mean[0]))


def lda_closed_form(m: Moments) -> tuple[list[float], float]:
    """Mean of the class covariances plus a ridge, no prior."""
    w = np.linalg.solve(m.pooled(), m.mean[1] - m.mean[0])
    return w.tolist(), float(-0.5 * w @ (m.mean[1] + m.mean[0]))


def lda_prior(m: Moments) -> tuple[list[float], float]:
    """Within-class covariance weighted by class, and the log prior in the intercept."""
    total = m.n[0] + m.n[1]
    within = sum((m.n[y] - 1) * m.cov[y] for y in (0, 1)) / total
    w = np.linalg.lstsq(within, m.mean[1] - m.mean[0], rcond=None)[0]
    return w.tolist(), float(-0.5 * w @ (m.mean[1] + m.mean[0]) + np.log(m.n[1] / m.n[0]))


def mahalanobis_squared(names: Sequence[str], mean: Sequence[float], inverse: Sequence[Sequence[float]]) -> Column:
    diff = [F.col(n) - float(m) for n, m in zip(names, mean, strict=True)]
    return fold_sum([diff[i] * diff[j] * float(inverse[i][j]) for i in range(len(diff)) for j in range(len(diff))])


def mahalanobis_difference(names: Sequence[str], legit: Sequence[float], fraud: Sequence[float], inverse: Sequence[Sequence[float]]) -> Column:
    """Squared distance to the legit mean less that to the fraud mean: positive means nearer to fraud."""
    return mahalanobis_squared(names, legit, inverse) - mahalanobis_squared(names, fraud, inverse)


def project(matrix: Sequence[Sequence[float]], names: Sequence[str] = DIMS) -> list[Column]:
    """Rows of the matrix times the vector."""
    return [dot(columns(names), list(row)) for row in matrix]


Node = tuple[int, int, int, float, int, int, float]


def check_tree(nodes: Sequence[Node]) -> None:
    """Children must exist and come after their parent, features be known."""
    ids = {(n[0], n[1]) for n in nodes}
    for tree, node, feature, _, left, right, _ in nodes:
        if feature >= 0 and not (left > node and right > node and {(tree, left), (tree, right)} <= ids and feature < 14):
            raise ValueError(f"tree {tree}, node {node} is not well formed")


def leaf_boxes(nodes: Sequence[Node]) -> list[tuple[int, float, list[float], list[float]]]:
    """(tree, value, lows, highs) of each leaf: a vector ends there if low < x <= high in every dimension."""
    by = {(n[0], n[1]): n for n in nodes}
    out = []
    for tree in sorted({n[0] for n in nodes}):
        todo = [(0, [-1e30] * 14, [1e30] * 14)]
        while todo:
            node, low, high = todo.pop()
            _, _, feature, threshold, left, right, value = by[tree, node]
            if feature < 0:
                out.append((tree, value, low, high))
                continue
            cut = float(np.float32(threshold))
            todo.append((left, low, [min(h, cut) if i == feature else h for i, h in enumerate(high)]))
            todo.append((right, [max(x, cut) if i == feature else x for i, x in enumerate(low)], high))
    return out


def tree_value(nodes: Sequence[Node], tree: int = 0, names: Sequence[str] = DIMS) -> Column:
    """The leaf's value as nested conditions, evaluated by the JVM within the row; x <= threshold goes left, compared as floats.
    For trees of some hundred nodes; larger ones are joined as leaf boxes."""
    by = {n[1]: n for n in nodes if n[0] == tree}

    def at(node: int) -> Column:
        _, _, feature, threshold, left, right, value = by[node]
        if feature < 0:
            return F.lit(float(np.float32(value)))
        return F.when(F.col(names[feature]).cast("float") <= F.lit(float(threshold)).cast("float"), at(left)).otherwise(at(right))

    return at(0)


def predict_boxes(rows: DataFrame, row_id: str, nodes: Sequence[Node]) -> DataFrame:
    """row_id, tree_id, value by a range join with the leaves, which are bounded by the model and broadcast."""
    check_tree(nodes)
    boxes = [(t, float(np.float32(v)), *low, *high) for t, v, low, high in leaf_boxes(nodes)]
    schema = "tree_id int, value double, " + ", ".join(f"lo{i} float" for i in range(14)) + ", " + ", ".join(f"hi{i} float" for i in range(14))
    leaves = F.broadcast(rows.sparkSession.createDataFrame(boxes, schema))
    inside = None
    for i, n in enumerate(DIMS):
        x = F.col(n).cast("float")
        c = (x > F.col(f"lo{i}")) & (x <= F.col(f"hi{i}"))
        inside = c if inside is None else inside & c
    return rows.select(row_id, *DIMS).join(leaves, inside).select(row_id, "tree_id", "value")


def forest_probability(nodes: Sequence[Node], names: Sequence[str] = DIMS) -> Column:
    """The mean of the trees' values, in order of trees."""
    trees = sorted({n[0] for n in nodes})
    return fold_sum([tree_value(nodes, t, names) for t in trees]) / float(len(trees))


def gate(score: Column, fallback: Column, band: float = 10.0) -> Column:
    """1 over the band, 0 under it, else whether the fallback is over a half."""
    return F.when(score > band, 1).when(score < -band, 0).otherwise(F.when(fallback > 0.5, 1).otherwise(0))


def classify(probability: Column, threshold: float, strict: bool = False) -> Column:
    """>= for forests, > where strict, as served trees are compared."""
    return F.when(probability > threshold if strict else probability >= threshold, 1).otherwise(0)


def uncertain(probability: Column, threshold: float, band: float) -> Column:
    return F.abs(probability - threshold) <= band
