"""Connected components of links between longs, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables


def components(links: DataFrame, tables: Tables, name: str) -> DataFrame:
    """node, root for every node of links(a, b): root is the same for connected nodes, and one of them.

    Each round hooks every node to its least neighbour, if smaller, follows these pointers four steps, and contracts the
    links. Chains of pointers shorten by that factor, so rounds are logarithmic. Rounds are written tables; all steps are
    minima and joins, so a hub's links are split among tasks."""
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    links = tables.write(links, f"{name}-links0")
    labels, i = None, 0
    while not links.isEmpty():
        # links run from the smaller to the larger node, so all pointers fall and make no circle
        parent = tables.write(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")), f"{name}-up{i}")
        for _ in range(2):
            parent = _follow(parent, parent, "node", "up")
        parent = tables.write(parent, f"{name}-parent{i}")
        if labels is None:
            nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
            labels = nodes.withColumn("root", F.col("node"))
        labels = tables.write(_follow(labels, parent, "node", "root"), f"{name}-labels{i}")
        moved = _follow(_follow(links, parent, "b", "a"), parent, "a", "b")
        moved = moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
        old = i
        i += 1
        links = tables.write(moved, f"{name}-links{i}")
        for kind in ("links", "up", "parent"):
            tables.drop(f"{name}-{kind}{old}")
        if old:
            tables.drop(f"{name}-labels{old - 1}")
    if labels is None:
        labels = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels


def _follow(rows: DataFrame, pointers: DataFrame, keep: str, column: str) -> DataFrame:
    """rows with column replaced by where it points, if it does."""
    to = pointers.select(F.col("node").alias("_n"), F.col("up").alias("_u"))
    return rows.join(to, rows[column] == F.col("_n"), "left").select(keep, F.coalesce("_u", column).alias(column))
