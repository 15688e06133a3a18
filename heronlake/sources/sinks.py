"""Sinks: JSON, clustered Parquet, packed matrices, tree files, upserts, results."""

from __future__ import annotations

import struct
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.evaluate import dataset_stats
from ..operators.models import Node


def write_json(df: DataFrame, path: str, pretty: bool = False) -> None:
    """JSON lines that keep nulls; pretty: indented documents, one a row."""
    options = {"ignoreNullFields": "false"} | ({"pretty": "true"} if pretty else {})
    df.select(F.to_json(F.struct(*df.columns), options).alias("value")).write.mode("overwrite").text(path)


def write_golden(entries: DataFrame, path: str, references_checksum: str) -> None:
    """entries (request, expected_approved, expected_fraud_score) as JSON lines under path/entries, and one row under path/stats: the counts and
    rates of the entries as written, with the references' SHA-256."""
    write_json(entries.select("request", "expected_approved", "expected_fraud_score"), f"{path}/entries")
    written = entries.sparkSession.read.schema("expected_approved boolean, expected_fraud_score double").json(f"{path}/entries")
    write_json(dataset_stats(written).select(F.struct("*").alias("stats"), F.lit(references_checksum).alias("references_checksum_sha256")), f"{path}/stats")


def write_clustered(index: DataFrame, path: str, partitions: int | None = None) -> None:
    """References by cluster, sorted within: later reads prune by cluster, and joins on it find its rows together."""
    spread = index.repartition(partitions, "cluster_id") if partitions else index.repartition("cluster_id")
    spread.sortWithinPartitions("cluster_id", "ref_id").write.mode("overwrite").parquet(path)


def write_bucketed(index: DataFrame, name: str, buckets: int = 32) -> None:
    """A table bucketed by cluster: joins on it need no shuffle of this side."""
    index.write.mode("overwrite").bucketBy(buckets, "cluster_id").sortBy("cluster_id", "ref_id").saveAsTable(name)


def pack_row(vector: Column) -> Column:
    """int16 values as hex of big-endian pairs; a packed row as text that any store keeps."""
    return F.array_join(F.transform(vector, lambda x: F.lpad(F.hex(F.pmod(x.cast("int"), F.lit(65536))), 4, "0")), "")


def tree_bytes(nodes: Sequence[Node]) -> bytes:
    return struct.pack("<i", len(nodes)) + b"".join(struct.pack("<ifiif", *n[2:]) for n in nodes)


def forest_bytes(nodes: Sequence[Node], features: int, threshold: float) -> bytes:
    trees = sorted({n[0] for n in nodes})
    return struct.pack("<ii", len(trees), features) + b"".join(tree_bytes([n for n in nodes if n[0] == t]) for t in trees) + struct.pack("<f", threshold)


def set_threshold(content: bytes, threshold: float) -> bytes:
    """A forest file with another threshold in its trailer."""
    return content[:-4] + struct.pack("<f", threshold)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new, and what of old has no row of the same keys in new."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*old.columns))


def result_document(scored: DataFrame) -> DataFrame:
    """The nested result of an evaluation: one document a row."""
    c = F.col
    return scored.select(
        c("p99"),
        F.struct(
            F.struct(c("fp").alias("false_positive_detections"), c("fn").alias("false_negative_detections"), c("tp").alias("true_positive_detections"), c("tn").alias("true_negative_detections"), c("err").alias("http_errors")).alias("breakdown"),
            F.round("failure_rate", 6).alias("failure_rate"),
            c("weighted_errors").alias("weighted_errors_E"),
            c("epsilon").alias("error_rate_epsilon"),
            F.struct(c("p99_score").alias("value"), (c("p99") > 2000).alias("cut_triggered")).alias("p99_score"),
            F.struct(c("detection_score").alias("value"), (c("failure_rate") > 0.15).alias("cut_triggered")).alias("detection_score"),
            c("final_score"),
        ).alias("scoring"),
    )
