"""Sources: JSON payloads and references, configuration, packed matrices, tree files, registries, script settings."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.models import Node, check_tree
from ..schemas import MCC_RISK, NORMALIZATION, PARTICIPANT, PAYLOAD, REFERENCE, TEST_ENTRY


def payloads(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Payloads from a JSON array (one task a file; convert large ones to Parquet once) or from JSON lines."""
    return spark.read.schema(PAYLOAD).option("multiLine", not lines).json(path)


def references(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """vector, label; a vector of another length or a missing label is an error when the row is read."""
    rows = spark.read.schema(REFERENCE).option("multiLine", not lines).option("mode", "FAILFAST").json(path)
    good = (F.size("vector") == 14) & F.col("label").isin("fraud", "legit")
    message = F.concat(F.lit("not a reference: "), F.coalesce(F.to_json(F.struct("vector", "label")), F.lit("null")))
    return rows.select(F.when(good, F.col("vector")).otherwise(F.raise_error(message).cast("array<double>")).alias("vector"), "label")


def strict_payloads(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """payloads(), but a cut-off file, another document than objects or a value of a wrong type is an error when the row is read."""
    return spark.read.schema(PAYLOAD).option("multiLine", not lines).option("mode", "FAILFAST").json(path)


def golden_stats(spark: SparkSession, path: str) -> DataFrame:
    """One row: the stats of a document (or of the stats folder of write_golden) and references_checksum_sha256."""
    stats = "stats struct<total: long, fraud_count: long, legit_count: long, fraud_rate: double, legit_rate: double, edge_case_count: long, edge_case_rate: double>"
    return spark.read.schema(stats + ", references_checksum_sha256 string").option("multiLine", True).json(path).select("stats.*", "references_checksum_sha256")


def test_entries(spark: SparkSession, path: str) -> DataFrame:
    """request, expected_approved, expected_fraud_score from a document with an entries array."""
    document = "entries array<" + TEST_ENTRY.simpleString() + ">"
    return spark.read.schema(document).option("multiLine", True).json(path).select(F.explode("entries").alias("e")).select("e.*")


def normalization(spark: SparkSession, path: str) -> dict[str, float]:
    """Ceilings; what the file lacks has its default. One row."""
    row = spark.read.schema(", ".join(f"{k} double" for k in NORMALIZATION)).option("multiLine", True).json(path).first()
    found = row.asDict() if row else {}
    return {k: found[k] if found.get(k) is not None else v for k, v in NORMALIZATION.items()}


def mcc_risk(spark: SparkSession, path: str | None) -> dict[str, float]:
    """Category risks; a path of None means an empty map, so that every category has the default."""
    if path is None:
        return {}
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,double>").alias("m")).first()
    return dict(text["m"]) if text and text["m"] is not None else dict(MCC_RISK)


def packed_matrix(spark: SparkSession, path: str, columns: int, kind: str = "<f4") -> DataFrame:
    """row_id, v from files of packed rows: f4 or i2, row-major. A file is one task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                m = np.frombuffer(content, kind).reshape(-1, columns)
                for at in range(0, len(m), 10_000):
                    part = m[at : at + 10_000].astype(float)
                    yield pd.DataFrame({"row_id": range(at, at + len(part)), "v": list(part)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "row_id long, v array<double>")


def parse_tree(content: bytes, tree: int = 0, at: int = 0) -> tuple[list[Node], int]:
    """A tree's node count and nodes (feature, threshold, left, right, value; 20 bytes each), and where it ends."""
    if len(content) < at + 4:
        raise ValueError("the file ends in a tree's header")
    (n,) = struct.unpack_from("<i", content, at)
    if n < 1 or len(content) < at + 4 + 20 * n:
        raise ValueError("the file ends within a tree")
    nodes = [(tree, i, *struct.unpack_from("<ifiif", content, at + 4 + 20 * i)) for i in range(n)]
    check_tree(nodes)
    return nodes, at + 4 + 20 * n


def parse_forest(content: bytes) -> tuple[list[Node], float]:
    """Nodes and threshold of: trees, features, the trees, threshold."""
    if len(content) < 8:
        raise ValueError("the file ends in the header")
    trees, _ = struct.unpack_from("<ii", content)
    nodes, at = [], 8
    for t in range(trees):
        more, at = parse_tree(content, t, at)
        nodes += more
    if len(content) != at + 4:
        raise ValueError("the file has no trailer of 4 bytes")
    return nodes, struct.unpack_from("<f", content, at)[0]


def forest(spark: SparkSession, path: str) -> tuple[list[Node], float]:
    """One model file, through Spark's reader, so from any store."""
    return parse_forest(bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"]))


def tree(spark: SparkSession, path: str) -> list[Node]:
    return parse_tree(bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"]))[0]


def linear_model(spark: SparkSession, path: str, intercept_path: str) -> tuple[list[float], float]:
    load = lambda p: np.frombuffer(bytes(spark.read.format("binaryFile").load(p).select("content").first()["content"]), "<f4")
    return load(path).astype(float).tolist(), float(load(intercept_path)[0])


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def participants(spark: SparkSession, folder: str) -> DataFrame:
    """participant, id, repo; a file that is no array of entries gives one row with nulls."""
    rows = spark.read.text(f"{folder}/*.json", wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1).alias("participant"), "value")
    entries = F.from_json("value", "array<" + PARTICIPANT.simpleString() + ">")
    plain = F.when(F.col("value").rlike(r"^\s*\["), entries)
    return rows.select("participant", F.explode_outer(plain).alias("e")).select("participant", "e.id", "e.repo")


def ramp_settings(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """Start rate and stages (stage, duration, target) from the text of a load script."""
    text = spark.read.text(path, wholetext=True)
    numbers = lambda p: F.transform(F.regexp_extract_all("value", F.lit(p), 1), lambda x: x.cast("long"))
    row = text.select(numbers(r"startRate:\s*(\d+)")[0].alias("start"), F.arrays_zip(numbers(r"duration:\s*'(\d+)").alias("duration"), numbers(r"target:\s*(\d+)").alias("target")).alias("s"))
    stages = row.select(F.posexplode("s").alias("i", "x")).select((F.col("i") + 1).alias("stage"), "x.duration", "x.target")
    return int(row.first()["start"]), stages
