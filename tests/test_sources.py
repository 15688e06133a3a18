"""Sources and sinks: round trips, and what malformed input does."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from heronlake.engine import Engine
from heronlake.operators import generate
from heronlake.plans import fixed
from heronlake.schemas import PAYLOAD
from heronlake.sources import readers, sinks
from heronlake.streaming import scoring

REF = {"vector": [0.1] * 14, "label": "fraud"}


def test_gz_references_and_bad_rows(spark, tmp_path):
    with gzip.open(tmp_path / "r.json.gz", "wt") as f:
        json.dump([REF, REF | {"label": "legit"}], f)
    assert readers.references(spark, str(tmp_path / "r.json.gz")).groupBy("label").count().count() == 2
    (tmp_path / "bad.json").write_text(json.dumps([REF | {"vector": [1.0]}]))
    with pytest.raises(Exception, match="not a reference"):
        readers.references(spark, str(tmp_path / "bad.json")).collect()


def test_payload_json_round_trip(spark, tmp_path):
    rows = generate.payloads(spark, 50).select(*PAYLOAD.names)
    sinks.write_json(rows, str(tmp_path / "out"))
    back = readers.payloads(spark, str(tmp_path / "out"), lines=True)
    assert back.count() == 50 and back.where("last_transaction is null").count() == rows.where("last_transaction is null").count()
    assert "last_transaction\":null" in "".join(p.read_text() for p in (tmp_path / "out").glob("part*"))


def test_configuration(spark, tmp_path):
    (tmp_path / "n.json").write_text('{"max_km": 500}')
    (tmp_path / "m.json").write_text('{"1": 0.25}')
    found = readers.normalization(spark, str(tmp_path / "n.json"))
    assert found["max_km"] == 500 and found["max_amount"] == 10000
    assert readers.mcc_risk(spark, str(tmp_path / "m.json")) == {"1": 0.25} and readers.mcc_risk(spark, None) == {}


def test_packed_matrix(spark, tmp_path):
    np.arange(28, dtype="<i2").tofile(tmp_path / "m.bin")
    rows = readers.packed_matrix(spark, str(tmp_path / "m.bin"), 14, "<i2").orderBy("row_id").collect()
    assert [r.v[0] for r in rows] == [0.0, 14.0]
    np.array([1, 2], "<f4").tofile(tmp_path / "w.bin")
    np.array([3], "<f4").tofile(tmp_path / "w0.bin")
    assert readers.linear_model(spark, str(tmp_path / "w.bin"), str(tmp_path / "w0.bin")) == ([1.0, 2.0], 3.0)


def test_participants_with_a_malformed_file(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "x", "repo": "r"}, {"id": "y", "repo": "s"}]')
    (tmp_path / "b.json").write_text('{"name": "b", "repos": []}')
    found = sorted((r.participant, r.id or "") for r in readers.participants(spark, str(tmp_path)).collect())
    assert found == [("a", "x"), ("a", "y"), ("b", "")]


def test_ramp_settings(spark, tmp_path):
    (tmp_path / "t.js").write_text("startRate: 1,\nstages: [{ duration: '60s', target: 450 }, { duration: '60s', target: 900 }]")
    start, stages = readers.ramp_settings(spark, str(tmp_path / "t.js"))
    assert start == 1 and [tuple(r) for r in stages.orderBy("stage").collect()] == [(1, 60, 450), (2, 60, 900)]


def test_upsert_and_checksums(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(tuple(r) for r in sinks.upsert(old, new, ["k"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    (tmp_path / "x").write_bytes(b"abc")
    assert readers.checksums(spark, str(tmp_path / "x")).first().sha256.startswith("ba7816bf")


def test_stream_equals_batch(spark, tmp_path):
    rows = generate.payloads(spark, 60).select(*PAYLOAD.names)
    sinks.write_json(rows, str(tmp_path / "in"))
    served = Engine()
    served.publish_models(fixed.WEIGHTS, fixed.INTERCEPT, fixed.TREE)
    batch = scoring.score_served(readers.payloads(spark, str(tmp_path / "in"), lines=True), served)
    stream = scoring.score_served(scoring.requests(spark, str(tmp_path / "in")), served)
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    key = lambda df: sorted((r.id, r.approved, r.body) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(batch)


def test_stream_by_neighbours(spark, tmp_path):
    rows = generate.payloads(spark, 10, seed=3).select(*PAYLOAD.names)
    sinks.write_json(rows, str(tmp_path / "in"))
    refs = generate.references(spark, 100).select(F.monotonically_increasing_id().alias("ref_id"), F.col("vector").alias("v"), (F.col("label") == "fraud").cast("int").alias("y"))
    scoring.score_by_neighbours(scoring.requests(spark, str(tmp_path / "in")), refs, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).select("id").distinct().count() == 10


def test_golden_document_and_its_stats(spark, tmp_path):
    requests = generate.payloads(spark, 60, seed=7).select(F.xxhash64("id").alias("qid"), *[f.name for f in PAYLOAD.fields])
    refs = generate.references(spark, 200).select(F.monotonically_increasing_id().alias("ref_id"), F.col("vector").alias("v"), F.when(F.col("label") == "fraud", 1).otherwise(0).alias("y"))
    entries = generate.golden_entries(requests, refs)
    sinks.write_golden(entries, str(tmp_path), "abc")
    found = spark.read.json(str(tmp_path / "entries")).groupBy("expected_approved").count().collect()
    by = {r["expected_approved"]: r["count"] for r in found}
    stats = readers.golden_stats(spark, str(tmp_path / "stats")).first()
    assert stats["total"] == 60 == sum(by.values()) and stats["fraud_count"] == by.get(False, 0) > 0
    assert stats["legit_count"] == by.get(True, 0) > 0 and stats["references_checksum_sha256"] == "abc"
    alone = generate.golden_entries(requests, refs.limit(0)).select("expected_approved", "expected_fraud_score").distinct().collect()
    assert [tuple(r) for r in alone] == [(True, 0.0)]


@pytest.mark.parametrize("text", ['[{"id": "a"}, {"id": ', '"no array"', '[{"id": "a", "transaction": 3}]'])
def test_strict_payloads_raise(spark, tmp_path, text):
    (tmp_path / "p.json").write_text('[{"id": "a"}, {"id": "b"}]')
    assert [r.id for r in readers.strict_payloads(spark, str(tmp_path / "p.json")).collect()] == ["a", "b"]
    (tmp_path / "q.json").write_text(text)
    with pytest.raises(Exception):
        readers.strict_payloads(spark, str(tmp_path / "q.json")).collect()
