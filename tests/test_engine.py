import pytest
from pyspark.sql import functions as F

from heronlake.engine import Engine
from heronlake.operators import generate
from heronlake.plans import fixed


def test_engine_serves_when_models_are_published(spark):
    engine, payloads = Engine(), generate.payloads(spark, 40)
    assert not engine.ready()
    with pytest.raises(RuntimeError):
        engine.score_served(payloads)
    engine.publish_models(fixed.WEIGHTS, fixed.INTERCEPT, fixed.TREE)
    assert engine.ready()
    assert engine.score_served(payloads).where("approved = (fraud_score < 0.6)").count() == 40


def test_engine_scores_by_neighbours(spark):
    engine, payloads = Engine(), generate.payloads(spark, 30, seed=5)
    refs = generate.references(spark, 500, seed=6).select(F.monotonically_increasing_id().alias("ref_id"), F.col("vector").alias("v"), (F.col("label") == "fraud").cast("int").alias("y"))
    engine.publish_references(refs)
    found = engine.score_exact(payloads).join(payloads.select("id", "profile"), "id").collect()
    assert len(found) == 30 and spark.table("reference_vectors").count() == 500
    assert all(x.approved for x in found if x.profile == "legit") and not any(x.approved for x in found if x.profile == "fraud")
