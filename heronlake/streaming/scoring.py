"""Online scoring with Structured Streaming: each request by itself with a model, or neighbour search batch by batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..operators import knn
from ..operators.vectorize import approved, response, vectorize
from ..plans import adapters, fixed
from ..schemas import DIMS, PAYLOAD
from ..sources.shared import shared_folder


def requests(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Payloads from a folder that JSON-lines files arrive in."""
    return spark.readStream.schema(PAYLOAD).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def score_served(payloads: DataFrame, engine: Engine, band: float = 10.0) -> DataFrame:
    """id, approved, fraud_score, body by the models that the engine has published: linear gate, then tree. A map over rows, so the same on
    batches and streams; a stream keeps the models it was started with."""
    return engine.score_served(payloads, band).select("id", "approved", "fraud_score", response(F.col("fraud_score")).alias("body"))


def score_by_neighbours(stream: DataFrame, refs: DataFrame, out: str, checkpoint: str):
    """Each micro-batch is answered by exact neighbour search against refs (ref_id, v, y) and appended to out as Parquet, in a folder of
    its own that a repeated batch overwrites: every request is answered exactly once."""

    def answer(batch: DataFrame, number: int) -> None:
        q = vectorize(batch, ["id"]).select(F.xxhash64("id").alias("qid"), "id", F.array(*DIMS).alias("v"))
        votes = knn.vote(knn.knn(q.select("qid", "v"), refs))
        q.select("qid", "id").join(votes, "qid").select("id", "fraud_score", approved(F.col("fraud_score")).alias("approved")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def history_features(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """user_id, window, n: transactions of the day by user, sliding by the hour; late rows up to delay count."""
    return events.withWatermark("ts", delay).groupBy("user_id", F.window("ts", "24 hours", "1 hour")).agg(F.count("*").alias("n"))


def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of requests, scored by the served model: id, approved, fraud_score."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    adapters.payloads(spark, sf_dir).select(*[f.name for f in PAYLOAD.fields]).write.json(f"{base}/in", ignoreNullFields=False)
    engine = Engine()
    engine.publish_models(fixed.WEIGHTS, fixed.INTERCEPT, fixed.TREE)
    scored = score_served(requests(spark, f"{base}/in"), engine, band=2.0)
    started = scored.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.read.schema("id string, approved boolean, fraud_score double, body string").parquet(f"{base}/out")
