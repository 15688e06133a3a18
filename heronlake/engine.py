"""A small front: publishes models and references, says whether it is ready, scores payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators import knn, models
from .operators.vectorize import approved, vectorize
from .schemas import DIMS


class Engine:
    """Holds a linear model, a tree and references (ref_id, v, y). What is published is replaced as a whole."""

    def __init__(self) -> None:
        self.linear: tuple[Sequence[float], float] | None = None
        self.tree: Sequence[models.Node] | None = None
        self.refs: DataFrame | None = None

    def publish_models(self, weights: Sequence[float], intercept: float, tree: Sequence[models.Node]) -> None:
        models.check_tree(tree)
        self.linear, self.tree = (list(weights), intercept), list(tree)

    def publish_references(self, refs: DataFrame, view: str = "reference_vectors") -> None:
        """Makes the references a view for SQL; they are read where they are stored, not held in the driver."""
        refs.createOrReplaceTempView(view)
        self.refs = refs

    def ready(self) -> bool:
        """Whether requests can be served: the models are there."""
        return self.linear is not None and self.tree is not None

    def score_served(self, payloads: DataFrame, band: float = 10.0) -> DataFrame:
        """id, fraud_score, approved by the linear gate and the tree, on unrounded features."""
        if not self.ready():
            raise RuntimeError("no models are published")
        weights, intercept = self.linear
        fraud = models.gate(models.linear_score(weights, intercept), models.tree_value(self.tree), band).cast("double")
        return _decided(vectorize(payloads, ["id"], rounded=False).select("id", fraud.alias("fraud_score")))

    def score_exact(self, payloads: DataFrame, shards: int | None = None, query_blocks: int = 1) -> DataFrame:
        """id, fraud_score, approved by exact neighbours, on features to four decimals."""
        if self.refs is None:
            raise RuntimeError("no references are published")
        q = vectorize(payloads, ["id"]).select(F.xxhash64("id").alias("qid"), "id", F.array(*DIMS).alias("v"))
        votes = knn.vote(knn.knn(q.select("qid", "v").dropDuplicates(["qid"]), self.refs, shards=shards, query_blocks=query_blocks))
        return _decided(q.select("qid", "id").join(votes, "qid", "left").select("id", "fraud_score"))


def _decided(scored: DataFrame) -> DataFrame:
    score: Column = F.col("fraud_score")
    return scored.select("id", "fraud_score", approved(score).alias("approved"))
