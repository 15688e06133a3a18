"""The driver's tables as transactions, references and queries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import merchant_id
from ..operators.vectorize import vectorize
from ..schemas import DIMS, MCC_RISK
from ..sources.shared import Tables

#: Category codes by event: the known ones in file order and two that are not listed.
CODES = [*MCC_RISK, "0000", "9999"]
#: Merchants up to which their averages are broadcast.
BROADCAST_ROWS = 10_000
#: Events of users that are shuffled at once where vectors are written, on average, and the most parts that this makes: each reads all events.
PART_ROWS, MOST_PARTS = 1_000_000, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"), F.round(F.col("value") * 100).cast("long").alias("c")
    )


def _merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each merchant's average over all events."""
    return _small(spark, _events(spark, sf_dir).groupBy("k").agg((F.sum("c") * 0.4 / F.count("*")).alias("merchant_avg")))


def payloads(spark: SparkSession, sf_dir: str, part: tuple[int, int] = (0, 1), merchants: DataFrame | None = None) -> DataFrame:
    """events as payloads, with event_id, k and y. Averages are grouped sums joined back, which combine before the shuffle; what needs
    a user's history in order is a window by user. part: number i of n parts by user; merchants: what _merchants() gave."""
    e = _events(spark, sf_dir)
    if part[1] > 1:
        e = e.where(F.pmod(F.xxhash64("user_id"), F.lit(part[1])) == part[0])
    users = e.groupBy("user_id").agg((F.sum("c") * 0.4 / F.count("*")).alias("user_avg"))
    merchants = _merchants(spark, sf_dir) if merchants is None else merchants
    history = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.selectExpr("*", "count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS n24")
    e = e.select("*", F.row_number().over(Window.partitionBy("user_id", "k").orderBy("ts", "event_id")).alias("nth"), F.lag("ts").over(history).alias("last_ts"), F.lag("k").over(history).alias("last_k"))
    e = e.join(users, "user_id").join(merchants, "k")
    code = F.element_at(F.array(*map(F.lit, CODES)), (F.col("k") % len(CODES) + 1).cast("int"))
    own = merchant_id("k")
    return e.select(
        "event_id",
        "k",
        F.when(F.col("k") >= 65, 1).otherwise(0).alias("y"),
        F.concat(F.lit("tx-"), F.col("event_id").cast("string")).alias("id"),
        F.struct((F.col("c") * 0.4).alias("amount"), (F.col("k") % 14 + 1).cast("int").alias("installments"), F.col("ts").cast("timestamp").alias("requested_at")).alias("transaction"),
        F.struct(
            F.when(F.col("user_id") % 10 == 0, 0.0).otherwise(F.col("user_avg")).alias("avg_amount"),
            F.col("n24").cast("int").alias("tx_count_24h"),
            F.when(F.col("nth") == 1, F.expr("cast(array() as array<string>)")).otherwise(F.array(own)).alias("known_merchants"),
        ).alias("customer"),
        F.struct(own.alias("id"), code.alias("mcc"), F.col("merchant_avg").alias("avg_amount")).alias("merchant"),
        F.struct(
            F.col("event_type").isin("click", "view", "purchase").alias("is_online"), F.col("event_type").isin("purchase", "signup").alias("card_present"), (F.col("event_id") * 7919 % 120000 / 100.0).alias("km_from_home")
        ).alias("terminal"),
        F.when(F.col("last_ts").isNotNull(), F.struct(F.col("last_ts").cast("timestamp").alias("timestamp"), (F.abs(F.col("k") - F.col("last_k")) * 12.5).alias("km_from_current"))).alias("last_transaction"),
    )


def _small(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """rows, to be broadcast if there are at most BROADCAST_ROWS. They are collected at once: left to the plan, all that they are joined with is
    shuffled whenever they happen to be ready too late."""
    found = rows.limit(BROADCAST_ROWS + 1).toArrow()
    return F.broadcast(spark.createDataFrame(found, rows.schema)) if found.num_rows <= BROADCAST_ROWS else rows


def vectors(spark: SparkSession, sf_dir: str, rounded: bool = True) -> DataFrame:
    """event_id, k, y, d0..d13."""
    return vectorize(payloads(spark, sf_dir), ["event_id", "k", "y"], rounded)


class Written:
    """vectors() written once, for queries that read them as queries, references and labels. Many events are written in parts by user, so that the
    shuffle files of one part are gone before the next begins. drop() removes the rows, where there are many; nothing may read them afterwards."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.tables, n = Tables(spark, "vectors"), table(spark, sf_dir, "events").count()
        parts, merchants = max(1, min(MOST_PARTS, -(-n // PART_ROWS))), _merchants(spark, sf_dir)
        self.many, names = parts > 1, [f"rows{i}" for i in range(parts)]
        for i, name in enumerate(names):
            made = vectorize(payloads(spark, sf_dir, (i, parts), merchants), ["event_id", "k", "y"])
            self.rows = self.tables.write(made, name)
        if self.many:
            self.rows = spark.read.schema(self.rows.schema).parquet(*map(self.tables.path, names))

    def labels(self) -> DataFrame:
        """qid and expected of the queries; of many events a table of its own, which outlives the rows."""
        found = event_queries(self.rows).select("qid", F.col("y").alias("expected"))
        return Tables(self.rows.sparkSession, "labels").write(found, "rows") if self.many else found

    def drop(self) -> None:
        if self.many:
            self.tables.clear()


def written_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of Written."""
    return Written(spark, sf_dir).rows


def event_queries(rows: DataFrame) -> DataFrame:
    """The set of questions: ids divisible by 20, each put to all rows but its own."""
    return rows.where(F.col("event_id") % 20 == 0).select(F.col("event_id").alias("qid"), "y", *DIMS, F.array(*DIMS).alias("v"))


def event_refs(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("event_id").alias("ref_id"), "y", *DIMS, F.array(*DIMS).alias("v"))


def event_centroids(rows: DataFrame) -> DataFrame:
    """About as many centroids as the root of the rows' number."""
    step = max(1, int(math.sqrt(rows.count())))
    return event_refs(rows).where(F.col("ref_id") % step == 0).select(F.col("ref_id").alias("cluster_id"), F.col("v").alias("c"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, v, y."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.when(F.col("label") >= 7, 1).otherwise(0).alias("y"))


def embedding_queries(rows: DataFrame) -> DataFrame:
    return rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "v")


def embedding_refs(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("vec_id").alias("ref_id"), "v", "y")


def embedding_centroids(rows: DataFrame) -> tuple[DataFrame, int]:
    """About as many centroids as the root of the rows' number, and how many of them are probed: three quarters, as the neighbours of these
    vectors, spread evenly on a sphere, lie in many clusters. Recall over all queries is 0.9 or more."""
    step = max(1, int(math.sqrt(rows.count())))
    chosen = rows.where(F.col("vec_id") % step == 0).select(F.col("vec_id").alias("cluster_id"), F.col("v").alias("c"))
    return chosen, max(1, math.ceil(0.75 * chosen.count()))
