"""Synthetic transactions with profiles, by seeded expressions: any number of rows, in parallel, the same for a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import merchant_id
from ..schemas import DIMS, PAYLOAD

LEGIT_CODES, FRAUD_CODES = ("5411", "5812", "5912", "5311"), ("7995", "7801", "7802")
ALL_CODES = ("5411", "5812", "5912", "5944", "7801", "7802", "7995", "4511", "5311", "5999")
START, END_RANDOM = "2026-03-10 00:00:00", "2030-12-31 00:00:00"


def payloads(spark: SparkSession, n: int, fraud_ratio: float = 0.35, seed: int = 42, random_dates: bool = False) -> DataFrame:
    """Payloads with profile: legit 1 - r, fraud 0.9 r, borderline 0.1 r; fields are drawn within the profile's ranges. A draw is a hash
    of row, seed and field, so rows don't depend on their partition."""

    def u(name: str) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(name)), F.lit(1 << 30)) / float(1 << 30)

    def by(legit: Column, fraud: Column, border: Column) -> Column:
        return F.when(F.col("profile") == "legit", legit).when(F.col("profile") == "fraud", fraud).otherwise(border)

    def uniform(name: str, legit: tuple, fraud: tuple, border: tuple) -> Column:
        return by(*[F.lit(a) + u(name) * (b - a) for a, b in (legit, fraud, border)])

    def whole(name: str, legit: tuple, fraud: tuple, border: tuple) -> Column:
        return by(*[F.floor(F.lit(float(a)) + u(name) * (b - a + 1)).cast("int") for a, b in (legit, fraud, border)])

    def one(name: str, codes: tuple[str, ...]) -> Column:
        return F.element_at(F.array(*map(F.lit, codes)), (F.floor(u(name) * len(codes)) + 1).cast("int"))

    mix = F.when(u("mix") < 1 - fraud_ratio, "legit").when(u("mix") < 1 - 0.1 * fraud_ratio, "fraud").otherwise("borderline")
    base = spark.range(n).withColumn("profile", mix).withColumn("amount", F.round(uniform("amount", (10.0, 500.0), (2000.0, 10000.0), (400.0, 3000.0)), 2))
    known = F.transform(F.sequence(F.lit(0), F.floor(u("n_known") * 4).cast("int") + 1), lambda i: merchant_id((F.pmod(F.xxhash64("id", F.lit(seed), i), F.lit(19)) + 1).cast("int")))
    base = base.withColumn("known", known)
    one_known = F.element_at("known", (F.floor(u("pick") * F.size("known")) + 1).cast("int"))
    own = by(one_known, merchant_id(F.floor(u("m") * 50).cast("int") + 50), F.when(u("m2") < 0.5, one_known).otherwise(merchant_id(F.floor(u("m") * 30).cast("int") + 30)))
    day = F.floor(u("day") * (F.unix_timestamp(F.lit(END_RANDOM)) - F.unix_timestamp(F.lit(START))) / 86400 if random_dates else u("day") * 18)
    hour = whole("hour", (8, 20), (0, 6), (6, 22))
    at = F.timestamp_seconds(F.unix_timestamp(F.lit(START)) + day * 86400 + hour * 3600 + F.floor(u("sec") * 3600))
    gap = F.floor(60 + u("gap") * 3.15e8) if random_dates else whole("gap", (30, 719), (1, 9), (5, 119)) * 60
    online = u("online") < by(F.lit(0.3), F.lit(0.8), F.lit(0.5))
    made = base.withColumn("at", at)
    return made.select(
        F.concat(F.lit("tx-"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 32)).cast("string")).alias("id"),
        "profile",
        F.struct("amount", whole("inst", (1, 3), (6, 12), (3, 7)).alias("installments"), F.col("at").alias("requested_at")).alias("transaction"),
        F.struct(
            F.round(by(F.col("amount") * 2, F.lit(50.0) + u("avg") * 250, F.lit(100.0) + u("avg") * 400), 2).alias("avg_amount"),
            whole("n24", (1, 5), (8, 20), (4, 11)).alias("tx_count_24h"),
            F.col("known").alias("known_merchants"),
        ).alias("customer"),
        F.struct(
            own.alias("id"),
            by(one("mcc", LEGIT_CODES), one("mcc", FRAUD_CODES), one("mcc", ALL_CODES)).alias("mcc"),
            F.round(uniform("mavg", (30.0, 500.0), (20.0, 100.0), (50.0, 300.0)), 2).alias("avg_amount"),
        ).alias("merchant"),
        F.struct(online.alias("is_online"), (~online & (u("card") < 0.9)).alias("card_present"), uniform("km", (0.0, 50.0), (200.0, 1000.0), (30.0, 400.0)).alias("km_from_home")).alias("terminal"),
        F.when(u("last") >= 0.2, F.struct(F.timestamp_seconds(F.unix_timestamp("at") - gap).alias("timestamp"), uniform("lkm", (0.0, 20.0), (200.0, 1000.0), (20.0, 300.0)).alias("km_from_current"))).alias("last_transaction"),
    )


def references(spark: SparkSession, n: int, fraud_ratio: float = 0.35, seed: int = 42) -> DataFrame:
    """vector, label: the profile is the label, a coin decides for borderline ones."""
    from .vectorize import vectorize

    coin = F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(2)) == 0
    label = F.when((F.col("profile") == "fraud") | ((F.col("profile") == "borderline") & coin), "fraud").otherwise("legit")
    rows = vectorize(payloads(spark, n, fraud_ratio, seed), ["id", "profile"])
    return rows.select(F.array(*[f"d{i}" for i in range(14)]).alias("vector"), label.alias("label"))


def golden_entries(requests: DataFrame, refs: DataFrame, skip_own: bool = False) -> DataFrame:
    """qid, request, expected_approved, expected_fraud_score of payloads with a qid: each labelled by exact search among refs
    (ref_id, v, y). Without references nothing speaks for fraud: the score is 0."""
    from . import cells, knn
    from .vectorize import approved, vectorize

    votes = knn.vote(cells.knn(vectorize(requests, ["qid"]).select("qid", F.array(*DIMS).alias("v")), refs, skip_own=skip_own))
    packed = requests.select("qid", F.struct(*[f.name for f in PAYLOAD.fields]).alias("request"))
    score = F.coalesce("fraud_score", F.lit(0.0))
    return packed.join(votes, "qid", "left").select("qid", "request", approved(score).alias("expected_approved"), score.alias("expected_fraud_score"))
