"""Rendezvous (highest random weight) hashing of record keys over weighted shards.

Every shard draws a number from a record's key and its own name; the highest weighted draw wins. A shard that is
added, or gains weight, only takes records to itself; one that goes gives its records to the others.
Draws come from md5, so that any engine can recompute them.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick

DRAW_DIGITS = 13  # 52 bits: whole numbers that a double holds


def key_text(key: Column) -> Column:
    """A null key is a key like any other, unlike every text."""
    return F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null"))


def draw(key: Column, shard: int) -> Column:
    return F.conv(F.substring(F.md5(F.concat(key_text(key), F.lit(f"/{shard}"))), 1, DRAW_DIGITS), 16, 10).cast("double")


def shard_of(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard of a key. Ties go to the larger shard number. With equal weights the draws themselves are compared,
    otherwise weight / -ln(draw as a fraction)."""
    even = len(set(weights.values())) == 1
    scored = []
    for shard, weight in sorted(weights.items()):
        x = draw(key, shard)
        if not even:
            x = F.lit(float(weight)) / -F.log((x + 0.5) / F.lit(2.0 ** (4 * DRAW_DIGITS)))
        scored.append(F.struct(x.alias("score"), F.lit(shard).alias("shard")))
    return F.greatest(*scored)["shard"] if len(scored) > 1 else F.lit(min(weights))


def assign(records: DataFrame, key: Column, weights: Mapping[int, float], name: str = "shard") -> DataFrame:
    """The records and their shard (int): a projection, no shuffle. A column of that name is replaced.

    Null keys share one shard, repeated keys theirs, however many there are: the key alone decides."""
    if not weights or min(weights.values()) <= 0:
        raise ValueError("shards need positive weights")
    return records.withColumn(name, shard_of(key, weights).cast("int"))


def slots(records: DataFrame, shard: str, order: list[str], slot: str = "slot", bucket_rows: int = 1 << 20) -> DataFrame:
    """The records with a number in their shard, gapless from 0, by the md5 of the order columns and then these.

    records has just the shard and the order columns. Equal records are counted before the shuffle and numbered as one
    range. A shard is cut into buckets by the leading digits of the md5, as many as keep a bucket near bucket_rows; their
    sizes (shards x buckets rows) give each its first number, so no task sorts a whole shard. Nulls are values like others, and an empty
    table stays empty. Columns of records may have any names."""
    names, own = [shard, *order], [f"o{i}" for i in range(len(order))]
    records, shard, order = pick(records, **dict(zip(["shard", *own], names, strict=True))), "shard", own
    counted = records.groupBy(shard, *order).agg(F.count("*").alias("_n"))
    whole = F.md5(F.concat_ws(":", *[key_text(F.col(c)) for c in order]))
    total = records.count()
    digits = next(d for d in range(1, 9) if total <= bucket_rows * 16**d or d == 8)
    counted = counted.withColumn("_h", whole).withColumn("_b", F.substring("_h", 1, digits))
    sizes = counted.groupBy(shard, "_b").agg(F.sum("_n").alias("_size"))
    before = Window.partitionBy(shard).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select(shard, "_b", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy(shard, "_b").orderBy("_h", *[F.col(c).asc_nulls_first() for c in order])
    ranged = counted.withColumn("_end", F.sum("_n").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    placed = ranged.join(first, [shard, "_b"])
    start = F.col("_first") + F.col("_end") - F.col("_n")
    numbered = placed.select(shard, *order, F.explode(F.sequence(start, start + F.col("_n") - 1)))
    return numbered.toDF(*names, slot)
