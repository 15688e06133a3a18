"""Transactions to 14 normalized features; the decision on a score."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clamp01, minutes_between, round_to, safe_divisor
from ..schemas import CUT, DEFAULT_RISK, DIMS, MCC_RISK, NORMALIZATION, SENTINEL


def risk_of(mcc: Column, risks: Mapping[str, float] = MCC_RISK) -> Column:
    """Lookup in a map literal; categories that it lacks have the default."""
    table = F.create_map(*[F.lit(x) for pair in risks.items() for x in pair])
    return F.coalesce(table[mcc], F.lit(DEFAULT_RISK))


def features(config: Mapping[str, float] = NORMALIZATION, risks: Mapping[str, float] = MCC_RISK) -> list[Column]:
    """The 14 features of a payload's columns, unrounded. A null last transaction gives the sentinel; a null list of
    merchants knows none; flags count only if true."""
    c = NORMALIZATION | dict(config)
    tx, last = F.col("transaction"), F.col("last_transaction")
    amount, at = tx["amount"], tx["requested_at"]
    none = last.isNull() | last["timestamp"].isNull()
    known = F.coalesce(F.array_contains(F.col("customer.known_merchants"), F.col("merchant.id")), F.lit(False))
    return [
        clamp01(amount / c["max_amount"]),
        clamp01(tx["installments"] / c["max_installments"]),
        clamp01(amount / safe_divisor(F.col("customer.avg_amount")) / c["amount_vs_avg_ratio"]),
        F.hour(at) / 23.0,
        F.weekday(at) / 6.0,
        F.when(none, SENTINEL).otherwise(clamp01(minutes_between(at, last["timestamp"]) / c["max_minutes"])),
        F.when(none, SENTINEL).otherwise(clamp01(last["km_from_current"] / c["max_km"])),
        clamp01(F.col("terminal.km_from_home") / c["max_km"]),
        clamp01(F.col("customer.tx_count_24h") / c["max_tx_count_24h"]),
        F.coalesce(F.col("terminal.is_online"), F.lit(False)).cast("double"),
        F.coalesce(F.col("terminal.card_present"), F.lit(False)).cast("double"),
        F.when(known, 0.0).otherwise(1.0),
        risk_of(F.col("merchant.mcc"), risks),
        clamp01(F.col("merchant.avg_amount") / c["max_merchant_avg_amount"]),
    ]


def vectorize(payloads: DataFrame, keep: list[str], rounded: bool = True, config: Mapping[str, float] = NORMALIZATION, risks: Mapping[str, float] = MCC_RISK) -> DataFrame:
    """The columns to keep and d0..d13, to four decimals (for neighbour search) or as they are (for served models).
    A projection: filters and column pruning pass through it to the scan."""
    return payloads.select(*keep, *[(round_to(x, 4) if rounded else x).alias(n) for n, x in zip(DIMS, features(config, risks), strict=True)])


def approved(score: Column, cut: float = CUT) -> Column:
    """Approved under the cut; a missing score counts as 0.5, which approves."""
    return F.coalesce(score, F.lit(0.5)) < cut


def encode_label(label: Column) -> Column:
    return F.when(label == "fraud", 1).otherwise(0)


def response(score: Column) -> Column:
    return F.to_json(F.struct(approved(score).alias("approved"), score.alias("fraud_score")), {"ignoreNullFields": "false"})
