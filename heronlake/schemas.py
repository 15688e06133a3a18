"""Schemas of transactions, reference vectors, decisions, models and results."""

from __future__ import annotations

from pyspark.sql import types as T

#: Normalization ceilings and the risk of merchant categories, in file order.
NORMALIZATION = {
    "max_amount": 10000.0,
    "max_installments": 12.0,
    "amount_vs_avg_ratio": 10.0,
    "max_minutes": 1440.0,
    "max_km": 1000.0,
    "max_tx_count_24h": 20.0,
    "max_merchant_avg_amount": 10000.0,
}
MCC_RISK = {"5411": 0.15, "5812": 0.30, "5912": 0.20, "5944": 0.45, "7801": 0.80, "7802": 0.75, "7995": 0.85, "4511": 0.35, "5311": 0.25, "5999": 0.50}
DEFAULT_RISK, K, CUT, SENTINEL = 0.5, 5, 0.6, -1.0
DIMS = [f"d{i}" for i in range(14)]



def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_double, _int, _string, _bool = T.DoubleType(), T.IntegerType(), T.StringType(), T.BooleanType()
PAYLOAD = _struct(
    id=_string,
    transaction=_struct(amount=_double, installments=_int, requested_at=T.TimestampType()),
    customer=_struct(avg_amount=_double, tx_count_24h=_int, known_merchants=T.ArrayType(_string)),
    merchant=_struct(id=_string, mcc=_string, avg_amount=_double),
    terminal=_struct(is_online=_bool, card_present=_bool, km_from_home=_double),
    last_transaction=_struct(timestamp=T.TimestampType(), km_from_current=_double),
)
REFERENCE = _struct(vector=T.ArrayType(_double), label=_string)
RESPONSE = _struct(approved=_bool, fraud_score=_double)
TEST_ENTRY = _struct(request=PAYLOAD, expected_approved=_bool, expected_fraud_score=_double)
TREE_NODES = _struct(tree_id=_int, node_id=_int, feature=_int, threshold=T.FloatType(), left=_int, right=_int, value=T.FloatType())
PARTICIPANT = _struct(id=_string, repo=_string)
