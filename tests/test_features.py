"""Literal golden cases of the feature vector, the vote and the scalar functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from heronlake.functions import scalar
from heronlake.operators.vectorize import approved, vectorize
from heronlake.schemas import DIMS, PAYLOAD

UTC = dt.timezone.utc


def payload(**change):
    base = {
        "id": "tx-1",
        "transaction": (41.12, 2, dt.datetime(2026, 3, 11, 18, 45, 53, tzinfo=UTC)),
        "customer": (82.24, 3, ["MERC-003", "MERC-016"]),
        "merchant": ("MERC-016", "5411", 60.25),
        "terminal": (False, True, 29.2331036248),
        "last_transaction": None,
    }
    return tuple((base | change).values())


def test_documented_vector(spark):
    row = vectorize(spark.createDataFrame([payload()], PAYLOAD), ["id"]).select(*DIMS).first()
    assert list(row) == [0.0041, 0.1667, 0.05, 0.7826, 0.3333, -1, -1, 0.0292, 0.15, 0, 1, 0, 0.15, 0.006]


def test_nulls_zero_divisor_and_unknown_category(spark):
    odd = payload(customer=(0.0, 50, None), merchant=("X", "9999", 1e9), terminal=(None, None, -5.0), last_transaction=(dt.datetime(2026, 3, 11, 18, 15, 53, tzinfo=UTC), 2000.0))
    row = vectorize(spark.createDataFrame([odd], PAYLOAD), ["id"]).first()
    assert row.d2 == 1.0 and row.d8 == 1.0 and row.d11 == 1.0 and row.d12 == 0.5 and row.d13 == 1.0
    assert row.d9 == 0.0 and row.d10 == 0.0 and row.d7 == 0.0
    assert row.d5 == pytest.approx(30 / 1440, abs=5e-5) and row.d6 == 1.0


def test_decision(spark):
    rows = spark.createDataFrame([(0.6,), (0.4,), (None,), (1.0,)], "s double")
    assert [r[0] for r in rows.select(approved(F.col("s"))).collect()] == [False, True, True, False]


def test_scalar_functions(spark):
    row = spark.range(1).select(
        scalar.number_text(F.lit(3.0)), scalar.number_text(F.lit(0.125)), scalar.escape_html(F.lit("<a & 'b'>")), scalar.round_to(F.lit(0.00005), 4), scalar.round_to(F.lit(-1.0), 4), scalar.merchant_id(F.lit(7)), scalar.duration_text(F.lit(61000.0)), scalar.round_robin(F.lit(5), 2)
    ).first()
    assert list(row) == ["3", "0.125", "&lt;a &amp; &#39;b&#39;&gt;", 0.0001, -1.0, "MERC-007", "1m1s", 0]


def test_quantizers_differ_at_halves(spark):
    row = spark.createDataFrame([(0.5 / 32767 * 1, 2.0)], "h double, big double").select(scalar.quantize_i16(F.col("h"), True), scalar.quantize_i16(F.col("h"), False), scalar.quantize_i16(F.col("big"))).first()
    assert list(row) == [0, 1, 32767]


def test_clamp_keeps_nulls(spark):
    row = spark.createDataFrame([(None, -1.0, 0.25, 7.0)], "a double, b double, c double, d double").select(*[scalar.clamp01(F.col(x)) for x in "abcd"]).first()
    assert list(row) == [None, 0.0, 0.25, 1.0]


def test_text_helpers(spark):
    rows = spark.createDataFrame([("0123456789ab", [("x",)], 1536.0, [1.0, 2.0]), (None, [], 999.0, [1.0, None]), ("abc", None, 2.5e9, [1.0])], "c string, e array<struct<id: string>>, n double, v array<double>")
    found = rows.select(
        scalar.short_commit(F.col("c")), scalar.first_id(F.col("e"), "none"), scalar.bytes_text(F.col("n")), scalar.guarded(F.col("v"), 2, F.get("v", F.lit(1))), scalar.padded(F.col("c"), 5)
    ).collect()
    assert [tuple(r) for r in found] == [("0123456", "x", "1.53 kB", 2.0, "0123456789ab"), (None, "none", "999 B", None, None), ("abc", "none", "2.5 GB", None, "  abc")]
    stamp = spark.range(1).select(F.unix_timestamp(scalar.stamp_utc(), "yyyy-MM-dd'T'HH:mm:ssXXX") - F.unix_timestamp()).first()[0]
    assert abs(stamp) < 5
