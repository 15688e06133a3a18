"""Evaluation: confusion counts, penalties, sweeps, the contest score, dataset statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed constants of the score.
SCALE, T_MAX_MS, P99_MIN_MS, P99_MAX_MS = 1000.0, 1000.0, 1.0, 2000.0
EPSILON_MIN, BETA, FAILURE_CUT, CUT_SCORE = 0.001, 300.0, 0.15, -3000.0


def confusion_counts(predicted: Column, expected: Column) -> list[Column]:
    p, e = predicted == 1, expected == 1
    return [F.count_if(p & e).alias("tp"), F.count_if(p & ~e).alias("fp"), F.count_if(~p & e).alias("fn"), F.count_if(~p & ~e).alias("tn")]


def confusion(rows: DataFrame, predicted: str = "predicted", expected: str = "expected") -> DataFrame:
    return rows.agg(*confusion_counts(F.col(predicted), F.col(expected)))


def accuracy_penalty(counts: DataFrame) -> DataFrame:
    """accuracy, weighted and penalty from tp, fp, fn, tn."""
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return counts.select(
        "*",
        F.round((F.col("tp") + F.col("tn")) / F.coalesce(F.nullif(n, F.lit(0)), F.lit(1)), 6).alias("accuracy"),
        (F.col("fp") + 3 * F.col("fn")).alias("weighted"),
        (25 * F.col("fp") + 90 * F.col("fn")).alias("penalty"),
    )


def sweep(rows: DataFrame, thresholds: Sequence[float], probability: str = "probability", expected: str = "expected") -> DataFrame:
    """threshold, tp, fp, fn, tn, penalty: all thresholds in one pass, as conditional sums over the rows and not as copies of them."""
    p, e = F.col(probability), F.col(expected) == 1
    sums = [c for i, t in enumerate(thresholds) for c in (F.count_if((p >= t) & e).alias(f"tp{i}"), F.count_if((p >= t) & ~e).alias(f"fp{i}"), F.count_if((p < t) & e).alias(f"fn{i}"), F.count_if((p < t) & ~e).alias(f"tn{i}"))]
    wide = rows.agg(*sums)
    each = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), *[F.col(f"{k}{i}").alias(k) for k in ("tp", "fp", "fn", "tn")]) for i, t in enumerate(thresholds)])
    return wide.select(F.explode(each).alias("x")).select("x.*").withColumn("penalty", 25 * F.col("fp") + 90 * F.col("fn"))


def best(swept: DataFrame) -> DataFrame:
    """The first threshold of the lowest penalty."""
    return swept.agg(F.min_by("threshold", F.struct("penalty", "threshold")).alias("threshold"), F.min("penalty").alias("penalty"))


def contest_score(results: DataFrame) -> DataFrame:
    """The score of each row of tp, tn, fp, fn, err (counts) and p99 (ms)."""
    c = F.col
    n = c("tp") + c("tn") + c("fp") + c("fn") + c("err")
    e = c("fp") + 3 * c("fn") + 5 * c("err")
    some = F.coalesce(F.nullif(n, F.lit(0)), F.lit(1))
    base = results.select("*", e.alias("weighted_errors"), (e / some).alias("epsilon"), ((c("fp") + c("fn") + c("err")) / some).alias("failure_rate"))
    p99 = F.when(c("p99") <= 0, 0.0).when(c("p99") > P99_MAX_MS, CUT_SCORE).otherwise(SCALE * F.log10(F.lit(T_MAX_MS) / F.greatest(c("p99"), F.lit(P99_MIN_MS))))
    detection = F.when(c("failure_rate") > FAILURE_CUT, CUT_SCORE).otherwise(SCALE * F.log10(1.0 / F.greatest(c("epsilon"), F.lit(EPSILON_MIN))) - BETA * F.log10(1.0 + c("weighted_errors")))
    scored = base.select("*", p99.alias("p99_score"), detection.alias("detection_score"))
    return scored.withColumn("final_score", c("p99_score") + c("detection_score"))


def request_counters(answers: DataFrame) -> DataFrame:
    """tp_count, tn_count, fp_count, fn_count, error_count, error_rate, max_ms of answers (approved, expected_approved, ms) in one pass; an
    answer whose approved is null is an error. Fraud is the positive class. Without rows the rate is 0 and max_ms null."""
    a, e = F.col("approved"), F.col("expected_approved")
    errors, some = F.count_if(a.isNull()), F.coalesce(F.nullif(F.count("*"), F.lit(0)), F.lit(1))
    counts = {"tp_count": ~a & ~e, "tn_count": a & e, "fp_count": ~a & e, "fn_count": a & ~e}
    return answers.agg(*[F.count_if(c).alias(n) for n, c in counts.items()], errors.alias("error_count"), (errors / some).alias("error_rate"), F.max("ms").alias("max_ms"))


def dataset_stats(entries: DataFrame) -> DataFrame:
    """Counts and rates of expected_approved, expected_fraud_score."""
    fraud = F.count_if(~F.col("expected_approved"))
    edge = F.count_if(F.col("expected_fraud_score") == 0.6)
    total = F.count("*")
    some = F.coalesce(F.nullif(total, F.lit(0)), F.lit(1))
    rate = lambda x: F.floor(x / some * 10000.0 + 0.5) / 10000.0
    return entries.agg(
        total.alias("total"), fraud.alias("fraud_count"), (total - fraud).alias("legit_count"), rate(fraud).alias("fraud_rate"), rate(total - fraud).alias("legit_rate"), edge.alias("edge_case_count"), rate(edge).alias("edge_case_rate")
    )


def band_coverage(rows: DataFrame, threshold: float, bands: Sequence[float]) -> DataFrame:
    """band, fallback, covered_errors, fp, fn for rows of probability, expected: how many rows a second stage gets, and errors in them."""
    p, e = F.col("probability"), F.col("expected") == 1
    wrong_p, wrong_n = (p >= threshold) & ~e, (p < threshold) & e
    parts = []
    for i, b in enumerate(bands):
        inside = F.abs(p - threshold) <= b
        parts += [F.count_if(inside).alias(f"a{i}"), F.count_if(inside & (wrong_p | wrong_n)).alias(f"b{i}"), F.count_if(~inside & wrong_p).alias(f"c{i}"), F.count_if(~inside & wrong_n).alias(f"d{i}")]
    each = F.array(*[F.struct(F.lit(float(b)).alias("band"), F.col(f"a{i}").alias("fallback"), F.col(f"b{i}").alias("covered_errors"), F.col(f"c{i}").alias("fp"), F.col(f"d{i}").alias("fn")) for i, b in enumerate(bands)])
    return rows.agg(*parts).select(F.explode(each).alias("x")).select("x.*")


def threshold_grid(rows: DataFrame, points: str, legit: Sequence[int], fraud: Sequence[int]) -> DataFrame:
    """legit, fraud (hundredths), fast, fp of each pair of cuts over borderline rows."""
    x, safe = F.col(points), (F.col("d10") == 1) & (F.col("d11") == 0) & (F.col("d0") < 0.3)
    inside, parts, each = rows.where(x.between(15, 70)), [], []
    for a in legit:
        for b in fraud:
            low = (x < a) & safe
            parts += [F.count_if(low | (x > b)).alias(f"f{a}_{b}"), F.count_if(low & (F.col("y") == 1)).alias(f"p{a}_{b}")]
            each.append(F.struct(F.lit(a).alias("legit"), F.lit(b).alias("fraud"), F.col(f"f{a}_{b}").alias("fast"), F.col(f"p{a}_{b}").alias("fp")))
    return inside.agg(*parts).select(F.explode(F.array(*each)).alias("x")).select("x.*")


def ramp_requests(stages: DataFrame, start_rate: int) -> DataFrame:
    """Requests of each stage (stage, duration, target) of a linear ramp, and their running sum. Stages are a handful of rows."""
    w = Window.orderBy("stage")
    previous = F.lag("target", 1, start_rate).over(w)
    made = stages.withColumn("rate_from", previous).withColumn("requests", F.expr("(rate_from + target) * duration div 2"))
    return made.withColumn("cumulative", F.sum("requests").over(w.rowsBetween(Window.unboundedPreceding, 0)))
