"""Trees, forests, linear models, scores and evaluation against literals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from heronlake.operators import evaluate, generate, models, training
from heronlake.operators.vectorize import vectorize
from heronlake.plans import fixed
from heronlake.schemas import DIMS
from heronlake.sources import readers, sinks

STUMP = [(0, 0, 0, 0.5, 1, 2, 0.0), (0, 1, -1, 0.0, -1, -1, 0.1), (0, 2, -1, 0.0, -1, -1, 0.9)]


def rows(spark, values):
    return spark.createDataFrame([tuple([i, *([v] + [0.0] * 13)]) for i, v in enumerate(values)], "id long, " + ", ".join(f"{d} double" for d in DIMS))


def test_stump(spark):
    found = rows(spark, [0.4, 0.6, 0.5]).select(models.classify(models.forest_probability(STUMP), 0.5).alias("c"), models.tree_value(STUMP).alias("v")).collect()
    assert [x.c for x in found] == [0, 1, 0] and found[0].v == pytest.approx(0.1, abs=1e-6)


def test_boxes_equal_conditions(spark):
    data = vectorize(generate.payloads(spark, 200), ["id"]).withColumn("id", F.monotonically_increasing_id())
    a = {r.id: r.v for r in data.select("id", models.tree_value(fixed.TREE).alias("v")).collect()}
    b = {r.id: r.value for r in models.predict_boxes(data, "id", fixed.TREE).collect()}
    assert a == b


def test_tree_files_round_trip(tmp_path, spark):
    content = sinks.forest_bytes(fixed.FOREST, 14, 0.25)
    nodes, threshold = readers.parse_forest(sinks.set_threshold(content, 0.5))
    assert nodes == fixed.FOREST and threshold == 0.5
    for bad in (content[:-2], content[:30], content[:6], content + b"x"):
        with pytest.raises(ValueError):
            readers.parse_forest(bad)
    (tmp_path / "f.bin").write_bytes(content)
    assert readers.forest(spark, str(tmp_path / "f.bin")) == (fixed.FOREST, 0.25)


def test_malformed_tree_is_refused():
    with pytest.raises(ValueError):
        models.check_tree([(0, 0, 0, 0.5, 0, 2, 0.0)])


@pytest.mark.parametrize(
    "fp,fn,err,p99,final",
    [(0, 0, 0, 1.0, 6000), (5, 5, 0, 3.0, 4524.15), (0, 0, 0, 100.0, 4000), (30, 20, 0, 10.0, 3157.02), (100, 50, 0, 300.0, 1104.01), (500, 250, 0, 200.0, 371.85), (500, 300, 0, 10.0, -1000), (0, 0, 5000, 60000.0, -6000), (40, 15, 0, 5.81, 3425.03)],
)
def test_contest_score(spark, fp, fn, err, p99, final):
    data = spark.createDataFrame([(0, 5000 - fp - fn - err, fp, fn, err, p99)], "tp long, tn long, fp long, fn long, err long, p99 double")
    scored = evaluate.contest_score(data)
    assert scored.first().final_score == pytest.approx(final, abs=0.01)
    assert sinks.result_document(scored).first().scoring.breakdown.http_errors == err


def test_ramp(spark):
    stages = spark.createDataFrame([(1, 120, 900)], "stage int, duration long, target long")
    assert evaluate.ramp_requests(stages, 1).first().cumulative == 54060


def test_sweep_and_best(spark):
    data = spark.createDataFrame([(0.2, 0), (0.4, 1), (0.8, 1), (0.9, 0)], "probability double, expected int")
    found = {r.threshold: (r.tp, r.fp, r.fn, r.tn) for r in evaluate.sweep(data, [0.1, 0.5, 0.3]).collect()}
    assert found == {0.1: (2, 2, 0, 0), 0.5: (1, 1, 1, 1), 0.3: (2, 1, 0, 1)}
    assert evaluate.best(evaluate.sweep(data, [0.1, 0.3, 0.5])).first().threshold == 0.3


def test_lda_separates_generated_classes(spark):
    data = vectorize(generate.payloads(spark, 2000, 0.5), ["id", "profile"]).where("profile <> 'borderline'").withColumn("y", (F.col("profile") == "fraud").cast("int"))
    m = models.Moments.of(data)
    for w, w0 in (models.lda_closed_form(m), models.lda_prior(m)):
        score = models.linear_score(w, w0)
        wrong = data.where((score > 0).cast("int") != F.col("y")).count()
        assert wrong < 20


def test_training_gives_useful_trees(spark):
    data = vectorize(generate.payloads(spark, 1500, 0.5), ["id", "profile"]).withColumn("y", (F.col("profile") == "fraud").cast("int")).cache()
    for nodes in (training.train_cart(data, 4, 20), training.train_extra_trees(data, 5, 5)):
        models.check_tree(nodes)
        p = models.forest_probability(nodes)
        assert data.where((p >= 0.5).cast("int") != F.col("y")).count() < 150
    v = training.truncated_svd(data, 8)
    assert len(v) == 8 and abs(sum(x * x for x in v[0]) - 1) < 1e-6
    assert [r["count"] for r in training.first_of_each_class(data, 7, "id").groupBy("y").count().collect()] == [7, 7]


def test_generator_is_seeded_and_mixed(spark):
    a, b = (generate.payloads(spark.newSession(), 3000, 0.4, seed=9) for _ in range(2))
    assert a.orderBy("id").limit(20).collect() == b.orderBy("id").limit(20).collect()
    mix = {r.profile: r["count"] for r in a.groupBy("profile").count().collect()}
    assert abs(mix["legit"] - 1800) < 120 and 60 < mix["borderline"] < 190
    assert {r.label for r in generate.references(spark, 50).select("label").distinct().collect()} <= {"fraud", "legit"}


def test_the_generated_set_has_the_size_of_the_reference(spark):
    from heronlake.plans import catalogue

    found = {x.profile: x.n for x in catalogue.queries()["q_generate"](spark, "").collect()}
    assert sum(found.values()) == 54_100 and abs(found["legit"] / 54_100 - 0.53) < 0.01


def test_svd_of_an_empty_table_is_an_error(spark):
    with pytest.raises(ValueError, match="no rows"):
        training.truncated_svd(spark.createDataFrame([], "a double, b double"), 1, ["a", "b"])


def test_request_counters(spark):
    rows = [(True, True, 1.0), (True, False, 2.0), (False, False, 3.0), (False, True, 9.0), (None, True, 5.0)]
    schema = "approved boolean, expected_approved boolean, ms double"
    assert tuple(evaluate.request_counters(spark.createDataFrame(rows, schema)).first()) == (1, 1, 1, 1, 1, 0.2, 9.0)
    assert tuple(evaluate.request_counters(spark.createDataFrame([], schema)).first()) == (0, 0, 0, 0, 0, 0.0, None)


def test_mahalanobis_difference_against_numpy(spark):
    inverse, legit, fraud = [[2.0, 0.5], [0.5, 1.0]], [0.0, 1.0], [1.0, -1.0]
    x = np.array([0.3, 0.7])
    form = lambda m: (x - m) @ np.array(inverse) @ (x - m)
    rows = spark.createDataFrame([(0.3, 0.7)], "a double, b double")
    found = rows.select(models.mahalanobis_difference(["a", "b"], legit, fraud, inverse).alias("d")).first()["d"]
    assert found == pytest.approx(form(legit) - form(fraud))
