"""Neighbour search against brute force, and the indexes."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heronlake.operators import ivf, knn, lsh
from heronlake.plans import adapters


def vectors(spark, n, dims, name, seed=1, grid=6):
    r = random.Random(seed)
    rows = [(i, [r.randrange(grid) / grid for _ in range(dims)], r.randrange(2)) for i in range(n)]
    return rows, spark.createDataFrame(rows, f"{name} long, v array<double>, y int")


def brute(queries, refs, k, f):
    return {(q, i + 1): ref for q, v, _ in queries for i, (_, ref) in enumerate(sorted((f(v, w), j) for j, w, _ in refs)[:k])}


METRICS = {
    "l2": lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b)),
    "l1": lambda a, b: sum(abs(x - y) for x, y in zip(a, b)),
}


@pytest.mark.parametrize("metric", METRICS)
@pytest.mark.parametrize("blocks", [1, 3])
def test_knn_equals_brute_force_with_ties(spark, metric, blocks):
    q, qdf = vectors(spark, 20, 3, "qid", 2)
    r, rdf = vectors(spark, 300, 3, "ref_id", 3)
    found = knn.knn(qdf, rdf, 5, metric, shards=3, query_blocks=blocks).collect()
    assert {(x.qid, x["rank"]): x.ref_id for x in found} == brute(q, r, 5, METRICS[metric])


def test_documented_three_dimensional_case(spark):
    refs = [[0.06, 0.06, 0.05], [0.95, 0.95, 1.0], [0.1, 0.12, 0.1]]
    r = spark.createDataFrame([(i, v, 1) for i, v in enumerate(refs)], "ref_id long, v array<double>, y int")
    q = spark.createDataFrame([(0, [1.0, 0.96, 0.96])], "qid long, v array<double>")
    near = knn.knn(q, r, 3).orderBy("rank").collect()
    assert [x.ref_id for x in near] == [1, 2, 0] and near[0].d ** 0.5 == pytest.approx(0.064, abs=1e-3)


def test_vote_divides_by_k_with_few_neighbours(spark):
    n = spark.createDataFrame([(1, 1), (1, 1), (1, 1), (1, 0), (1, 0), (2, 1)], "qid long, y int")
    assert {r.qid: r.fraud_score for r in knn.vote(n).collect()} == {1: 0.6, 2: 0.2}


def test_empty_tables(spark):
    _, q = vectors(spark, 3, 2, "qid")
    _, r = vectors(spark, 3, 2, "ref_id")
    assert knn.knn(q, r.limit(0)).count() == 0 and knn.knn(q.limit(0), r).count() == 0


def two_clusters(spark):
    rows = [(i, [(0.2 if i <= 50 else 0.7) + (j % 8 + 1) / 100 for j in range(8)], i % 2) for i in range(1, 101)]
    refs = spark.createDataFrame(rows, "ref_id long, v array<double>, y int")
    return rows, refs, spark.createDataFrame([(0, [0.25] * 8), (1, [0.75] * 8), (2, [9.0] * 8)], "cluster_id long, c array<double>")


def test_ivf_two_clusters_and_offsets(spark):
    rows, refs, centroids = two_clusters(spark)
    index = ivf.assign(refs, centroids)
    assert [tuple(r) for r in ivf.offsets(index, centroids).orderBy("cluster_id").collect()] == [(0, 50, 0), (1, 50, 50), (2, 0, 100)]
    q = spark.createDataFrame([(7, rows[4][1])], "qid long, v array<double>")
    for f in (ivf.search, ivf.search_early_exit):
        found = f(q, index, centroids, nprobe=2).orderBy("rank").collect()
        assert found[0].d < 0.01 ** 2 and [x.ref_id for x in found] == [1, 2, 3, 4, 5]


def test_ivf_with_all_clusters_is_exact(spark):
    q, qdf = vectors(spark, 10, 4, "qid", 5)
    r, rdf = vectors(spark, 200, 4, "ref_id", 6)
    c = rdf.where("ref_id % 20 = 0").select(F.col("ref_id").alias("cluster_id"), F.col("v").alias("c"))
    found = ivf.search(qdf, ivf.assign(rdf, c), c, 5, 10).collect()
    assert {(x.qid, x["rank"]): x.ref_id for x in found} == brute(q, r, 5, METRICS["l2"])


def test_lsh_finds_itself_and_falls_back(spark):
    _, rdf = vectors(spark, 400, 14, "ref_id", 8, 1000)
    p = lsh.gaussian(14, width=1.0)
    q = rdf.where("ref_id < 5").select(F.col("ref_id").alias("qid"), "v")
    near = lsh.search(q, rdf, p, 1.0).where("rank = 1").collect()
    assert all(x.qid == x.ref_id for x in near) and len(near) == 5
    far = spark.createDataFrame([(1, [50.0] * 14)], "qid long, v array<double>")
    assert lsh.candidates(far, rdf, p, 1.0, sample=30).count() == 30


def recall(found, exact):
    pairs = {(x.qid, x.ref_id) for x in exact.collect()}
    return len(pairs & {(x.qid, x.ref_id) for x in found.collect()}) / len(pairs)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_of_the_inverted_files(spark, sf):
    from heronlake.plans import catalogue

    q = catalogue.queries()
    exact = q["q_knn_embeddings"](spark, f"/root/testdata/{sf}")
    assert recall(q["q_ivf_knn"](spark, f"/root/testdata/{sf}"), exact) >= 0.9


def test_recall_of_hashing(spark):
    from heronlake.plans import catalogue

    q, d = catalogue.queries(), "/root/testdata/sf0.001"
    found = recall(q["q_lsh_knn"](spark, d), q["q_knn_exact"](spark, d))
    print("recall of hashing", found)
    assert found >= 0.9


def test_many_centroids_are_searched_in_shards(spark, monkeypatch):
    _, rdf = vectors(spark, 300, 4, "ref_id", 6)
    c = rdf.where("ref_id % 10 = 0").select(F.col("ref_id").alias("cluster_id"), F.col("v").alias("c"))
    one = sorted((x.ref_id, x.cluster_id) for x in ivf.assign(rdf, c).collect())
    monkeypatch.setattr(ivf, "BROADCAST_CENTROIDS", 5)
    monkeypatch.setattr(knn, "SHARD_ROWS", 7)
    monkeypatch.setattr(knn, "BLOCK_ROWS", 90)
    assert sorted((x.ref_id, x.cluster_id) for x in ivf.assign(rdf, c).collect()) == one


def test_own_rows_are_no_neighbours(spark):
    _, rdf = vectors(spark, 50, 3, "ref_id", 7)
    q = rdf.select(F.col("ref_id").alias("qid"), "v")
    for metric in ("l2", "l1", "cosine"):
        found = knn.knn(q, rdf, 49, metric, shards=3, skip_own=True).collect()
        assert len(found) == 50 * 49 and all(x.qid != x.ref_id for x in found)


def test_cosine(spark):
    d = knn.distances(np.array([[1.0, 0.0]]), np.array([[2.0, 0.0], [0.0, 3.0], [0.0, 0.0]]), "cosine")
    assert d.tolist() == [[0.0, 1.0, 1.0]]


def test_quantized_index_with_all_clusters_is_exact(spark):
    rows, refs, centroids = two_clusters(spark)
    q = refs.where("ref_id % 20 = 0").select(F.col("ref_id").alias("qid"), "v")
    index = ivf.assign(refs, centroids)
    found = ivf.search_i16(q, index, centroids, nprobe=3, skip_own=True).collect()
    whole = {i: np.rint(np.array(v) * 32767) for i, v, _ in rows}
    for qid in (20, 40, 60, 80, 100):
        best = sorted((float(((whole[i] - whole[qid]) ** 2).sum()), i) for i in whole if i != qid)[:5]
        got = sorted((r["rank"], r.ref_id, r.distance) for r in found if r.qid == qid)
        assert [g[1] for g in got] == [i for _, i in best]
        assert [g[2] for g in got] == pytest.approx([d**0.5 / 32767 for d, _ in best])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_recall_of_the_index_over_events(spark, sf):
    v = adapters.written_vectors(spark, f"/root/testdata/{sf}")
    q, r, c = adapters.event_queries(v).select("qid", "v"), adapters.event_refs(v).select("ref_id", "v", "y"), adapters.event_centroids(v)
    exact = {(x.qid, x.ref_id) for x in knn.knn(q, r, skip_own=True).collect()}
    found = {(x.qid, x.ref_id) for x in ivf.search(q, ivf.assign(r, c), c, skip_own=True).collect()}
    assert len(exact & found) >= 0.9 * len(exact)
