"""What searches of neighbours leave on disk while they run."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from heronlake.operators import cells
from heronlake.plans import adapters, catalogue
from heronlake.sources.shared import SHUFFLE_CLEANUP, Tables

DIR = "/root/testdata/sf0.001"


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    rows = spark.range(10_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.count("*").alias("n"))
    before, setting = shuffle_files(spark), spark.conf.get(SHUFFLE_CLEANUP, None)
    table = Tables(spark, "t").write(rows, "rows")
    for _ in range(50):  # they are removed in the background
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == setting and table.count() == 1000


@pytest.mark.parametrize("most, joins", [(10_000, 0), (5, 1)])
def test_few_merchants_are_broadcast_and_many_are_not(spark, monkeypatch, most, joins):
    want = sorted(map(tuple, adapters.vectors(spark, DIR).collect()))
    monkeypatch.setattr(adapters, "BROADCAST_ROWS", most)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = adapters.vectors(spark, DIR)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert sum("SortMergeJoin [k#" in line for line in plan.splitlines()) == joins
        assert sorted(map(tuple, found.collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_labels_are_joined_for_queries_only(spark):
    plan = catalogue.queries()["q_confusion"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    labels = [line for line in plan.splitlines() if "Filter" in line and "% 20" in line]
    assert len(labels) >= 2  # the queries' and the labels'


def test_packed_rows_are_compressed_without_loss():
    r = np.random.default_rng(2)
    x = np.stack([r.integers(0, 10_001, 4096) / 10_000, *[r.integers(0, 12, 4096) / 10 for _ in range(13)]], axis=1)
    assert (cells.unpack(cells.pack(x), len(x)) == x).all() and len(cells.pack(x)) < 1.5 * x.size  # of two bytes each
    for code in ("<i8", "<i4", "<f4", "<f8"):
        for some in (np.arange(-5, 5).astype(code), np.zeros(0, code)):
            assert (cells.spread(cells.squeeze(some), code) == some).all()
    assert len(cells.unpack(cells.pack(np.zeros((0, 3))), 0)) == 0


def test_bounds_are_packed_upwards():
    bound = np.array([0.1, 1 / 3, 7.0, np.inf])
    _, n, _, _, packed, _ = cells._asked(np.zeros(4, np.int64), np.arange(4), np.zeros((4, 2)), bound)
    found = cells.spreads(packed, "<f4").astype(float)
    assert n == [4] and (found >= bound).all() and (found[:3] < bound[:3] * (1 + 1e-6)).all()


def test_many_events_are_written_in_parts_and_dropped_once_packed(spark, monkeypatch):
    names = ("q_knn_exact", "q_confusion")
    want = [sorted(map(tuple, catalogue.queries()[q](spark, DIR).collect())) for q in names]
    rows = sorted(map(tuple, adapters.written_vectors(spark, DIR).collect()))
    monkeypatch.setattr(adapters, "PART_ROWS", 300)
    for name, value in (("PLAIN_REFS", 10), ("PLAIN_PAIRS", 10), ("CELL_ROWS", 200)):
        monkeypatch.setattr(cells, name, value)
    written, made = Tables.write, []
    monkeypatch.setattr(Tables, "write", lambda self, df, name: made.append((self, name)) or written(self, df, name))
    assert sorted(map(tuple, adapters.written_vectors(spark, DIR).collect())) == rows
    parts = [name for _, name in made]
    assert parts == [f"rows{i}" for i in range(len(parts))] and 1 < len(parts) <= adapters.MOST_PARTS
    for q, expected in zip(names, want, strict=True):
        made.clear()
        found = catalogue.queries()[q](spark, DIR)
        path, files = made[0][0]._files(made[0][0].base)
        assert made[0][1] == "rows0" and not files.exists(path)
        assert sorted(map(tuple, found.collect())) == expected
