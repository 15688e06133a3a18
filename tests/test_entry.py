"""The registered queries against their SQL on the small tables, and the guard for the llm subpackage."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def compare(spark, found, sql):
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{DATA}/{name}'")
    a, b = con.execute(sql).df(), found.toPandas()
    assert sorted(a.columns) == sorted(b.columns)
    c = sorted(a.columns)
    assert sorted(map(str, a[c].values.tolist())) == sorted(map(str, b[c].values.tolist()))


def names():
    from heronlake.plans import catalogue

    return sorted(catalogue.oracles())


@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, name):
    from heronlake.plans import catalogue

    compare(spark, catalogue.queries()[name](spark, DATA), catalogue.oracles()[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_llm(tmp_path):
    """The rest imports and lists its queries where the subpackage and the pipeline are gone."""
    import shutil

    for name in ("__spark_entry__.py", "heronlake"):
        source = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "heronlake" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'q_knn_vote' in q and not any(k.startswith('op') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
