"""The pipeline's stages on planted documents, and the queries against their SQL."""

import os
import random

import pytest

import corpus_pipeline
from heronlake.llm import oracles, queries
from tests.test_entry import DATA, compare

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_planted_documents(spark, tmp_path):
    r = random.Random(3)
    parts = {"en": "th er on the ing and".split(), "de": "sch ung keit der ver ein".split()}

    def prose(lang, n=60):
        return " ".join("".join(r.choice(parts[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))

    texts = [(prose(lang), lang) for lang in ["en", "de"] * 30]
    item = prose("en", 30)
    copy, leak = texts[0][0] + " end", prose("en", 20) + " " + item + " " + prose("en", 20)
    secret = prose("de", 30) + " password=b7db7aa4a5fcc78305 " + prose("de", 5)
    texts += [(copy, "en"), (leak, "en"), (secret, "de"), ("12 34 56", "en"), (None, "de"), ("", None)]
    rows = [(i, t, lang, "src0", len(t) if t is not None else None) for i, (t, lang) in enumerate(texts)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name.replace(" ", "_"))
        stage(spark, docs, str(tmp_path)).write.parquet(out)
        docs = spark.read.parquet(out)
        kept.append(sorted(x.doc_id for x in docs.collect()))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    everything = list(range(63))
    assert kept[0] == everything
    assert kept[1] == [i for i in everything if i != 60]
    assert kept[2] == kept[3] == kept[4] == [i for i in everything if i not in (60, 61)]
    masked = spark.read.parquet(str(tmp_path / "secret_scan")).where("doc_id = 62").first()
    assert "password=[SECRET] " in masked.text and masked.n_chars == len(masked.text)
    again = sorted(tuple(x) for x in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert again == sorted(tuple(x) for x in docs.collect())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(oracles.oracles()))
def test_query_equals_sql(spark, name):
    compare(spark, queries.queries()[name](spark, DATA), oracles.oracles()[name])


def test_every_operator_has_one_query():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == list(range(1, 11))
