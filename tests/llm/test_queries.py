"""The registered queries that SQL does not express, and the whole pipeline, against second implementations on a small table."""

import hashlib
import os
import re
import struct
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import zstandard

import corpus_pipeline
from heronlake.llm import langid, pii, queries, secrets
from tests.llm.test_joins import brute_components, brute_hits
from tests.llm.test_text import brute_spans
from tests.test_entry import DATA

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{DATA}/documents.parquet'").fetchall()


def sha(content):
    return hashlib.sha256(content.encode() if isinstance(content, str) else content).hexdigest()


def rows_of(spark, name):
    return [x.asDict() for x in queries.queries()[name](spark, DATA).collect()]


def leaf(tree, binned):
    at = 0
    while tree[at][0] >= 0:
        at = int(tree[at][2] if binned[int(tree[at][0])] <= tree[at][1] else tree[at][3])
    return tree[at][4]


def brute_secrets(text, path, model):
    """Spans of secrets: every tree is walked for every candidate on its own."""
    kept = []
    for a, b, rule in secrets.candidates(text):
        x = model.features.of(text[a : min(b, a + secrets.READ)], text[max(0, a - secrets.CONTEXT) : a], text[b : b + secrets.CONTEXT], path)
        binned = [int(np.searchsorted(c, v, side="left")) for c, v in zip(model.forest.cuts, x, strict=True)]
        if sum(leaf(t, binned) for t in model.forest.trees) / len(model.forest.trees) >= secrets.THRESHOLD:
            kept.append((a, b, rule))
    merged = []
    for a, b, rule in kept:
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], b), merged[-1][2])
        else:
            merged.append((a, b, rule))
    return merged


def masked(text, spans):
    for a, b, _ in reversed(spans):
        text = text[:a] + "[SECRET]" + text[b:]
    return text


@pytest.fixture(scope="module")
def model():
    return secrets.standard(queries.tokenizer(queries.BPE_FILE))


def test_op1_equals_a_walk_through_every_tree(spark, model):
    larger = DATA.replace("sf0.001", "sf0.01")  # the smallest tables hold no secret
    docs = duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{larger}/documents.parquet'").fetchall()
    found = {x.doc_id: x for x in queries.op1_secret_scan(spark, larger).collect()}
    assert len(found) == len(docs) and sum(x["n_secrets"] for x in found.values()) > 5
    for d, text, _, source in docs:
        own = brute_secrets(text or "", source or "", model)
        assert found[d]["spans"] == ",".join(f"{rule}:{a}:{b}" for a, b, rule in own)
        assert found[d]["redacted_sha256"] == sha(masked(text or "", own))


def test_op2_equals_the_library(spark, docs):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    from heronlake.llm import unigram

    made = pb.ModelProto()
    made.ParseFromString(open(queries.tokenizer(queries.UNIGRAM_FILE), "rb").read())
    unigram.rescored(made).trainer_spec.model_type = 1
    processor = sentencepiece.SentencePieceProcessor(model_proto=made.SerializeToString())
    found = {x["doc_id"]: x["n_tokens"] for x in rows_of(spark, "op2_token_counts")}
    assert found == {d: len(processor.encode(text or "")) for d, text, *_ in docs}


def tiktoken_row(d, text, encoding):
    ids = encoding.encode_ordinary(text or "")
    return {"doc_id": d, "n_tokens": len(ids), "ids_sha256": sha(struct.pack(f"<{len(ids)}I", *ids)), "decoded_sha256": sha(encoding.decode_bytes(ids))}


@pytest.fixture(scope="module")
def encoding():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.tokenizer(queries.BPE_FILE), "rb"))}
    return tiktoken.Encoding("own", pat_str=queries.pattern(), mergeable_ranks=ranks, special_tokens={})


def test_op8_equals_the_library(spark, docs, encoding):
    by_id = lambda rows: sorted(rows, key=lambda x: x["doc_id"])
    assert by_id(rows_of(spark, "op8_byte_level_bpe")) == by_id([tiktoken_row(d, text, encoding) for d, text, *_ in docs])


def brute_pii(rows):
    """Base and added spans of (id, text) rows; the graph as dictionaries."""
    own = [(d, text or "", brute_spans(text or "")) for d, text in rows]
    every = [(d, x) for d, text, base in own for x in pii.instances(text, base)]
    edges = {(p, x["value"], x["kind"], x["seed"]) for _, x in every for p in x["patterns"]}
    score, held = {e: float(e[3]) for e in edges}, defaultdict(int)
    for p, *_ in edges:
        held[p] += 1
    for turn in range(pii.ROUNDS):
        total, seeds = defaultdict(float), defaultdict(int)
        for (p, _, kind, _), s in score.items():
            total[p, kind] += s
            seeds[p, kind] += s >= pii.MIN_SCORE
        kept = {k: total[k] / held[k[0]] for k in total if seeds[k] >= pii.MIN_SEEDS and total[k] / held[k[0]] >= pii.MIN_START}
        best = defaultdict(float)
        for p, value, kind, seed in edges:
            if not seed:
                best[value, kind] = max(best[value, kind], kept.get((p, kind), 0.0))
        score = {e: 1.0 if e[3] else best[e[1], e[2]] for e in edges}
    good = {k for k, p in kept.items() if p >= pii.MIN_SCORE}
    added = defaultdict(set)
    for d, x in every:
        if not x["seed"] and any((p, x["kind"]) in good for p in x["patterns"]):
            added[d].add((x["kind"], x["start"], x["end"]))
    return {d: (base, sorted(added[d])) for d, _, base in own}


def written(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)


def test_op9_equals_brute_force(spark, docs):
    wanted = brute_pii([(d, text) for d, text, *_ in docs])
    for x in rows_of(spark, "op9_pii"):
        base, added = wanted[x["doc_id"]]
        assert x["base_sha256"] == sha(written(base)) and x["spans"] == written(sorted(base + added))
        assert [x[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == i for s in base) for i in range(4)]


def test_context_over_several_tokens_and_rounds(spark):
    """What one pattern discovers makes seeds for another, which no find by form stands in."""
    rows = [(i, f"please ring me at +1 555 010 {1000 + i} today") for i in range(30)]
    rows += [(100 + i, f"please ring me at ({200 + i}) 555-01{10 + i} today") for i in range(6)]
    rows += [(200 + i, f"his extension was ({200 + i}) 555-01{10 + i} then") for i in range(6)] + [(300, "his extension was (499) 555-0199 then"), (301, "sum (499) 555-0199 of")]
    rows += [(400, "his extension was " + "9" * 30_000 + " then")]
    found = {x.doc_id: (sorted(map(tuple, x.base)), sorted(map(tuple, x.added))) for x in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == brute_pii(rows)
    assert found[100][1] == [(3, 18, 32)] and found[300][1] == [(3, 18, 32)] and found[301][1] == [] and found[400] == ([], [])


def brute_language(text, dictionaries):
    """Language and whether it is rejected: every block by a fresh compressor."""
    if not text or not any(c.isalpha() for c in text):
        return "und", True
    raw = langid.normal(text)
    blocks = [raw[i : i + langid.BLOCK_BYTES] for i in range(0, len(raw), langid.BLOCK_BYTES)]
    sizes = []
    for lang, d in sorted(dictionaries.items()):
        content = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = zstandard.ZstdCompressionParameters.from_level(langid.LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0)
        size = lambda x: len(zstandard.ZstdCompressor(dict_data=content, compression_params=params).compress(x))  # noqa: E731, B023
        sizes.append((sum(map(size, blocks[:-1])) + size(blocks[-1] + d[-langid.TAIL_BYTES :]), lang))
    sizes.sort()
    return sizes[0][1], (sizes[1][0] - sizes[0][0]) / sizes[1][0] < langid.MARGIN


def brute_dictionaries(spark):
    """The sample as whole rows in order."""
    rows = spark.read.parquet(f"{DATA}/documents.parquet").where("lang is not null and text is not null and crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
    by_lang = defaultdict(list)
    for x in sorted(rows.selectExpr("lang", "pmod(xxhash64(doc_id, lang), 1 << 30) AS h", "text").collect(), key=lambda x: (x.lang, x.h)):
        by_lang[x.lang].append(x.text[: langid.SAMPLE_CHARS])
    return {k: b"\n".join(langid.normal(t) for t in x[: langid.SAMPLE_ROWS] if any(c.isalpha() for c in t))[: langid.DICTIONARY_BYTES] for k, x in by_lang.items()}


def test_op10_equals_plain_zstandard(spark, docs):
    d = brute_dictionaries(spark)
    found = {x["doc_id"]: x for x in rows_of(spark, "op10_language_id")}
    assert len(found) == len(docs)
    for i, text, *_ in docs:
        assert (found[i]["lang_pred"], found[i]["rejected"]) == brute_language(text, d)


def test_the_pipeline_equals_brute_force(spark, docs, model, encoding):
    d = brute_dictionaries(spark)
    kept = [(i, text, source) for i, text, _, source in docs if not brute_language(text, d)[1]]
    low = {i: c for i, _, c in brute_components([(i, text) for i, text, _ in kept])}
    kept = [x for x in kept if low[x[0]] == x[0]]
    items = duckdb.sql(f"SELECT item_id, text FROM '{DATA}/benchmark.parquet'").fetchall()
    hit = {i: n for i, _, n, _ in brute_hits([x[:2] for x in kept], items)}
    kept = [x for x in kept if not hit[x[0]]]
    wanted = [tiktoken_row(i, masked(text or "", brute_secrets(text or "", source or "", model)), encoding) for i, text, source in kept]
    found = [x.asDict() for x in corpus_pipeline.run(spark, DATA).collect()]
    assert len(docs) > len(wanted) > 100
    assert sorted(found, key=lambda x: x["doc_id"]) == sorted(wanted, key=lambda x: x["doc_id"])


def test_rare_and_repeated_labels_leave_accuracy(spark):
    """One document of its own language, and a language of few ids repeated many times, change little for the others."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(DATA.replace("sf0.001", "sf0.01") + "/documents.parquet").select("doc_id", "text", "lang")
    rare = spark.createDataFrame([(10**6 + 2, "one odd label", "rare")], docs.schema)
    often = spark.range(20).select(F.lit(2 * 10**6) + F.col("id"), F.concat(F.lit("zq xw "), F.col("id").cast("string"), F.lit(" vux")), F.lit("often"))
    often = often.crossJoin(spark.range(500).select(F.lit(1).alias("n"))).drop("n")
    plain, more = langid.fit(docs), langid.fit(docs.union(rare).union(often))
    assert set(more) - set(plain) == {"rare", "often"} or re.match("rare", sorted(set(more) - set(plain))[-1])
    assert {k: v for k, v in more.items() if k in plain} == plain and more["often"].count(b"vux") > 8
    held = docs.where(langid.held_out(F.col("doc_id"))).where("text is not null")
    right = lambda d: langid.predict(held, d).join(held.select("doc_id", "lang"), "doc_id").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0]
    assert abs(right(plain) - right(more)) <= 0.005
