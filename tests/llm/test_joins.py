"""Jaccard components, decontamination and exact search against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from heronlake.llm import balltree, decontaminate, jaccard
from heronlake.llm.common import Tables
from heronlake.llm.components import components


def shingles(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} - {()}


def brute_components(rows, percent=85):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low.setdefault(find(i), []).append(d)
    return sorted((d, len(sets[i]), min(low[find(i)])) for i, (d, _) in enumerate(rows))


def near_copies(seed, groups=6, size=14, words=60):
    r = random.Random(seed)
    rows, vocabulary = [], [f"w{i}" for i in range(400)]
    for _ in range(groups):
        base = [r.choice(vocabulary) for _ in range(words)]
        for _ in range(size):
            copy = list(base)
            for _ in range(r.randrange(4)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary) + "x"
            if r.random() < 0.3:
                copy = copy[r.randrange(4) :]
            if r.random() < 0.3:
                base = copy  # chains of copies
            rows.append(" ".join(copy))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_equal_brute_force(spark, seed):
    r = random.Random(seed)
    texts = near_copies(seed) + ["", None, "  \n ", "one", "ONE", "two words", "Two  Words", "a b c", "É x y z", "é x y z"] + ["the very same line of text"] * 5
    r.shuffle(texts)
    rows = list(enumerate(texts))
    found = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in found.collect()) == brute_components(rows)


@pytest.mark.parametrize("size,nodes", [(1 << 19, 1 << 10), (600, 8)])
def test_every_link_is_counted(spark, monkeypatch, size, nodes):
    """One hub is enough to connect a group; the links between its other members count all the same, in one block or in many."""
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", size)
    monkeypatch.setattr(jaccard, "BLOCK_NODES", nodes)
    texts = near_copies(4, groups=3, size=25) + ["", None, "one", "ONE", "a b c"] + ["the very same line of text"] * 5
    texts += texts[:7] + [texts[0]]
    sets = [shingles(t) for t in texts]
    alike = lambda x, y: bool(x and y) and 100 * len(x & y) >= 85 * len(x | y)
    wanted = [(i, sum(alike(x, y) for j, y in enumerate(sets) if j != i)) for i, x in enumerate(sets)]
    found = jaccard.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted((x.doc_id, x.n_links) for x in found.collect()) == wanted


def test_a_star_that_needs_many_rounds(spark):
    """Sets that share their rarest n-grams without being similar stay apart, similar ones among them meet."""
    common = " ".join(f"c{i}" for i in range(20))
    texts = [common + " " + " ".join(f"u{j}x{i}" for i in range(12)) for j in range(12)]
    texts += [t + " tail" for t in texts[:5]]
    rows = list(enumerate(texts))
    found = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in found.collect()) == brute_components(rows)


def test_lists_in_many_parts(spark, monkeypatch):
    """Hubs come from some parts of a list only, at first from one; later rounds reach all parts."""
    monkeypatch.setattr(jaccard, "LIST_ROWS", 3)
    monkeypatch.setattr(jaccard, "HUB_GROWTH", 4)
    common = " ".join(f"c{i}" for i in range(20))
    texts = [common + " " + " ".join(f"u{j}x{i}" for i in range(12)) for j in range(12)]
    texts += [t + " tail" for t in texts[:5]] + near_copies(5, groups=2, size=15)
    rows = list(enumerate(texts))
    found = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in found.collect()) == brute_components(rows)


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    rows = [(5, "a b c d e", 1), (5, "a b c d e", 1), (None, "a b c d e", 2), (7, "other words are here now", 3), (None, "alone in the world today", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h long")
    found = sorted(((x.doc_id, x.component_id) for x in jaccard.join(docs).collect()), key=str)
    assert found == sorted([(5, 5), (5, 5), (None, 5), (7, 7), (None, None)], key=str)
    kept = sorted((x.doc_id, x.text) for x in jaccard.keep_one(docs).collect() if x.doc_id)
    assert kept == [(5, "a b c d e"), (7, "other words are here now")]
    assert jaccard.keep_one(docs).columns == docs.columns
    assert jaccard.join(docs.limit(0)).count() == 0


def test_components_of_chains_and_circles(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (102, 100)] + [(200, 300 + i) for i in range(20)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), Tables(spark, "t"), "c").collect()}
    assert {found[i] for i in range(61)} == {0} and {found[i] for i in (100, 101, 102)} == {100} and {found[300 + i] for i in range(20)} == {200}


def bwords(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(docs, items, window=10):
    out = []
    for d, text in docs:
        w, covered, met = bwords(text), set(), set()
        for i, item in items:
            x = bwords(item)
            n = min(window, len(x))
            wins = {tuple(x[a : a + n]) for a in range(len(x) - n + 1)} if x else set()
            for p in range(len(w) - n + 1) if n else []:
                if tuple(w[p : p + n]) in wins:
                    covered |= set(range(p, p + n))
                    met.add("null" if i is None else str(i))
        out.append((d, len(w), len(covered), sorted(met)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,most", [(1, 500_000), (2, 500_000), (3, 5)])
def test_decontamination_equals_brute_force(spark, monkeypatch, seed, most):
    monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", most)
    r = random.Random(seed)
    vocabulary = ["the", "of", "É", "é", "x1", "Zeta", "straße", "K", "漢字", "a", "b", "c"]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, say(r.choice([3, 9, 10, 11, 25]))) for i in range(12)] + [(90, "Solo"), (91, ""), (92, None), (10, say(12)), (None, say(14)), (93, "of-of of")]
    docs = []
    for d in range(40):
        text = say(r.randrange(40))
        if r.random() < 0.6:
            item = r.choice(items)[1] or ""
            cut = item.split(" ")
            text += r.choice([" ", "--", "\n"]) + " ".join(cut[r.randrange(3) :]).upper().replace("É", "É") + r.choice(["", ". ", "!"]) + say(5)
        docs.append((d, text))
    docs += [(100, None), (101, ""), (102, "solo"), (103, "...")] + [docs[0]] * 3
    found = decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(((x.doc_id, x.n_words, x.n_hit, list(x["items"])) for x in found.collect()), key=str) == brute_hits(docs, items)


def test_decontamination_of_empty_tables_and_cleaning(spark):
    docs = spark.createDataFrame([(1, "one two three four", 7), (2, "five six", 8)], "doc_id long, text string, h long")
    items = spark.createDataFrame([(1, "two three four")], "item_id long, text string")
    assert decontaminate.find(docs.limit(0), items).count() == 0
    assert [x.n_hit for x in decontaminate.find(docs, items.limit(0)).collect()] == [0, 0]
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and [x.doc_id for x in kept.collect()] == [2]


def brute_top(rows, queries, k=10):
    out = []
    for q, v in queries:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard_rows,block_rows", [(1000, 1000), (40, 1000), (40, 3)])
def test_top_k_equals_brute_force(spark, shard_rows, block_rows):
    import math

    r = random.Random(4)
    rows = [(i, [r.choice([r.uniform(-1, 1), 0.5, -0.25]) for _ in range(5)]) for i in range(200)] + [(1000 + i, [0.5] * 5) for i in range(60)]
    bad = [(3000, None), (3100, [1.0, None, 1.0, 1.0, 1.0]), (3200, [float("nan")] * 5), (3300, [float("inf")] * 5), (None, [1.0] * 5)]
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    found = balltree.top_k(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, shard_rows=shard_rows, block_rows=block_rows)
    assert sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in found.collect()) == brute_top(whole, [x for x in whole if x[0] % 20 == 0])


def test_top_k_of_few_rows(spark):
    rows = spark.createDataFrame([(0, [1.0]), (1, [1.0]), (1, [1.0])], "vec_id long, embedding array<float>")
    assert [(x.query_id, x["rank"], x.vec_id) for x in balltree.top_k(rows, F.col("vec_id") == 0).collect()] == [(0, 1, 1), (0, 2, 1)]
    assert balltree.top_k(rows.limit(0), F.col("vec_id") == 0).count() == 0


def test_ball_tree_prunes():
    import numpy as np

    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 8)) * 1000
    v = np.floor(centres.repeat(100, axis=0) + rng.normal(size=(2000, 8)))
    tree = balltree.BallTree(np.arange(2000), v)
    scores = v @ v[0]
    best = sorted(zip(-scores, range(2000)))[:6]
    assert tree.search(v[0], 0, 5) == [(int(-s), i) for s, i in best if i != 0][:5]


def test_scores_that_doubles_do_not_hold_are_refused(spark):
    rows = spark.createDataFrame([(0, [1e12, 1.0], "x"), (1, [1e12, 2.0], "y")], "vec_id long, embedding array<double>, v string")
    with pytest.raises(ValueError):
        balltree.top_k(rows, F.col("vec_id") == 0)
    small = rows.select("vec_id", F.transform("embedding", lambda x: x / 1e9).alias("embedding"), "v")
    assert balltree.top_k(small, F.col("vec_id") == 0).count() == 1


def test_long_texts_in_joins(spark):
    """A text of 60,000 words, its near copy, and a benchmark passage far inside it."""
    r = random.Random(9)
    long = [f"w{r.randrange(5000)}" for _ in range(60_000)]
    item = [f"q{i}" for i in range(30)]
    copy = long[:40_000] + item + long[40_000:]
    docs = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(copy)), (3, "short one")], "doc_id long, text string")
    assert {x.doc_id: x.component_id for x in jaccard.join(docs).collect()} == {1: 1, 2: 1, 3: 3}
    items = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    assert {x.doc_id: (x.n_hit, list(x["items"])) for x in decontaminate.find(docs, items).collect()} == {1: (0, []), 2: (30, ["7"]), 3: (0, [])}


def test_an_item_whose_windows_are_in_every_document(spark, monkeypatch):
    """One hot shingle, by a broadcast and, beyond the bound, by key."""
    docs = [(i, f"d{i} " + " ".join(f"c{j}" for j in range(12)) + f" e{i}") for i in range(200)]
    items = [(1, " ".join(f"c{j}" for j in range(12))), (2, "x0 " + " ".join(f"c{j}" for j in range(11)))]
    for most in (500_000, 5):
        monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", most)
        found = decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
        assert sorted(((x.doc_id, x.n_words, x.n_hit, list(x["items"])) for x in found.collect()), key=str) == brute_hits(docs, items)
