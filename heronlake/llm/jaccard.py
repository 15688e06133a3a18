"""N-gram Jaccard self-join with exact results, as connected components.

Documents are sets of word n-grams. Equal sets are one node. A node's n-grams are put in an order that is the same for all,
rare first; two sets of the wanted similarity share one of the first few (the prefix). Nodes are joined on
prefix n-grams, pairs pass a length, a positional and a suffix filter, and each pair is verified once on the whole sets.

Components need no pair within one that is already connected, so pairs are made in rounds: in each n-gram's list the nodes
where it comes first in order (the most central ones, of which hubs are taken) are paired with the rest of the list that is not
yet connected to them; verified links join components; the next round takes the next hubs, sixteen times as many. A list is
done when all that is left of it is one component. Every pair of a list has then either been filtered, verified or found
connected, so the components are those of all pairs.

Links lie within components, so once these are known every pair of a component whose lengths allow it is verified, block by
block: the links are counted in full, whatever the hubs were.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Bounded, Tables, by_batch, by_key, hold, only, pick, slices, small_batches, without
from .components import components

#: Cells of the table of n-gram counts, by which rare ones come first. Cells are shared by hash, which changes the order, not the result.
CELL_BITS, CHUNK_BITS = 20, 12
#: Parts that fixed pivots cut from the hash range, for the suffix filter.
PARTS = 16
#: N-grams in the sets that are compared with one hub's in one group: 4 MB of hashes.
GROUP_SHINGLES = 1 << 19
#: Nodes that are looked up by a broadcast of their ids, 24 MB of longs; more are joined by a shuffle.
BROADCAST_NODES = 1_000_000
HUB_GROWTH = 16
#: Nodes of one n-gram's list that meet its hubs in one task.
LIST_ROWS = 512
#: N-grams, and nodes, in one block of a component; two blocks meet in one group.
BLOCK_SHINGLES, BLOCK_NODES = 1 << 20, 1 << 11
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]

_words = Bounded(xxhash.xxh3_64_intdigest, 100_000)
hold(__name__, _words.forget)


def shingle_sets(texts: list[str | None], n: int = 4) -> list[np.ndarray]:
    """The sorted different 64-bit hashes of each text's word n-grams. A-Z are lowered, words are cut at space and \\x09-\\x0D
    (what bytes.lower() and bytes.split() do); fewer words than n are one n-gram. The texts are hashed as one row of words, and
    n-grams that cross from one to the next are passed over."""
    words = [(x or "").encode("utf-8", "surrogatepass").lower().split() for x in texts]
    sizes = [len(x) for x in words]
    out = [np.zeros(0, np.uint64)] * len(texts)
    h = np.fromiter(map(_words.__getitem__, chain.from_iterable(words)), np.uint64, sum(sizes))
    if not len(h):
        return out
    # By the number of words in an n-gram: n, and fewer for the texts that have no more.
    mixed = {size: _mixed(h, size) for size in {min(n, k) for k in sizes if k}}
    at = 0
    for i, k in enumerate(sizes):
        if k:
            size = min(n, k)
            s = np.sort(mixed[size][at : at + k - size + 1])
            out[i] = s if k == size else s[np.concatenate([[True], s[1:] != s[:-1]])]
            at += k
    return out


def _mixed(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each size neighbouring words' hashes and of size."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    s = np.full(len(h) - size + 1, np.uint64(size), np.uint64)
    for i in range(size):
        s += h[i : len(h) - size + 1 + i] * ODD[i % 8] + np.uint64(i // 8)
    s ^= s >> np.uint64(30)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    s ^= s >> np.uint64(27)
    s *= np.uint64(0x94D049BB133111EB)
    s ^= s >> np.uint64(31)
    return s


def _counts(docs: DataFrame, n: int) -> np.ndarray:
    """How many documents hold an n-gram of each cell. Tasks count on their own; their counts meet cell range by cell range as a
    running sum, and the driver gets one table of fixed size."""
    chunk = 1 << CHUNK_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(__name__)
        cells = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            for part in slices(batch):
                cells += np.bincount(_cells(np.concatenate(shingle_sets(part.column(0).to_pylist(), n))), minlength=len(cells))
        parts = cells.reshape(-1, chunk)
        full = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([zlib.compress(parts[i].tobytes(), 1) for i in full], pa.binary())], names=["part", "cells"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(zlib.decompress(data), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["part", "cells"])

    small_batches(docs.sparkSession)
    met = docs.select("text").mapInArrow(count, "part int, cells binary").repartition("part").mapInArrow(add, "part int, cells binary")
    table = np.zeros((1 << CELL_BITS) // chunk * chunk, np.int64).reshape(-1, chunk)
    for row in met.collect():
        table[row["part"]] = np.frombuffer(row["cells"], np.int64)
    return np.minimum(table.reshape(-1), 2**31 - 1).astype(np.int32)


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _sets(docs: DataFrame, n: int, percent: int, counts: np.ndarray) -> DataFrame:
    """doc_id, h, n_shingles, set_hash, prefix, parts of each (doc_id, h, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        sets = shingle_sets(batch.column(2).to_pylist(), n)
        often, at = shared.value[_cells(np.concatenate(sets))] if sets else np.zeros(0), 0
        prefixes, parts = [], []
        for s in sets:
            first = min(len(s), len(s) + 1 - (percent * len(s) + 99) // 100)
            own = often[at : at + len(s)]
            at += len(s)
            # Equal counts are ordered by hash, as the sets are: the order is the same in all sets.
            near = np.flatnonzero(own <= np.partition(own, first - 1)[first - 1]) if first else np.zeros(0, int)
            prefixes.append(s[near[np.argsort(own[near], kind="stable")[:first]]].view(np.int64))
            parts.append(np.diff(np.searchsorted(s, EDGES), append=len(s)))
        sizes = pa.array([len(s) for s in sets], pa.int64())
        hashes = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())
        return [batch.column(0), batch.column(1), sizes, hashes, pa.array(prefixes, pa.list_(pa.int64())), pa.array(parts, pa.list_(pa.int32()))]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_batch(docs, f"doc_id {kind}, h long, n_shingles long, set_hash binary, prefix array<long>, parts array<int>", run)


def _texts_as_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """id, s: the packed set of each wanted (id, doc_id, h)."""
    few = wanted.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
    on = docs["doc_id"].eqNullSafe(wanted["doc_id"]) & (docs["h"] == wanted["h"])
    texts = docs.join(F.broadcast(wanted) if few else wanted, on).select("id", "text")

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        return [batch.column(0), pa.array([s.tobytes() for s in shingle_sets(batch.column(1).to_pylist(), n)], pa.binary())]

    return by_batch(texts, "id long, s binary", run).dropDuplicates(["id"])


#: Where the parts of the hash range begin.
EDGES = np.arange(PARTS, dtype=np.uint64) << np.uint64(60)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, linked of pairs (a, b, groups), grouped by a, a hub's in as many groups of bounded size, to each of which its set is sent."""
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).alias("group"))
    groups = pairs.groupBy("a").agg(F.first("groups").alias("groups"))
    hubs = groups.join(sets, groups.a == sets.id).select(F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("part"), F.col("s").alias("hub_s"))
    others = dealt.join(sets, dealt.b == sets.id).select("a", "group", "b", F.col("s").alias("other_s"))

    def run(key: tuple, hub: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[bool] = []
        if hub.num_rows and rows.num_rows:
            x = np.frombuffer(hub["hub_s"][0].as_py(), np.uint64)
            for item in rows["other_s"]:
                y = np.frombuffer(item.as_buffer(), np.uint64)
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                both = int((x[at] == y).sum())
                out.append(100 * both >= percent * (len(x) + len(y) - both))
        ids = rows["b"].to_pylist() if out else []
        return pa.table({"a": pa.array([key[0].as_py()] * len(out), pa.int64()), "b": pa.array(ids, pa.int64()), "linked": pa.array(out, pa.bool_())})

    return hubs.groupBy("hub", "part").cogroup(others.groupBy("a", "group")).applyInArrow(run, "a long, b long, linked boolean")


def join(docs: DataFrame, n: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, n_links: one row for each document row.

    Two documents link when their sets' Jaccard similarity is at least percent / 100; component_id is the smallest doc_id that
    links reach, itself included. Null, empty and blank texts have no n-grams and link with nothing. Repeated rows link like
    others; null ids join components but name one only if it has no other id. n_links is the number of other rows that the row
    links with: every pair of different sets is verified, and copies of a set count as often as they occur without being
    expanded into pairs. Memory of a task is bounded by one document, one hub's group of pairs, and two blocks."""
    return _join(pick(docs, doc_id=doc_id, text=text), n, percent).drop("h")


def keep_one(docs: DataFrame, n: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, of which one of each component stays: that with the smallest doc_id, and of
    repeated rows one. Rows without n-grams all stay."""
    found = _join(pick(docs, doc_id=doc_id, text=text), n, percent)
    found = Tables(docs.sparkSession, "copies").write(found.select("doc_id", "h", "n_shingles", "component_id"), "found")
    kept = without(docs, found.where("not doc_id <=> component_id").select("doc_id", "h").distinct(), doc_id, text)
    again = found.where("n_shingles > 0 and doc_id <=> component_id").groupBy("doc_id", "h").count().where("count > 1")
    if again.isEmpty():
        return kept
    names = [f"c{i}" for i in range(len(docs.columns))]
    first = kept.toDF(*names).withColumn("_n", F.monotonically_increasing_id())
    first = Tables(docs.sparkSession, "repeated").write(first, "rows")
    key, h = F.col(names[docs.columns.index(doc_id)]), F.xxhash64(names[docs.columns.index(text)])
    again = again.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"))
    repeated = first.select(key.alias("_key"), h.alias("_text"), "_n").join(again, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_h")))
    stays = repeated.groupBy("_key", "_text").agg(F.min("_n").alias("_first"))
    stays = stays.select(F.col("_key").alias("_id"), F.col("_text").alias("_h"), "_first")
    later = repeated.drop("_id", "_h").join(stays, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_h"))).where("_n > _first")
    return first.join(later.select("_n"), "_n", "left_anti").select(*names).toDF(*docs.columns)


def _join(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """What join() returns, with h, the hash of the text. A node is a set; its id is the least number of a row that has it."""
    docs = docs.withColumn("h", F.xxhash64("text"))
    tables = Tables(docs.sparkSession, "jaccard")
    counts = _counts(docs, n)
    rows = _sets(docs.select("doc_id", "h", "text"), n, percent, counts).withColumn("id", F.monotonically_increasing_id())
    rows = tables.write(rows, "rows")
    total = rows.count()
    grouped = rows.where("set_hash is not null").groupBy("set_hash").agg(F.min("id").alias("id"), F.min("doc_id").alias("low"), F.count("*").alias("copies"))
    nodes = tables.write(grouped, "nodes")
    # The rows that stand for a set; where their ids are few, no prefix is moved.
    ids = nodes.select("id")
    few = ids.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
    described = rows.join(F.broadcast(ids) if few else ids, "id", "left_semi").select("id", "doc_id", "h", F.col("n_shingles").alias("n"), "prefix", "parts")
    described = tables.write(described, "described")
    labels, sets = _links(docs, described, tables, n, percent, total)

    plain = nodes.select("set_hash", "id", "low", "copies")
    labelled = tables.write(plain.join(labels, plain.id == labels.node), "labelled")
    lowest = labelled.groupBy("root").agg(F.min("low").alias("component"), F.count("*").alias("k"))
    degree = tables.write(_degrees(described, labelled, sets, percent), "degree")
    linked = by_key(labelled, tables.write(lowest, "lowest"), ["root"], "k", total).join(degree, "id", "left").select("set_hash", "component", "met")
    n_links = F.col("copies") - 1 + F.coalesce("met", F.lit(0))
    named = plain.join(linked, "set_hash", "left").select("set_hash", F.coalesce("component", "low").alias("component"), n_links.alias("n_links"), "copies")
    # What has one row and no link needs no name.
    named = tables.write(named.where("copies > 1 or n_links > 0"), "named")
    tables.keep("rows", "named")
    out = by_key(rows.select("doc_id", "h", "n_shingles", "set_hash"), named, ["set_hash"], "copies", total, "left")
    return out.select("doc_id", "h", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _spread(rows: DataFrame) -> DataFrame:
    """Each row once for every part of its token's list."""
    return rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("in_parts") - 1))).drop("in_parts")


def _lists(nodes: DataFrame, tables: Tables, total: int) -> DataFrame:
    """token, id, n, pos, in_parts, root, part: the prefix n-grams that several nodes have, with these nodes. A long list is cut into
    parts, to each of which its hubs are sent."""
    posted = nodes.select("id", "n", F.posexplode("prefix").alias("pos", "token"))
    shared = tables.write(posted.groupBy("token").agg(F.count("*").alias("k")).where("k > 1"), "shared")
    lists = by_key(posted, shared, ["token"], "k", total).select("token", "id", "n", "pos", F.ceil(F.col("k") / LIST_ROWS).alias("in_parts"), F.col("id").alias("root"))
    return tables.write(lists.withColumn("part", F.pmod(F.xxhash64("id"), F.col("in_parts"))), "lists0")


def _links(docs: DataFrame, nodes: DataFrame, tables: Tables, n: int, percent: int, total: int) -> tuple[DataFrame, DataFrame]:
    """The components (node, root) of the nodes that link, and sets (id, s) with all of these nodes. A round reads the texts of nodes that it is
    the first to compare; rounds are few, as hubs grow sixteenfold."""
    lists = _lists(nodes, tables, total)
    links, done, labels, sets, hubs, i = None, None, None, None, 1, 0
    while not lists.isEmpty():
        # The first of some parts, so that no list is ordered in one task: hubs in all, or one a part where parts are more.
        ranked = lists.withColumn("rank", F.row_number().over(Window.partitionBy("token", "part").orderBy("pos", "id")))
        ranked = ranked.withColumn("is_hub", (F.col("part") < hubs) & (F.col("rank") <= F.ceil(F.lit(hubs) / F.col("in_parts")))).drop("rank")
        top = tables.write(ranked.where("is_hub"), f"top{i}")
        hub = _spread(top.select("token", "in_parts", *[F.col(c).alias(f"hub_{c}") for c in ("id", "n", "pos", "root")]))
        # A hub meets all that are no hubs, and of two hubs the later meets the earlier.
        met = ranked.join(hub, ["token", "part"]).where("root <> hub_root and (not is_hub or id > hub_id) and 100 * least(n, hub_n) >= {p} * greatest(n, hub_n) and (100 + {p}) * least(n - pos, hub_n - hub_pos) >= {p} * (n + hub_n)".format(p=percent))
        pairs = met.select(F.col("hub_id").alias("a"), F.col("id").alias("b"))
        if i == 0:  # first each node with the hub it meets most: most lists are then one component
            best = pairs.groupBy("a", "b").agg(F.count("*").alias("k")).groupBy("b").agg(F.max(F.struct("k", "a")).alias("x"))
            pairs = best.select(F.col("x.a").alias("a"), "b")
        # Each pair once, whichever of the two was the hub.
        pairs = pairs.groupBy(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(F.min("a").alias("a"))
        if done is not None:
            met_before = done.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
            pairs = pairs.join(met_before, ["low", "high"], "left_anti")
        half = nodes.select("id", "n", "parts")
        pairs = pairs.select("a", (F.col("low") + F.col("high") - F.col("a")).alias("b")).join(half.toDF("b", "nb", "pb"), "b")
        pairs = tables.write(pairs, f"met{i}")
        hubs_of = pairs.groupBy("a").agg(F.count("*").alias("k"), F.ceil(F.sum("nb") / GROUP_SHINGLES).alias("groups")).join(half.toDF("a", "na", "pa"), "a")
        # Suffix filter: how far the sizes of the parts differ is a lower bound for the symmetric difference.
        apart = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
        pairs = by_key(pairs, tables.write(hubs_of, f"hubs{i}"), ["a"], "k", total)
        pairs = pairs.where((100 + percent) * (F.col("na") + F.col("nb") - apart) >= 2 * percent * (F.col("na") + F.col("nb"))).select("a", "b", "groups")
        pairs = tables.write(pairs, f"pairs{i}")
        if not pairs.isEmpty():
            wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
            if sets is not None:
                wanted = wanted.join(sets.select("id"), "id", "left_anti")
            wanted = tables.write(wanted.join(nodes.select("id", "doc_id", "h"), "id"), f"wanted{i}")
            more = tables.write(_texts_as_sets(docs, wanted, n), f"sets{i}")
            sets = more if sets is None else sets.union(more)
            verified = tables.write(_verify(pairs, sets, percent), f"verified{i}")
            done = verified if done is None else done.union(verified)
            if not verified.where("linked").isEmpty():
                links = done.where("linked").select("a", "b")
                labels = components(links, tables, f"round{i}")
        if i > 0:  # these hubs have met all of their lists
            lists = lists.join(top.select("token", "id"), ["token", "id"], "left_anti")
            hubs *= HUB_GROWTH
        if labels is not None:
            lists = lists.drop("root").join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        # What is left of a list goes on unless it is one component.
        open_lists = lists.groupBy("token", "in_parts").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("token", "in_parts")
        left = lists.join(_spread(open_lists), ["token", "part"]).select("token", "id", "n", "pos", "in_parts", "root", "part")
        lists = tables.write(left, f"lists{i + 1}")
        for name in ("lists", "top", "met", "hubs", "pairs", "wanted"):
            tables.drop(f"{name}{i}")
        i += 1
    if links is None:
        none = nodes.select("id", F.col("id").alias("root"), F.lit(b"").alias("s")).limit(0)
        return none.select(F.col("id").alias("node"), "root"), none.select("id", "s")
    return labels, sets


def _degrees(nodes: DataFrame, labelled: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """id, met: how many rows have a set that links with the node's, its own apart. Each component is dealt to blocks, each block
    meets each, and every pair is verified once."""
    least = BLOCK_SHINGLES // BLOCK_NODES
    sized = labelled.join(nodes.select("id", "n"), "id").select("root", "id", "n", "copies")
    # At most one root for each block of n-grams has several.
    many = sized.groupBy("root").agg(F.ceil(F.sum(F.greatest("n", F.lit(least))) / BLOCK_SHINGLES).alias("blocks")).where("blocks > 1")
    dealt = sized.join(F.broadcast(many), "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).join(sets, "id")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    met = dealt.select("root", "id", "copies", "block", "s", other).select("root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "copies", "s")

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        low, high = key[1].as_py(), key[2].as_py()
        size = np.array([len(x.as_buffer()) // 8 for x in rows["s"]], np.int64)
        order = np.argsort(size, kind="stable")
        rows, size = rows.take(pa.array(order)), size[order]
        block, copies = rows["block"].to_numpy(), rows["copies"].to_numpy()
        # N-grams as small numbers, without those that only one of the sets holds.
        _, number, held = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in rows["s"]]), return_inverse=True, return_counts=True)
        shared = held[number] > 1
        owner = np.repeat(np.arange(len(size)), size)[shared]
        number, start = number[shared], np.searchsorted(owner, np.arange(len(size) + 1))
        right = np.flatnonzero(block == high)
        lengths, place = size[right], np.concatenate([[0], np.cumsum((start[1:] - start[:-1])[right])])
        flat = number[np.isin(owner, right)] if low != high else number
        degree, mark = np.zeros(len(size), np.int64), np.zeros(len(held), bool)
        for i in np.flatnonzero(block == low):
            # Similar sets have similar lengths.
            first = i + 1 if low == high else int(np.searchsorted(lengths, -(-percent * size[i] // 100)))
            last = int(np.searchsorted(lengths, 100 * size[i] // percent, "right")) if percent else len(lengths)
            if first >= last:
                continue
            own = number[start[i] : start[i + 1]]
            mark[own] = True
            sums = np.concatenate([[0], np.cumsum(mark[flat[place[first] : place[last]]], dtype=np.int64)])
            mark[own] = False
            at = place[first : last + 1] - place[first]
            both = sums[at[1:]] - sums[at[:-1]]
            linked = right[first:last][100 * both >= percent * (size[i] + lengths[first:last] - both)]
            degree[i] += copies[linked].sum()
            degree[linked] += copies[i]
        return pa.table({"id": rows["id"], "met": pa.array(degree, pa.int64())})

    return met.groupBy("root", "low", "high").applyInArrow(run, "id long, met long").groupBy("id").agg(F.sum("met").alias("met"))
