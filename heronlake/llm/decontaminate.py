"""Benchmark decontamination as a prefix-filtered set join, with DataFrame functions only.

An item's windows of so many words are sets of shingles: pairs of neighbouring words (a window of one word is that word).
A document holds a window only if it holds all its shingles, so one shingle is a sufficient prefix: the rarest, by counts
over all documents. Windows are joined on that shingle; a candidate's place follows from the shingle's place in the window
(the positional and length bound), and the shingles there are compared with the window's (the exact check).
The documents are cut into words once, which is most of the work; what remains of them are the occurrences of benchmark shingles, a
table of some percent of the texts' size from which rarity, candidates and checks all come.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, by_key, pick, without

#: Bytes above 0x7F belong to words; a byte alone of these is no valid text, so no word equals this one.
FENCE = "\u0080"
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
SHINGLES = "if(size(ws) = 1, array(struct(ws[0] as a, '' as b)), transform(sequence(0, size(ws) - 2), i -> struct(ws[i] as a, ws[i + 1] as b)))"
#: The occurrences of windows in one document. here: its shingles by place, with the windows that are asked for at each.
HITS = """flatten(transform(here, (x, i) -> if(x.asks is null, array(), transform(
    filter(x.asks, a -> i >= a.off
        and transform(slice(here, i - a.off + 1, size(a.ids)), y -> y.id) = a.ids
        and here[i - a.off].pos = x.pos - a.off
        and here[i - a.off + size(a.ids) - 1].pos = x.pos - a.off + size(a.ids) - 1),
    a -> struct(x.pos - a.off as start, a.len as len, a.window as window)))))"""
SINGLE_HITS = "flatten(transform(single, s -> transform(s.asks, a -> struct(s.pos as start, a.len as len, a.window as window))))"
COVERED = """aggregate(hits, struct(0 as n, 0 as upto), (s, x) -> struct(
    s.n + greatest(0, x.start + x.len - greatest(x.start, s.upto)) as n, greatest(s.upto, x.start + x.len) as upto), s -> s.n)"""
#: Different shingles up to which a benchmark is broadcast: two words and a number each, and for the windows asked for some ten numbers
#: each, 100 MB at most. A larger benchmark is joined by a shuffle.
BROADCAST_SHINGLES = 500_000


def words(text: Column) -> Column:
    """The words, between two fences. Bytes are taken as Latin-1 characters: lower() then lowers A-Z, and what it does to
    the first bytes of other characters keeps different characters different, as the bytes that follow tell their
    number; no other character is lowered into another."""
    plain = F.lower(F.decode(F.coalesce(text, F.lit("")).cast("binary"), "ISO-8859-1"))
    return F.split(F.concat(F.lit(FENCE + " "), plain, F.lit(" " + FENCE)), SEPARATORS)


def _item_windows(items: DataFrame, window: int) -> DataFrame:
    """ws array<string>, items array: each different window of words and the items that hold it."""
    cut = items.select("item_id", words(F.col("text")).alias("w")).select("item_id", F.expr("slice(w, 2, size(w) - 2)").alias("w")).where("size(w) > 0")
    each = cut.select("item_id", F.explode(F.expr(f"transform(sequence(0, greatest(0, size(w) - {window})), i -> slice(w, i + 1, {window}))")).alias("ws"))
    return each.groupBy("ws").agg(F.array_sort(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit("null")))).alias("items"))


def find(docs: DataFrame, items: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, hits array<struct<start, len, window>>, n_hit, items array<string>: one row for each document row.

    hits are the occurrences of windows, start in words from 0, in order; window numbers a different window of the benchmark. n_hit counts
    the words inside any, items are the ids of the items that hold one, in order. An item with
    fewer words than a window is one window; null and empty texts have no words, and such items no windows. Repeated rows
    are worked on once and returned as often as they occur; rows are told apart by doc_id and text. A null item_id
    reads null. Tables of intermediate results go to the shared folder."""
    found = _find(pick(docs, doc_id=doc_id, text=text), pick(items, item_id=item_id, text=item_text), window)
    return found.select("doc_id", "n_words", "hits", "n_hit", "items", F.explode(F.sequence(F.lit(1), "times"))).drop("col")


def clean(docs: DataFrame, items: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that hold no window of any item."""
    found = _find(pick(docs, doc_id=doc_id, text=text), pick(items, item_id=item_id, text=item_text), window)
    dropped = Tables(docs.sparkSession, "contaminated").write(found.where("n_hit > 0").select("doc_id", "h"), "dropped")
    return without(docs, dropped, doc_id, text)


def _find(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """What find() returns, one row for each different (doc_id, h), with times, the number of its rows."""
    tables = Tables(docs.sparkSession, "decontaminate")
    windows = tables.write(_item_windows(items, window), "windows")
    shingles = windows.select(F.explode(F.expr(SHINGLES)).alias("s")).select("s.*").distinct()
    shingles = tables.write(shingles.select("a", "b", F.monotonically_increasing_id().alias("id")), "shingles")
    n_known, n_single = shingles.agg(F.count("*"), F.count_if(F.col("b") == "")).first()
    few = n_known <= BROADCAST_SHINGLES
    # The key of a document's mark is joined where a broadcast finds it; a shuffle would bring all marks to one task.
    known = F.broadcast(shingles.union(docs.sparkSession.range(1).selectExpr("'' as a", "'' as b", "-1L as id"))) if few else shingles

    # One pass over the texts. The pair that ends with the last fence has no second word and stands for the document.
    cut = docs.select("doc_id", F.xxhash64("text").alias("h"), words(F.col("text")).alias("w"))
    pairs = cut.select("doc_id", "h", F.posexplode(F.expr("arrays_zip(w, slice(w, 2, size(w)))")).alias("pos", "p"))
    pairs = pairs.select("doc_id", "h", "pos", F.expr("if(p.`1` is null, '', p.w)").alias("a"), F.expr("coalesce(p.`1`, '')").alias("b"))
    found = pairs.join(known, ["a", "b"]).select("doc_id", "h", F.expr("pos - 1").alias("pos"), "id", F.lit(False).alias("alone"))
    if not few:
        found = found.union(cut.select("doc_id", "h", F.expr("size(w) - 2"), F.lit(-1).cast("long"), F.lit(False)))
    if n_single:
        alone = shingles.where("b = ''").select("a", "id")
        if few:
            alone = F.broadcast(alone)
        one = cut.select("doc_id", "h", F.posexplode("w").alias("pos", "a")).join(alone, "a")
        found = found.union(one.select("doc_id", "h", F.expr("pos - 1"), "id", F.lit(True)))
    found = tables.write(found, "found")

    # Rarity: occurrences in all documents. A window is asked for at its rarest shingle only.
    rarity = tables.write(found.where("id >= 0").groupBy("id").agg(F.count("*").alias("n")), "rarity")
    placed = tables.write(windows.withColumn("window", F.monotonically_increasing_id()), "placed")
    parts = placed.select("window", F.posexplode(F.expr(SHINGLES)).alias("off", "s")).select("window", "off", "s.*")
    ids = tables.write(parts.join(shingles, ["a", "b"]).join(rarity, "id", "left").select("window", "off", "id", F.coalesce("n", F.lit(0)).alias("n")), "ids")
    rarest = ids.groupBy("window").agg(F.min(F.struct("n", "id", "off")).alias("rare")).where("rare.n > 0").select("window", "rare.*")
    whole = ids.groupBy("window").agg(F.transform(F.array_sort(F.collect_list(F.struct("off", "id"))), lambda x: x["id"]).alias("ids"))  # a window's own few
    asked = rarest.join(whole, "window").join(placed.select("window", F.size("ws").alias("len")), "window")
    asked = asked.groupBy("id").agg(F.max("n").alias("n"), F.collect_list(F.struct("off", "ids", "len", "window")).alias("asks"))
    asked = tables.write(asked, "asked")

    # Per document: its shingles in order; a candidate's shingles are the slice around the rarest. A shingle that many documents hold
    # is broadcast, as all are where they are few, so no task gets all its occurrences; documents' marks meet no shingle.
    if few:
        met = found.join(F.broadcast(asked.drop("n")), "id", "left")
    else:
        marks = found.where("id < 0").withColumn("asks", F.lit(None).cast(asked.schema["asks"].dataType))
        met = by_key(found.where("id >= 0"), asked, ["id"], "n", found.count(), "left").drop("n").unionByName(marks)
    per = met.groupBy("doc_id", "h").agg(
        F.max(F.expr("if(id < 0, pos, 0)")).cast("long").alias("n_words"),
        F.count_if(F.col("id") < 0).cast("int").alias("times"),
        F.array_sort(F.collect_set(F.expr("if(id >= 0 and not alone, struct(pos, id, asks), null)"))).alias("here"),
        F.collect_set(F.expr("if(alone, struct(pos, asks), null)")).alias("single"),
    )
    hits = F.array_sort(F.concat(F.expr(HITS), F.expr(SINGLE_HITS))) if n_single else F.array_sort(F.expr(HITS))
    per = per.select("doc_id", "h", "n_words", "times", hits.alias("hits")).select("*", F.expr(COVERED).cast("long").alias("n_hit"))
    per = tables.write(per, "per")
    tables.keep("per", "placed")

    # Windows give way to the items that hold them at the end, once for each document.
    held = per.where("n_hit > 0").select("doc_id", "h", F.explode(F.array_distinct("hits.window")).alias("window"))
    items_of = placed.select("window", "items")
    if few:
        held = held.join(F.broadcast(items_of), "window")
    else:
        held = tables.write(held, "held")
        often = tables.write(held.groupBy("window").agg(F.count("*").alias("k")).join(items_of, "window"), "often")
        held = by_key(held, often, ["window"], "k", held.count())
    held = held.groupBy("doc_id", "h").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    both = per.withColumnRenamed("doc_id", "_id").withColumnRenamed("h", "_h").join(held, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_h") == F.col("h")), "left")
    return both.select(F.col("_id").alias("doc_id"), F.col("_h").alias("h"), "n_words", "times", "hits", "n_hit", F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))
