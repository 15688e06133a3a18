"""Personal data: four kinds found by their form, and identifiers of these kinds in other forms found by context.

The finds by form are seeds. Each seed, and each other token that could be an identifier, is an instance that stands in
lexical patterns: the word before it, the two words before it, and the words on both sides. Patterns and instances
make a graph that Spark scores in rounds: a pattern's score for a kind is the mean score of its different instances,
an instance's score is that of its best pattern with enough seeds. Instances of high score are seeds of the next round, so patterns
that stand only around what was discovered count, too. What fits a kind loosely, a token or numbers with spaces between them, and
stands in a pattern of high score for that kind is added; the finds by form always stay.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, by_batch, by_key, pick

#: Fixed: the kinds in the order of results.
KINDS = ("email", "ip", "card", "phone")
ROUNDS, MIN_SEEDS, MIN_SCORE, MIN_START = 3, 5, 0.8, 0.5
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT, CLUE, SPACE = re.compile(r"[0-9]"), re.compile(r"[0-9@]"), re.compile(r"\s")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match begins and ends with a whole run of digits
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORD = re.compile(r"[^\W\d_]+")
#: Numbers of two to six digits in two to five groups with spaces between, which are no one token.
SPACED = re.compile(r"(?<![0-9A-Za-z+(.-])\(?[0-9]{2,6}\)?(?:[ .-][0-9]{2,6}){1,4}(?![0-9A-Za-z.-][0-9A-Za-z])")
EDGES = "\"'`.,;:!?()[]{}<>|"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start: leftmost matches that don't overlap within a kind; matches that
    fail their kind's test are dropped and what they cover is not tried again."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(done, at + 1))
    if DIGIT.search(text):
        out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def fits(value: str) -> int:
    """The kind that a value fits loosely, or -1: an address without a full domain, an IP address of version 6, a number
    of 12 to 15 digits with a card's check digit, a number of 9 to 11 digits in groups."""
    digits = "".join(c for c in value if "0" <= c <= "9")
    if value.count("@") == 1 and len(value) >= 5 and value[0] != "@" and value[-1] != "@" and all(c in LOCAL or c == "@" for c in value):
        return 0
    if value.count(":") >= 3 and re.fullmatch(r"[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){3,7}", value) and digits:
        return 1
    if 12 <= len(digits) <= 15 and len(digits) == len(value.replace("-", "").replace(" ", "")) and luhn(digits):
        return 2
    if 9 <= len(digits) <= 11 and re.fullmatch(r"\(?[0-9]{2,5}\)?(?:[ .-][0-9]{2,6}){1,4}", value):
        return 3
    return -1


def patterns(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around a span, from 60 characters on each side; lower case, words only."""
    before = [w.lower() for w in WORD.findall(text[max(0, start - 60) : start])][-2:]
    after = [w.lower() for w in WORD.findall(text[end : end + 60])][:1]
    out = []
    if before:
        out.append(f"{before[-1]} _")
        if len(before) > 1:
            out.append(f"{before[0]} {before[1]} _")
        if after:
            out.append(f"{before[-1]} _ {after[0]}")
    return out


def instances(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """The seeds, and what could be an identifier and overlaps no seed: tokens of any length, and numbers with spaces."""
    out = [{"kind": k, "seed": True, "start": a, "end": b, "value": text[a:b].lower(), "patterns": patterns(text, a, b)} for k, a, b in base]
    loose: list[tuple[int, int, int]] = []
    m, outer = CLUE.search(text), EDGES.replace("(", "")
    while m:
        start = m.start()
        while start and not text[start - 1].isspace():
            start -= 1
        stop = SPACE.search(text, m.end())
        end = stop.start() if stop else len(text)
        token = text[start:end]
        lead = len(token) - len(token.lstrip(outer))
        value = token.strip(outer)
        kind = fits(value)
        if kind >= 0:
            loose.append((start + lead, start + lead + len(value), kind))
        m = CLUE.search(text, end)
    loose += [(*x.span(), kind) for x in SPACED.finditer(text) if " " in x[0] and (kind := fits(x[0])) >= 0]
    taken, reach, i = sorted((a, b) for _, a, b in base), 0, 0
    for a, b, kind in sorted(loose, key=lambda x: (x[0], -x[1])):
        while i < len(taken) and taken[i][0] < b:  # the ends of all seeds that begin before this one's end
            reach = max(reach, taken[i][1])
            i += 1
        if reach <= a:
            reach = b
            out.append({"kind": kind, "seed": False, "start": a, "end": b, "value": text[a:b].lower(), "patterns": patterns(text, a, b)})
    return out


SPANS = "array<struct<kind:int,start:int,end:int>>"
INSTANCES = "array<struct<kind:int,seed:boolean,start:int,end:int,value:string,patterns:array<string>>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
INSTANCE_TYPE = pa.list_(pa.struct([("kind", pa.int32()), ("seed", pa.bool_()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))]))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base and instances of each row of (doc_id, text)."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = [x or "" for x in batch.column(1).to_pylist()]
        found = [base_spans(x) for x in texts]
        spans = [[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in found]
        return [batch.column(0), pa.array(spans, SPAN_TYPE), pa.array([instances(t, x) for t, x in zip(texts, found, strict=True)], INSTANCE_TYPE)]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_batch(docs, f"doc_id {kind}, base {SPANS}, instances {INSTANCES}", run)


#: Rows of (pattern, kind) up to which they are broadcast, some 50 bytes each.
BROADCAST_PATTERNS = 500_000


def _with_patterns(rows: DataFrame, scored: DataFrame, tables: Tables, name: str) -> DataFrame:
    """rows joined with the patterns (pattern, kind, ...) that were kept: broadcast where they are few; else those are that many rows have."""
    if scored.limit(BROADCAST_PATTERNS + 1).count() <= BROADCAST_PATTERNS:
        return rows.join(F.broadcast(scored), ["pattern", "kind"])
    rows = tables.write(rows, f"{name}-rows")
    often = rows.groupBy("pattern", "kind").agg(F.count("*").alias("k"))
    scored = tables.write(scored.join(often, ["pattern", "kind"]), f"{name}-patterns")
    return by_key(rows, scored, ["pattern", "kind"], "k", rows.count()).drop("k")


def score_graph(edges: DataFrame, tables: Tables, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_start: float = MIN_START, min_score: float = MIN_SCORE) -> DataFrame:
    """pattern, kind, score, seeds for (pattern, value, kind, seed), which are different rows.

    Each round groups the edges by pattern and by instance; both are sums or maxima, combined before the shuffle, and joins back to
    the edges send hot patterns and values to all tasks instead of their edges to one. From the second round on, instances of
    min_score or more count as seeds."""
    of_pattern = tables.write(edges.groupBy("pattern").agg(F.count("*").alias("n")), "of_pattern")
    edges = tables.write(edges.withColumn("score", F.col("seed").cast("double")), "edges0")
    total = edges.count()
    for i in range(rounds):
        scored = edges.groupBy("pattern", "kind").agg(F.sum("score").alias("sum"), F.count_if(F.col("score") >= min_score).alias("seeds"))
        scored = scored.join(of_pattern, "pattern").select("pattern", "kind", "seeds", (F.col("sum") / F.col("n")).alias("p"))
        scored = tables.write(scored.where((F.col("seeds") >= min_seeds) & (F.col("p") >= min_start)), f"patterns{i}")
        if i < rounds - 1:
            met = _with_patterns(edges.where("not seed").select("pattern", "value", "kind"), scored, tables, f"met{i}")
            best = met.groupBy("value", "kind").agg(F.max("p").alias("best"))
            often = edges.where("not seed").groupBy("value", "kind").agg(F.count("*").alias("k"))
            best = tables.write(best.join(often, ["value", "kind"]), f"best{i}")
            loose = by_key(edges.where("not seed").drop("score"), best, ["value", "kind"], "k", total, "left")
            loose = loose.select("pattern", "value", "kind", "seed", F.coalesce("best", F.lit(0.0)).alias("score"))
            edges = tables.write(edges.where("seed").unionByName(loose), f"edges{i + 1}")
            tables.drop(f"edges{i}")
    return scored.select("pattern", "kind", F.col("p").alias("score"), "seeds")


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_score: float = MIN_SCORE, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """doc_id, base and added (arrays of struct<kind, start, end> by kind, start; code points, end exclusive); one row for each.

    Null and empty texts have no spans. Repeated rows count once as evidence, since edges are made different first, and
    are each answered. The texts are read once; spans and instances go to the shared folder."""
    tables = Tables(docs.sparkSession, "pii")
    found = scan(pick(docs, doc_id=doc_id, text=text)).withColumn("row", F.monotonically_increasing_id())
    found = tables.write(found, "found")
    single = found.select("row", F.explode("instances").alias("x")).select("row", "x.*")
    edges = single.select(F.explode("patterns").alias("pattern"), "value", "kind", "seed").distinct()
    accepted = score_graph(edges, tables, min_seeds=min_seeds, min_score=min_score).where(F.col("score") >= min_score).select("pattern", "kind")
    loose = single.where("not seed").select("row", "kind", "start", "end", F.explode("patterns").alias("pattern"))
    added = _with_patterns(loose, tables.write(accepted, "accepted"), tables, "added").groupBy("row").agg(F.array_sort(F.collect_set(F.struct("kind", "start", "end"))).alias("added"))
    added = tables.write(added, "added")
    tables.keep("found", "added")
    return found.select("row", "doc_id", "base").join(added, "row", "left").select("doc_id", "base", F.coalesce("added", F.expr(f"cast(array() as {SPANS})")).alias("added"))
