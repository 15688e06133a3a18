"""Byte-level BPE by prefix dynamic programming.

For a byte string and a rank table there is, for every prefix, exactly one token that can come last in the
prefix's encoding. Storing that token for each prefix gives the encoding of every prefix at once: appending
bytes only adds entries, and an edit needs new entries from the pre-token it touches on.

A token t may end prefix i when prefix i - len(t) is empty or its own last token p keeps to itself beside t,
that is, encoding p + t gives [p, t]. The candidates t come from an Aho-Corasick automaton over the vocabulary.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from .common import Bounded, by_batch, hold, pick

#: Pre-tokens, space-led groups of pre-tokens, and pairs of tokens that a worker remembers; of the first two, twice as many at most,
#: and only what is asked for again: a worker shares its executor's memory with a JVM that earlier operators have left large.
REMEMBERED, REMEMBERED_GROUPS, REMEMBERED_PAIRS = 40_000, 80_000, 300_000
#: Marks, a byte each, of pre-tokens and groups that were asked for once.
MARKS, MARKS_GROUPS = 500_000, 1_000_000


def read_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}


class Vocabulary:
    """Ranks, the merge that makes each token, and which tokens stay apart side by side."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.halves: dict[int, tuple[int, int] | None] = {}
        #: For each token, whether it stays apart behind another. The automaton hands it out with the token's length and rank.
        self.known: dict[int, dict[int, bool]] = {}
        self.pairs = 0
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.halves[rank] = None
            else:
                parts = self._merged([token[i : i + 1] for i in range(len(token))], rank)
                if len(parts) != 2:
                    continue  # no merges lead to it: it only stands where it is a whole pre-token
                self.halves[rank] = (ranks[parts[0]], ranks[parts[1]])
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank, self.known.setdefault(rank, {})))
        self.automaton.make_automaton()
        self.longest = max(map(len, ranks), default=0)

    def _merged(self, parts: list[bytes], below: int) -> list[bytes]:
        """Merges of lower rank than below, lowest first, the leftmost of equals."""
        none = 1 << 60
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], none), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def apart(self, a: int, b: int) -> bool:
        """Whether encoding bytes(a) + bytes(b) gives [a, b]. The merges of both are undone, the latest
        first; at each state on the way, a merge across the seam must not have come before the one undone."""
        left, right, latest, good = a, b, 1 << 60, True
        while True:
            across = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if across is not None and across < latest:
                good = False
                break
            lh, rh = self.halves[left], self.halves[right]
            if lh is None and rh is None:
                break
            if rh is None or lh is not None and left > right:
                latest, left = left, lh[1]
            else:  # of equal ranks the left one was merged first; and one across comes before its right neighbour
                latest, right = right + 1, rh[0]
        if self.pairs > REMEMBERED_PAIRS:
            for behind in self.known.values():
                behind.clear()
            self.pairs = 0
        self.known[b][a] = good
        self.pairs += 1
        return good


def fill(vocabulary: Vocabulary, text: str, last: list[int], base: int = 0) -> None:
    """Sets last[e], the last token of prefix e, for all e that are -1 yet. text: the bytes from base on, as latin-1."""
    apart, base = vocabulary.apart, base + 1
    for end, (n, rank, known) in vocabulary.automaton.iter(text):  # of one end, the longest first
        end += base
        if last[end] < 0:
            before = last[end - n]
            if before < 0:  # the token is the whole prefix
                last[end] = rank
                continue
            good = known.get(before)
            if apart(before, rank) if good is None else good:
                last[end] = rank


class Prefixes:
    """The last token of every prefix of a byte string that grows at its end."""

    def __init__(self, vocabulary: Vocabulary, start: bytes = b"") -> None:
        self.vocabulary, self.content, self.last = vocabulary, b"", [-1]
        self.append(start)

    def append(self, more: bytes) -> None:
        reach = max(0, len(self.content) - self.vocabulary.longest)
        self.content += more
        self.last.extend([-1] * len(more))
        fill(self.vocabulary, self.content[reach:].decode("latin-1"), self.last, reach)

    def tokens(self, end: int | None = None) -> list[int]:
        """The encoding of the first end bytes."""
        end, out = len(self.content) if end is None else end, []
        while end:
            out.append(self.last[end])
            end -= len(self.vocabulary.bytes_of[self.last[end]])
        return out[::-1]


class Codec:
    """Whole texts: the pattern cuts a text into pre-tokens, each of which is encoded by itself."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.vocabulary, self.pattern = Vocabulary(ranks), regex.compile(pattern)
        self.pack = Bounded(self._piece, REMEMBERED, MARKS)
        # No pre-token holds a space but at its start or in a run of white space, so one between two other
        # characters starts a pre-token, whatever stands further off. This holds for the public patterns;
        # for others, whole texts are cut.
        self.cuts = pattern.count(" ") == pattern.count(" ?") and pattern.endswith(r"|\s+(?!\S)|\s+")
        self.groups = Bounded(self._group, REMEMBERED_GROUPS, MARKS_GROUPS)
        self.packed = {i: (struct.pack("<I", i), len(t)) for t, i in ranks.items()}

    def _piece(self, text: str) -> bytes:
        content, packed = text.encode("utf-8", "surrogatepass"), self.packed
        whole = self.vocabulary.ranks.get(content)
        if whole is not None:
            return packed[whole][0]
        end, out = len(content), []
        fill(self.vocabulary, text if text.isascii() else content.decode("latin-1"), last := [-1] * (end + 1))
        while end:
            code, n = packed[last[end]]
            out.append(code)
            end -= n
        return b"".join(out[::-1])

    def _group(self, text: str) -> bytes:
        """A group that is one pre-token is remembered as a group only."""
        found = self.pattern.findall(text)
        if len(found) > 1:
            return b"".join(map(self.pack.__getitem__, found))
        pack = self.pack
        return pack.get(text) or pack.older.get(text) or self._piece(text) if found else b""

    def encode_packed(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        if not self.cuts:
            return b"".join(map(self.pack.__getitem__, self.pattern.findall(text)))
        if ODD_SPACE.search(text):
            first, *rest = LONE_SPACE.split(text)
        else:
            first, *rest = text.split(" ")
        return self.groups[first] + b"".join([self.groups[" " + x] for x in rest])

    def encode(self, text: str) -> list[int]:
        packed = self.encode_packed(text)
        return list(struct.unpack(f"<{len(packed) // 4}I", packed))

    def decode_packed(self, packed: bytes) -> bytes:
        return join_tokens(packed, self.vocabulary.bytes_of)


def join_tokens(packed: bytes, of: dict[int, bytes]) -> bytes:
    return b"".join([of[i] for i in memoryview(packed).cast("I")])


ODD_SPACE = regex.compile(r" \s|\s |^ | $")
LONE_SPACE = regex.compile(r"(?<=\S) (?=\S)")


class EditableText:
    """A text with its encoding, for appends and edits: only pre-tokens near the edit are cut and encoded anew."""

    def __init__(self, codec: Codec, text: str = "") -> None:
        self.codec, self.text = codec, text
        self.spans = [m.span() for m in codec.pattern.finditer(text)]
        self.ids = [codec.pack[text[a:b]] for a, b in self.spans]
        self.encoded_anew = len(self.spans)

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces text[start:end] with new."""
        spans, shift = self.spans, len(new) - (end - start)
        first = sum(1 for _ in self._before(start))
        # A match looks at most to the end of the run of white space or other characters behind it: stepping
        # back over two pre-tokens that are not white space leaves all that the edit can reach.
        solid = 0
        while first and solid < 3:
            first -= 1
            solid += not self.text[slice(*spans[first])].isspace()
        text = self.text[:start] + new + self.text[end:]
        at = spans[first][0] if first < len(spans) else 0
        old = {a + shift: i for i, (a, _) in enumerate(spans) if a >= end and i >= first}
        made, ids, rest = [], [], len(spans)
        for m in self.codec.pattern.finditer(text, at):
            if m.start() in old and m.start() >= start + len(new):
                rest = old[m.start()]
                break
            made.append(m.span())
            ids.append(self.codec.pack[m[0]])
        self.encoded_anew = len(made)
        self.spans = spans[:first] + made + [(a + shift, b + shift) for a, b in spans[rest:]]
        self.ids, self.text = self.ids[:first] + ids + self.ids[rest:], text

    def _before(self, start: int) -> Iterator[tuple[int, int]]:
        for span in self.spans:
            if span[1] > start:
                return
            yield span

    def tokens(self) -> list[int]:
        packed = b"".join(self.ids)
        return list(struct.unpack(f"<{len(packed) // 4}I", packed))


def _ranks(path: str) -> dict[bytes, int]:
    """path: a file on every machine, or one that addFile() has sent."""
    try:
        content = open(path, "rb").read()
    except FileNotFoundError:
        content = open(SparkFiles.get(path.rpartition("/")[2]), "rb").read()
    return read_ranks(content)


@lru_cache(1)
def codec(path: str, pattern: str) -> Codec:
    """The codec of a worker, made once."""
    return Codec(_ranks(path), pattern)


hold(__name__, codec.cache_clear)


@lru_cache(1)
def token_bytes(path: str) -> dict[int, bytes]:
    """What a worker needs for decoding."""
    return {i: t for t, i in _ranks(path).items()}


def encode(docs: DataFrame, vocabulary: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids: the whole text's token ids as little-endian unsigned 32-bit integers, one row for each row.

    vocabulary is the path of a ranks file, pattern cuts pre-tokens. Null and empty texts have no tokens; very long
    texts and very long pre-tokens take time in proportion to their length. No shuffle, one pass; a worker's
    memory is one slice of rows and caches of bounded size."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        c = codec(vocabulary, pattern)
        return [batch.column(0), pa.array([c.encode_packed(x or "") for x in batch.column(1).to_pylist()], pa.binary())]

    docs = pick(docs, doc_id=doc_id, text=text)
    return by_batch(docs, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary", run)


def decode(encoded: DataFrame, vocabulary: str, keep: tuple[str, ...] = ("doc_id", "ids")) -> DataFrame:
    """The columns to keep and decoded: the bytes that ids stand for; null ids give no bytes. An id outside the
    vocabulary is an error."""
    source = pick(encoded, **{k: k for k in dict.fromkeys((*keep, "ids"))})
    names = source.columns

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        of, ids = token_bytes(vocabulary), batch.column(names.index("ids")).to_pylist()
        return [*[batch.column(names.index(k)) for k in keep], pa.array([join_tokens(x or b"", of) for x in ids], pa.binary())]

    types = ", ".join(f"{k} {source.schema[k].dataType.simpleString()}" for k in keep)
    return by_batch(source, f"{types}, decoded binary", run)


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids, decoded: encode() and decode() in one worker, for checking a corpus without handing the ids over twice."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        c = codec(vocabulary, pattern)
        ids = [c.encode_packed(x or "") for x in batch.column(1).to_pylist()]
        return [batch.column(0), pa.array(ids, pa.binary()), pa.array([c.decode_packed(x) for x in ids], pa.binary())]

    docs = pick(docs, doc_id=doc_id, text=text)
    return by_batch(docs, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary, decoded binary", run)
