"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists the vocabulary's matches; for every position only the best score and the
piece count of the best path are kept. The tie rules are those of the public unigram tokenizer: a path replaces
another only if its score is strictly higher, and paths are met in the order of their last piece's start. A character
that no single piece covers costs the lowest score less 10 and, with byte fallback, counts one piece a byte. A
user-defined piece of n bytes scores n times the highest score less 0.1.

The tokenizer keeps sums as 32-bit floats. Whole-number scores add up without loss, whatever the order: there, if pieces hold the space mark
only at their start, a text falls into segments that no piece crosses, whose best paths are independent and remembered in a cache
of bounded size. Other scores are added as the tokenizer adds them, through the whole text.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from .common import Bounded, by_batch, hold, pick

MARK = "▁"
UNKNOWN_PENALTY = 10.0  # fixed by the tokenizer
REMEMBERED = 300_000
BARRED = -1e8
NEVER = float("-inf")
NORMAL, USER_DEFINED = 1, 4  # fixed types of the model file
#: Whole-number scores up to this size, over the texts that one row can hold, keep sums exact in doubles.
WHOLE = 1 << 20
_FLOAT = struct.Struct("f")


def single(x: float) -> float:
    """x as a 32-bit float keeps it."""
    return _FLOAT.unpack(_FLOAT.pack(x))[0]


class Unigram:
    """pieces: (piece, score), those of normal type; user: user-defined pieces. fallback: unknown characters fall into bytes."""

    def __init__(self, pieces: list[tuple[str, float]], fallback: bool = True, dummy_prefix: bool = True, user: tuple[str, ...] = ()) -> None:
        self.fallback, self.dummy_prefix = fallback, dummy_prefix
        self.automaton, self.singles = ahocorasick.Automaton(), set()
        scores = [single(s) for _, s in pieces]
        low, high = min(scores, default=0.0), max(scores, default=0.0)
        every = [(p, s) for (p, _), s in zip(pieces, scores, strict=True)] + [(p, len(p.encode()) * high - 0.1) for p in user]
        for piece, score in every:
            self.automaton.add_word(piece, (len(piece), score))
            if len(piece) == 1:
                self.singles.add(piece)
        self.automaton.make_automaton()
        self.unknown = single(low - UNKNOWN_PENALTY)
        self.whole = not user and all(s == int(s) and abs(s) <= WHOLE for s in scores)
        self.segments = self.whole and not any(MARK in p.lstrip(MARK) for p, _ in every)
        self.memory = Bounded(self.path, REMEMBERED)

    def path(self, text: str) -> tuple[int, float]:
        """Pieces and score of the best path."""
        keep = float if self.whole else single
        n = len(text)
        score, count = [NEVER] * (n + 1), [0] * (n + 1)
        score[0] = 0.0
        bare = [] if self.singles.issuperset(text) else [i for i, c in enumerate(text) if c not in self.singles][::-1]

        def solitary(upto: int) -> None:
            """Characters before upto that have no piece of their own."""
            while bare and bare[-1] < upto:
                i = bare.pop()
                x = keep(self.unknown + score[i])
                if x > score[i + 1]:
                    score[i + 1] = x
                    count[i + 1] = count[i] + (len(text[i].encode("utf-8", "surrogatepass")) if self.fallback else 1)

        for end, (length, value) in self.automaton.iter(text):  # of one end, the longest first
            if bare and bare[-1] < end:
                solitary(end)
            end += 1
            before = end - length
            x = value + score[before]
            if x > score[end]:
                score[end], count[end] = x if self.whole else keep(x), count[before] + 1
        solitary(n)
        return count[n], score[n]

    def count(self, text: str) -> tuple[int, float]:
        """Pieces and score of the whole text."""
        if not text:
            return 0, 0.0
        if self.dummy_prefix:
            text = " " + text
        text = text.replace(" ", MARK)
        if not self.segments:
            return self.path(text)
        if DOUBLE not in text and text[0] == MARK:
            found = [self.memory[MARK + x] for x in text[1:].split(MARK)]
        else:
            found = [self.memory[x] for x in SEGMENT.findall(text)]
        return sum([x[0] for x in found]), sum([x[1] for x in found])


DOUBLE = MARK * 2
SEGMENT = regex.compile(rf"{MARK}*[^{MARK}]+|{MARK}+")


def rescored(model):
    """The model with an ordinary score for pieces that a merge-based vocabulary bars with a huge penalty:
    one below the lowest of the others. As unigram scores, such penalties leave no precision for the rest."""
    lowest = min((p.score for p in model.pieces if p.type == 1 and p.score > BARRED), default=0.0)
    for p in model.pieces:
        if p.type == 1 and p.score <= BARRED:
            p.score = lowest - 1
    return model


def read_model(content: bytes) -> Unigram:
    """The normal pieces and scores of a public model file, taken as a unigram vocabulary."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(content)
    spec = model.normalizer_spec
    if spec.remove_extra_whitespaces or len(spec.precompiled_charsmap) or not spec.escape_whitespaces:
        raise ValueError("only vocabularies without text normalization can be counted")
    pieces = [(p.piece, p.score) for p in rescored(model).pieces if p.type == NORMAL]
    user = tuple(p.piece for p in model.pieces if p.type == USER_DEFINED)
    return Unigram(pieces, model.trainer_spec.byte_fallback, spec.add_dummy_prefix, user)


@lru_cache(2)
def model(path: str) -> Unigram:
    try:
        content = open(path, "rb").read()
    except FileNotFoundError:
        content = open(SparkFiles.get(path.rpartition("/")[2]), "rb").read()
    return read_model(content)


hold(__name__, model.cache_clear)


def count_tokens(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, score: pieces and score of the best path through the whole text, one row for each row.

    Null and empty texts have no pieces and score 0; repeated rows are each answered, and an empty table gives none. One pass without
    a shuffle; time grows with the text's length."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        found = [model(vocabulary).count(x or "") for x in batch.column(1).to_pylist()]
        return [batch.column(0), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.float64())]

    docs = pick(docs, doc_id=doc_id, text=text)
    return by_batch(docs, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, score double", run)
