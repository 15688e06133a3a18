"""Secret scans: rules find candidates, a random forest trained from labelled findings removes false positives.

Features of a candidate: its length, how its characters follow each other (transitions between classes, and their
likelihood under a table learned from the labelled findings), how much of it dictionary words cover, and hashed words of
the path and of its neighbourhood. The dictionary is that of a public vocabulary for the corpus's languages, with words of placeholders.
"""

from __future__ import annotations

import base64
import math
import random
import re
import sys
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_batch, only, pick, slices, small_batches

#: Findings that a model is trained on at most, the first by a hash of the finding.
MAX_FINDINGS = 20_000
TREES, DEPTH, LEAF, BINS = 40, 10, 3, 24
THRESHOLD = 0.5
MASK = "[SECRET]"
#: Characters of context on either side, and hashed word features for path and neighbourhood.
CONTEXT, PATH_SLOTS, WORD_SLOTS = 40, 8, 24
#: Characters of a candidate that its features read: all of them.
READ = sys.maxsize
#: A candidate this far inside another is judged on its own where the other is no secret.
APART = 200
#: The forms that candidates have, by name; the group is the secret. A token of 16 characters with a digit is the widest; one with
#: dots is a JWT. Runs have no upper bound, and are possessive so that a scan stays linear.
RULES = (
    ("assignment", re.compile(r"""(?i)\b(?:pass(?:word|wd)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential)s?["']?\s{0,3}(?:=|:=|:)\s{0,3}["']?([^\s"']{6,}+)""")),
    ("cloud key", re.compile(r"(?<![A-Za-z0-9])((?:AKIA|ASIA)[A-Z0-9]{16})(?![A-Za-z0-9])")),
    ("private key", re.compile(r"(-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----\s*+(?:[A-Za-z][A-Za-z0-9-]*+:[^\n]*+\n(?:[ \t]++[^\s-][^\n]*+\n)*+)*+[A-Za-z0-9+/=\s]*+-----END [A-Z ]{0,30}PRIVATE KEY-----)")),
    ("token", re.compile(r"(?<![A-Za-z0-9+/_=.@-])(eyJ[A-Za-z0-9_=-]{8,}+(?:\.[A-Za-z0-9_=-]*+)+(?<!\.)|[A-Za-z0-9+/_=-]{16,}+)(?![A-Za-z0-9+/_=@-])")),
)
#: What any rule's match holds; texts without it are passed over.
CLUE = re.compile(r"(?i)[0-9]|pass|pwd|secret|token|key|auth|credential|akia|asia")
WORD = re.compile(r"[A-Za-z]{2,}")
#: Words of placeholders and of code, which no vocabulary of prose is sure to hold.
WORDS = frozenset(
    """example sample test dummy change placeholder default user admin root value string null none true false object function class return
    import config setting database server client local host port file path version release build branch commit license document section
    chapter figure table image content message error warning debug info data list array password secret token your here insert enter
    type demo fake hello world replace xxxx""".split()
)
#: Letters of the shortest word that counts as covered.
SHORTEST = 4


def dictionary(path: str) -> frozenset[str]:
    """The words of a public vocabulary for many languages (a file of byte tokens in base64 with ranks): tokens that a space
    begins and that are otherwise letters of one case."""
    tokens = [base64.b64decode(line.split()[0]) for line in open(path, "rb") if line.strip()]
    words = (t[1:].decode("utf-8", "replace") for t in tokens if t[:1] == b" ")
    return frozenset(w for w in words if len(w) >= SHORTEST and w.isalpha() and w.islower())


def char_class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, rule), in order; of overlapping ones the first stays, or that of the rule listed first. Those that begin APART
    characters or more inside another stay too, for settle()."""
    out: list[tuple[int, int, str]] = []
    if not CLUE.search(text):
        return out
    for name, rule in RULES:
        for m in rule.finditer(text):
            a, b = m.span(1)
            if name != "token" or any("0" <= c <= "9" for c in m[1]):
                out.append((a, b, name))
    return sorted(_apart(out), key=lambda x: (x[0], -x[1]))


def _apart(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    if len(found) < 2:
        return found
    order = {name: i for i, (name, _) in enumerate(RULES)}
    kept: list[tuple[int, int, str]] = []
    inside: list[tuple[int, int, str]] = []
    for x in sorted(found, key=lambda x: (x[0], order[x[2]], -x[1])):
        if kept and x[0] < kept[-1][1]:
            if x[0] - kept[-1][0] >= APART:
                inside.append(x)
            elif order[x[2]] < order[kept[-1][2]]:
                kept[-1] = x
            continue
        kept.append(x)
    return kept + _apart(inside)


def settle(found: list[tuple], threshold: float) -> list[tuple]:
    """The findings at or over the threshold, without those that begin inside one before, which grows to their end."""
    out: list[tuple] = []
    for x in found:
        if x[3] >= threshold:
            if out and x[0] < out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], x[1]), *out[-1][2:])
            else:
                out.append(x)
    return out


class Features:
    """transitions: log-likelihood of the next character class-wise bigram in secrets less that in others."""

    def __init__(self, secrets: list[str], others: list[str], words: frozenset[str] = WORDS) -> None:
        self.words, self.automaton, self.table = words | WORDS, None, {}
        counts = []
        for texts in (secrets, others):
            c: dict[str, int] = {}
            for t in texts:
                for a, b in zip(t, t[1:], strict=False):
                    k = self.pair(a, b)
                    c[k] = c.get(k, 0) + 1
            counts.append((c, sum(c.values()) + 1000))
        for k in set(counts[0][0]) | set(counts[1][0]):
            (a, n), (b, m) = counts
            self.table[k] = math.log((a.get(k, 0) + 1) / n) - math.log((b.get(k, 0) + 1) / m)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"automaton": None}  # made anew in each worker

    def covered(self, lower: str) -> int:
        """Characters that dictionary words cover, the longest from the left."""
        if self.automaton is None:
            made = ahocorasick.Automaton()
            for w in self.words:
                if len(w) >= SHORTEST:
                    made.add_word(w, len(w))
            made.make_automaton()
            self.automaton = made
        return sum(n for _, n in self.automaton.iter_long(lower))

    @staticmethod
    def pair(a: str, b: str) -> str:
        return ("0" if a.isdigit() else a) + ("0" if b.isdigit() else b)

    def of(self, value: str, left: str, right: str, path: str) -> list[float]:
        n = max(1, len(value))
        kinds = [char_class(c) for c in value]
        moves = [0.0] * 16
        for a, b in zip(kinds, kinds[1:], strict=False):
            moves[a * 4 + b] += 1 / n
        counts: dict[str, int] = {}
        for c in value:
            counts[c] = counts.get(c, 0) + 1
        entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
        covered = self.covered(value.lower())
        like = sum(self.table.get(self.pair(a, b), 0.0) for a, b in zip(value, value[1:], strict=False)) / n
        runs = sum(a == b for a, b in zip(value, value[1:], strict=False)) / n
        steps = sum(ord(b) - ord(a) == 1 for a, b in zip(value, value[1:], strict=False)) / n
        hexes = sum(c in "0123456789abcdefABCDEF" for c in value) / n
        out = [float(len(value)), entropy, len(counts) / n, covered / n, like, runs, steps, hexes, *[kinds.count(i) / n for i in range(4)], *moves]
        near = [0.0] * WORD_SLOTS
        for w in WORD.findall(left)[-3:] + WORD.findall(right)[:2]:
            near[zlib.crc32(w.lower().encode()) % WORD_SLOTS] += 1
        spot = [0.0] * PATH_SLOTS
        for w in WORD.findall(path):
            spot[zlib.crc32(w.lower().encode()) % PATH_SLOTS] += 1
        assigned = re.search(r"""[=:]\s{0,3}["']?$""", left) is not None
        return [*out, float(assigned), float(left.endswith(('"', "'"))), *near, *spot]


class Forest:
    """Random forest of binary trees over binned features, with Gini splits; arrays of nodes, children left then right."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7, trees: int = TREES, depth: int = DEPTH) -> None:
        rng = np.random.default_rng(seed)
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)], axis=1)
        self.trees = [self._grow(binned, y, rng.integers(0, len(y), len(y)), rng, depth) for _ in range(trees)]

    def _grow(self, x: np.ndarray, y: np.ndarray, rows: np.ndarray, rng: np.random.Generator, depth: int) -> np.ndarray:
        """Rows of (feature or -1, cut, left, right, share of ones)."""
        nodes: list[list[float]] = []
        width = max(1, int(math.sqrt(x.shape[1]) * 1.5))

        def grow(rows: np.ndarray, left: int) -> int:
            me, ones = len(nodes), y[rows].mean()
            nodes.append([-1, 0, 0, 0, ones])
            if left == 0 or len(rows) < 2 * LEAF or ones in (0.0, 1.0):
                return me
            best = (1e9, -1, 0)
            for f in rng.choice(x.shape[1], width, replace=False):
                n = np.bincount(x[rows, f], minlength=BINS + 1).cumsum()[:-1]
                p = np.bincount(x[rows, f], weights=y[rows], minlength=BINS + 1).cumsum()[:-1]
                m, q = len(rows) - n, ones * len(rows) - p
                good = (n >= LEAF) & (m >= LEAF)
                if good.any():
                    g = np.where(good, 2 * p * (1 - p / np.maximum(n, 1)) + 2 * q * (1 - q / np.maximum(m, 1)), 1e9)
                    at = int(g.argmin())
                    best = min(best, (float(g[at]), int(f), at))
            if best[1] < 0:
                return me
            goes = x[rows, best[1]] <= best[2]
            nodes[me][:2] = [best[1], best[2]]
            nodes[me][2] = grow(rows[goes], left - 1)
            nodes[me][3] = grow(rows[~goes], left - 1)
            return me

        grow(rows, depth)
        return np.array(nodes)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)], axis=1)
        total = np.zeros(len(x))
        for t in self.trees:
            at = np.zeros(len(x), int)
            while (inner := t[at, 0] >= 0).any():
                i = at[inner]
                goes = binned[inner, t[i, 0].astype(int)] <= t[i, 1]
                at[inner] = np.where(goes, t[i, 2], t[i, 3]).astype(int)
            total += t[at, 4]
        return total / len(self.trees)


class Model:
    def __init__(self, findings: list[tuple[str, str, str, str, int]], words: frozenset[str] = WORDS) -> None:
        """findings: (candidate, text before, text after, path, 1 for a secret). Needs both kinds."""
        self.features = Features([f[0] for f in findings if f[4]], [f[0] for f in findings if not f[4]], words)
        x = np.array([self.features.of(*f[:4]) for f in findings])
        self.forest = Forest(x, np.array([f[4] for f in findings], float))

    def scan(self, texts: list[str | None], paths: list[str | None]) -> list[list[tuple[int, int, str, float]]]:
        """(start, end, rule, score) of each candidate of each text. All candidates go through the forest together."""
        found = [candidates(t or "") for t in texts]
        x = [self.features.of(t[a : min(b, a + READ)], t[max(0, a - CONTEXT) : a], t[b : b + CONTEXT], p or "") for t, p, own in zip(texts, paths, found, strict=True) for a, b, _ in own]
        scores = iter(self.forest.scores(np.array(x)).tolist())
        return [[(*c, next(scores)) for c in own] for own in found]


def labelled_findings(n: int = 6000, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """Labelled findings where no reviewed ones are at hand: forms of secrets, and of what is mistaken for them, in
    neighbourhoods of code and prose. The label follows from the form, never from the neighbourhood alone."""
    r = random.Random(seed)
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve com pro con ex qu ment ung sch que".split()

    def word() -> str:
        return "".join(r.choice(syllables) for _ in range(r.randint(1, 5)))

    def prose(k: int) -> str:
        return " ".join(word() for _ in range(k))

    def chars(alphabet: str, k: int) -> str:
        return "".join(r.choice(alphabet) for _ in range(k))

    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    names = ["password", "passwd", "secret", "token", "api_key", "auth_token", "access_key", "credential"]
    paths = ["src/config/settings.py", ".env", "deploy/prod.yml", "app/main.js", "docs/guide.md", "tests/fixtures/data.json", "README.md", "crawl", ""]
    out = []
    for _ in range(n):
        path, lead, tail = r.choice(paths), prose(r.randint(0, 6)), prose(r.randint(0, 4))
        quote = r.choice(['"', "'", ""])
        name = r.choice(names)
        joined = name + r.choice(["=", " = ", ": ", ":"]) + quote
        if r.random() < 0.5:
            form = r.randrange(6)
            if form == 0:
                out.append(("AKIA" + chars(up + "234567" if r.random() < 0.5 else up + dig, 16), f"{lead} ", f" {tail}", path, 1))
                continue
            value = [chars("0123456789abcdef", r.choice([16, 18, 20, 24, 32, 40, 64])), chars(low + up + dig, r.randint(16, 44)), chars(low + up + dig + "+/", r.choice([24, 40, 44, 64])), chars(low + up + dig + "!#%*-_", r.randint(9, 24)), r.choice(["ghp_", "sk-", "xoxb-", "glpat-"]) + chars(low + up + dig, r.randint(20, 40))][form - 1]
            before = joined if form != 5 or r.random() < 0.5 else ""
            out.append((value, f"{lead} {before}", f"{quote if before else ''} {tail}", path, 1))
        else:
            form = r.randrange(11)
            value = [
                r.choice(["your_password_here", "changeme123", "example-token-1234", "xxxxxxxxxxxxxxxx1", "password123", "<password1>", "${PASSWORD1}", "test1234test1234", "dummy_secret_0001"]),
                "-".join(word() for _ in range(r.randint(3, 5))) + str(r.randint(0, 99)),
                "_".join(r.choice(sorted(WORDS)) for _ in range(r.randint(2, 4))) + str(r.randint(0, 9)),
                chars(dig, r.randint(16, 19)),
                "/".join(word() for _ in range(r.randint(3, 6))) + f"/v{r.randint(1, 9)}",
                f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(0, 23):02}{r.randint(0, 59):02}",
                r.choice(dig + low) * r.randint(16, 40) + r.choice(["", "1"]),
                (low + dig)[r.randint(0, 8) :][: r.randint(16, 26)] + "1",
                "".join(word() for _ in range(r.randint(3, 7))) + chars(dig, r.randint(1, 2)),
                f"{word()}.{word()}({word()}{r.randint(0, 9)})",
                chars("=-_", r.randint(16, 40)) + "1",
            ][form]
            before = joined if form in (0, 2, 9) or r.random() < 0.2 else ""
            out.append((value, f"{lead} {before}", f"{quote if before else ''} {tail}", path, 0))
    return out


def train(findings: DataFrame | list[tuple[str, str, str, str, int]], most: int = MAX_FINDINGS, words: frozenset[str] = WORDS) -> Model:
    """A model from labelled findings: rows of candidate, before, after, path, secret (0/1), and dictionary words. Of more than most rows those
    with the smallest hashes are taken; rows with a null candidate or label are left out, other nulls count as empty."""
    if isinstance(findings, DataFrame):
        from pyspark.sql import functions as F

        rows = pick(findings, **{c: c for c in ("candidate", "before", "after", "path", "secret")}).where("candidate is not null and secret is not null")
        rows = rows.orderBy(F.xxhash64("candidate", "before", "after", "path"), "candidate").limit(most).collect()
        findings = [(r[0], r[1] or "", r[2] or "", r[3] or "", int(r[4])) for r in rows]
    findings = findings[:most]
    if len({f[4] for f in findings}) < 2:
        raise ValueError("training needs findings of both labels")
    return Model(findings, words)


@lru_cache(2)
def standard(vocabulary: str | None = None) -> Model:
    """The model of labelled_findings(), with the dictionary of a vocabulary file."""
    return train(labelled_findings(), words=dictionary(vocabulary) if vocabulary else WORDS)


FINDINGS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("rule", pa.string()), ("score", pa.float64())]))


def scan(docs: DataFrame, model: Model | None = None, doc_id: str = "doc_id", text: str = "text", path: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, secrets, removed, redacted: findings at or over the threshold and those under it (array of struct<start, end,
    rule, score>, code points, by start), and the text with [SECRET] for each finding; one row for each row.

    Null texts have no findings and stay null; null paths count as empty; repeated rows are each answered, an empty table gives none. One
    pass over whole texts, no shuffle; the model, bounded by its trees and dictionary, is sent once to each executor."""
    source = pick(docs, doc_id=doc_id, text=text, path=path)
    shared = docs.sparkSession.sparkContext.broadcast(model or standard())

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        m, yes, no, red = shared.value, [], [], []
        texts = batch.column(1).to_pylist()
        for t, found in zip(texts, m.scan(texts, batch.column(2).to_pylist()), strict=True):
            good = settle(found, threshold)
            yes.append([dict(zip(("start", "end", "rule", "score"), x, strict=True)) for x in good])
            no.append([dict(zip(("start", "end", "rule", "score"), x, strict=True)) for x in found if x[3] < threshold and not any(g[0] <= x[0] < g[1] for g in good)])
            red.append(redact(t, good) if good else t)
        return [batch.column(0), pa.array(yes, FINDINGS), pa.array(no, FINDINGS), pa.array(red, pa.string())]

    kind = "array<struct<start:int,end:int,rule:string,score:double>>"
    return by_batch(source, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, secrets {kind}, removed {kind}, redacted string", run)


def redact_rows(docs: DataFrame, model: Model | None = None, text: str = "text", path: str = "source", n_chars: str = "n_chars", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, with secrets masked in the text and n_chars brought up to date where it changed.

    Null texts and counts of texts without secrets stay as they are; null paths count as empty; repeated rows stay; columns are found by
    position, the first of a name, whatever others are called."""
    shared, columns, schema = docs.sparkSession.sparkContext.broadcast(model or standard()), docs.columns, docs.schema
    t, p, c = columns.index(text), columns.index(path), columns.index(n_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(__name__)
        for batch in (part for whole in batches for part in slices(whole)):
            texts, counts = batch.column(t).to_pylist(), batch.column(c).to_pylist()
            for i, found in enumerate(shared.value.scan(texts, batch.column(p).to_pylist())):
                good = settle(found, threshold)
                if good:
                    texts[i] = redact(texts[i], good)
                    counts[i] = len(texts[i])
            arrays = list(batch.columns)
            arrays[t], arrays[c] = pa.array(texts, pa.string()), pa.array(counts, batch.column(c).type)
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def redact(text: str, found: list[tuple]) -> str:
    out, at = [], 0
    for a, b, *_ in found:
        out += [text[at:a], MASK]
        at = b
    return "".join([*out, text[at:]])
