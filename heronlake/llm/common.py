"""What the operators share: picking columns by exact name, blocks of Arrow rows, joins on keys that may be hot.

Rules that hold for every operator here, unless its docstring says otherwise:
an operator reads only the columns it is given by name (exact case, the first of that name), so extra
columns, also such as are named like its outputs, never clash; a null text counts as empty; repeated rows
are answered as often as they occur; empty tables give empty results with the same schema.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import Tables, scope, shared_folder

__all__ = ["Tables", "scope", "shared_folder"]


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under new names: pick(df, key="doc_id"). Columns are found by position, so that
    names that differ only in case, or occur twice, are no ambiguity."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select([F.col(f"c{df.columns.index(old)}").alias(new) for new, old in columns.items()])


#: Rows that Spark hands to a Python worker at once; its default of 10,000 whole texts would be held several times over.
BATCH_ROWS = 512
#: Bytes that a function gets at once, or one row.
SLICE_BYTES = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS rows, unless they are smaller. Spark reads the setting when a plan runs, after the
    operator has returned, so it stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


_held: dict[str, list[Callable[[], None]]] = {}
_owner = ""


def hold(owner: str, free: Callable[[], None]) -> None:
    """Registers, as a module is imported, what frees the memory that its operator keeps in a worker from task to task."""
    _held.setdefault(owner, []).append(free)


def only(owner: str) -> None:
    """A worker serves one operator after another: when another begins, what the earlier ones kept is freed and
    handed back to the system."""
    global _owner
    if owner != _owner:
        for other, frees in _held.items():
            for free in frees if other != owner else ():
                free()
        _owner = owner
        hand_back()


def hand_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batch: pa.RecordBatch, rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batch in slices of so many rows and, where they hold several rows, SLICE_BYTES."""
    todo = [batch.slice(at, rows) for at in range(0, batch.num_rows, rows)][::-1]
    while todo:
        part = todo.pop()
        n = part.num_rows
        if n > 1 and part.nbytes > SLICE_BYTES:
            todo += [part.slice(n // 2), part.slice(0, n // 2)]
        else:
            yield part


def by_batch(df: DataFrame, schema: str, function: Callable[[pa.RecordBatch], list[pa.Array]], rows: int = BATCH_ROWS) -> DataFrame:
    """mapInArrow in slices of so many rows and SLICE_BYTES; function gives the output columns of a slice. Memory is bounded
    by the slice, or one row, not by the partition."""

    owner = function.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(owner)
        for batch in batches:
            for part in slices(batch, rows):
                yield pa.RecordBatch.from_arrays(function(part), names=names_of)
        pa.default_memory_pool().release_unused()

    names_of = [x.split()[0] for x in _fields(schema)]
    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def filter_rows(df: DataFrame, keep: Callable[[pa.RecordBatch], list[bool]], rows: int = BATCH_ROWS) -> DataFrame:
    """The rows, with all their columns, for which keep says so."""

    owner = keep.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(owner)
        for batch in batches:
            for part in slices(batch, rows):
                yield part.filter(pa.array(keep(part), pa.bool_()))

    small_batches(df.sparkSession)
    return df.mapInArrow(run, df.schema)


def by_key(rows: DataFrame, keyed: DataFrame, on: list[str], k: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with keyed, which has one row for each key (no nulls) and k, how many rows have it. Keys of more than a hundred-thousandth of
    total (64 at least), of which there are 100,000 at most, are broadcast; rows of the others are shuffled. how: inner or left.
    rows and keyed are read twice: pass written tables."""
    cut = max(64, total // 100_000)
    hot = F.broadcast(keyed.where(F.col(k) > cut))
    cold = rows.join(hot.select(*on), on, "left_anti").join(keyed.where(F.col(k) <= cut), on, how)
    return rows.join(hot, on).unionByName(cold)


def without(docs: DataFrame, dropped: DataFrame, doc_id: str, text: str, most: int = 500_000) -> DataFrame:
    """The rows of docs, with all their columns, whose (doc_id, xxhash64 of the text) is not among dropped(doc_id, h). A list of
    up to most rows is broadcast; beyond that, both sides are shuffled. docs' columns are found by position, whatever their names."""
    few = dropped.limit(most + 1).count() <= most
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    key, content = (plain[f"c{docs.columns.index(x)}"] for x in (doc_id, text))
    gone = dropped.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"))
    on = key.eqNullSafe(F.col("_id")) & (F.xxhash64(content) == F.col("_h"))
    return plain.join(F.broadcast(gone) if few else gone, on, "left_anti").toDF(*docs.columns)


def _fields(schema: str) -> list[str]:
    out, depth, now = [], 0, ""
    for c in schema:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [*out, now.strip()]


class Bounded(dict):
    """A cache that computes what is missing. When full, it keeps what was asked for since it was last full: at most twice the number of
    entries. Keys of more than LONGEST characters are computed and not kept, so that entries bound the bytes, too. doors: so many marks, by
    hash, of what was asked for once; beyond a sixteenth of most, only what is asked for again is kept: a corpus has most of its words once."""

    LONGEST = 64

    def __init__(self, compute: Callable, most: int, doors: int = 0) -> None:
        super().__init__()
        self.compute, self.most, self.older = compute, most, {}
        self.doors, self.marked = bytearray(doors), 0

    def __missing__(self, key):
        if len(key) > self.LONGEST:
            return self.compute(key)
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
            if self.doors and len(self) >= self.most // 16 and self._first(key):
                return value
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value

    def _first(self, key) -> bool:
        """Whether the key's mark was not set yet. The marks are wiped when half of them are set."""
        at = hash(key) % len(self.doors)
        if self.doors[at]:
            return False
        if self.marked >= len(self.doors) // 2:
            self.doors, self.marked = bytearray(len(self.doors)), 0
        self.doors[at] = 1
        self.marked += 1
        return True

    def forget(self) -> None:
        self.clear()
        self.older = {}
