"""Language identification by compression: a text is compressed with one zstandard raw-content dictionary for each language,
cut from labelled documents, and the language whose dictionary gives the fewest bytes is chosen."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, by_batch, filter_rows, hold, pick

UNDETERMINED = "und"
LETTER, OTHERS = regex.compile(r"\p{L}"), regex.compile(r"[^\p{L}]+")
#: Bounds of the training sample: the most frequent languages, documents of each, characters of each document, bytes of a dictionary.
LANGUAGES, SAMPLE_ROWS, SAMPLE_CHARS, DICTIONARY_BYTES = 1000, 400, 1500, 32 * 1024
#: Texts are compressed in blocks of so many bytes, each with the dictionary alone before it. After the last block comes
#: the end of the dictionary: else short texts, which gain less than a header, would all be stored as they are.
BLOCK_BYTES, TAIL_BYTES = 4096, 256
#: Chosen documents up to which their hashes are broadcast, 16 bytes and the language's name each.
BROADCAST_ROWS = 1_000_000
LEVEL = 6
#: A result is rejected when the second language needs less than this share more bytes.
MARGIN = 0.002


def normal(text: str) -> bytes:
    """Lower case, and one space for all that are no letters."""
    return OTHERS.sub(" ", text.lower()).encode("utf-8", "replace")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 5, is 0. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, size: int = DICTIONARY_BYTES, languages: int = LANGUAGES) -> dict[str, bytes]:
    """A dictionary for each language, from documents that are not held out and have a language and letters.

    The sample is the documents with the smallest hashes of each language, chosen by id before any text is moved; it and the dictionaries
    are bounded by the parameters alone: of more languages the most frequent are learned, of ids that are repeated one text. A dictionary
    is the beginning of its sample, so a language of long documents uses fewer of them. Languages with text for a whole dictionary
    have equal sizes; one with less keeps all it has, and takes nothing from the others."""
    labelled = pick(docs, doc_id=doc_id, text=text, lang=lang)
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    tables = Tables(docs.sparkSession, "langid")
    # Different ids: a repeated one counts once, however often it occurs.
    hashed = F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 30)).alias("h")
    ids = tables.write(labelled.select("lang", hashed).distinct(), "ids")
    counts = ids.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(languages)
    # Hashes are even: a cut at four times the wanted share of the ids leaves enough, and little of a frequent language to sort.
    near = ids.join(F.broadcast(counts), "lang").where(F.col("h") / float(1 << 30) * F.col("n") < 4.0 * rows).drop("n")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = near.withColumn("place", place).where(F.col("place") <= rows).select("lang", "h")
    keyed = labelled.select("lang", hashed, F.substring("text", 1, chars).alias("text"))
    few = min(languages, counts.count()) * rows <= BROADCAST_ROWS
    each = keyed.join(F.broadcast(chosen) if few else chosen, ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    by_lang: dict[str, list[bytes]] = {}
    for row in each.orderBy("lang", "h").toLocalIterator():  # languages x rows x chars, bounded
        found = by_lang.setdefault(row["lang"], [])
        if sum(map(len, found)) < size and LETTER.search(row["text"]):
            found.append(normal(row["text"]))
    tables.clear()
    return {k: b"\n".join(x)[:size] for k, x in sorted(by_lang.items()) if x}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.langs = sorted(dictionaries)
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0)
        self.compressors, self.tails = [], []
        for lang in self.langs:
            content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=params)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=content, compression_params=params))
            self.tails.append(dictionaries[lang][-TAIL_BYTES:])

    def sizes(self, text: str) -> list[int]:
        raw = normal(text)
        blocks = [raw[i : i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)]
        last = blocks.pop()
        return [sum([len(c.compress(b)) for b in blocks]) + len(c.compress(last + tail)) for c, tail in zip(self.compressors, self.tails, strict=True)]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, and whether the margin is too narrow. Ties go to the first language by name."""
        if not text or not LETTER.search(text) or not self.langs:
            return UNDETERMINED, 0.0, True
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = sizes[:best] + sizes[best + 1 :]
        if not rest:
            return self.langs[best], 1.0, False
        gap = min(rest) - sizes[best]
        share = gap / min(rest)
        return self.langs[best], min(1.0, share / 0.1), share < MARGIN


@lru_cache(1)
def _classifier(packed: tuple[tuple[str, bytes], ...]) -> Classifier:
    return Classifier(dict(packed))


hold(__name__, _classifier.cache_clear)


def predict(docs: DataFrame, dictionaries: dict[str, bytes], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected; one row for each row, in one pass over whole texts.

    lang_pred is the language of the fewest bytes, also where rejected says that the margin is narrow; it is und, with
    score 0 and rejected, where a text is null, empty or without a letter, or no dictionary is there. score is the share of
    bytes saved against the second language, 1 at a tenth or more. Very long texts are compressed block by block."""
    source = pick(docs, doc_id=doc_id, text=text)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(sorted(dictionaries.items())))

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        c = _classifier(shared.value)
        found = [c.predict(x) for x in batch.column(1).to_pylist()]
        return [batch.column(0), *[pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]]

    kind = source.schema["doc_id"].dataType.simpleString()
    return by_batch(source, f"doc_id {kind}, lang_pred string, score double, rejected boolean", run)


def keep_identified(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose language is not rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(sorted(dictionaries.items())))
    at = docs.columns.index(text)
    return filter_rows(docs, lambda batch: [not _classifier(shared.value).predict(x)[2] for x in batch.column(at).to_pylist()])
