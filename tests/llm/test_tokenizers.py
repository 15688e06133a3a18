"""Byte-level BPE and unigram counts against the public libraries."""

import random
import struct

import pytest

from heronlake.llm import bpe, common, queries, unigram

PIECES = ["a", "b", " ", "  ", "\n", "the", "ing", "'s", "é", "漢", "1", "23", "!", "\t", " ", "İ", " '", "aaaa", "    ", "\r\n", "😀", "<|endoftext|>"]


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(queries.tokenizer(queries.BPE_FILE), queries.pattern())


@pytest.fixture(scope="module")
def reference(codec):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=queries.pattern(), mergeable_ranks=codec.vocabulary.ranks, special_tokens={})


def texts(n, most, seed):
    r = random.Random(seed)
    return ["".join(r.choice(PIECES) for _ in range(r.randrange(most))) for _ in range(n)]


def test_encoding_equals_the_library_and_decodes(codec, reference):
    words = [w.decode("utf-8", "ignore") for w in list(codec.vocabulary.ranks)[::97]]
    r = random.Random(5)
    for text in [*texts(3000, 25, 1), *("".join(r.choice(words) for _ in range(6)) for _ in range(3000)), "", "x" * 5000, " " * 3000, "ab" * 4000]:
        ids = codec.encode(text)
        assert ids == reference.encode_ordinary(text)
        assert codec.decode_packed(struct.pack(f"<{len(ids)}I", *ids)) == text.encode()


def test_every_prefix_has_the_last_token_of_its_encoding(codec):
    content = "unbelievably thth".encode().replace(b" ", b"")
    p = bpe.Prefixes(codec.vocabulary)
    for i in range(len(content)):
        p.append(content[i : i + 1])
    for end in range(1, len(content) + 1):
        whole = bpe.Prefixes(codec.vocabulary, content[:end]).tokens()
        assert p.tokens(end) == whole and p.last[end] == whole[-1]


def test_edits_equal_encoding_anew(codec, reference):
    r = random.Random(2)
    for text in texts(1500, 40, 3):
        e = bpe.EditableText(codec, text)
        for _ in range(3):
            a = r.randint(0, len(text))
            b = min(len(text), a + r.randint(0, 4))
            new = "".join(r.choice(PIECES) for _ in range(r.randrange(3)))
            text = text[:a] + new + text[b:]
            e.edit(a, b, new)
            assert e.text == text and e.tokens() == reference.encode_ordinary(text)


def test_an_edit_in_a_long_text_is_local(codec):
    e = bpe.EditableText(codec, "some words here " * 2000)
    e.edit(16000, 16004, "more")
    assert e.encoded_anew < 20


def test_encode_rows(spark):
    rows = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, None, "y"), (2, "", "z")], "doc_id long, text string, ids string")
    file, pattern = queries.tokenizer(queries.BPE_FILE), queries.pattern()
    found = sorted((r.doc_id or 0, bytes(r.ids), bytes(r.decoded)) for r in bpe.decode(bpe.encode(rows, file, pattern), file).collect())
    assert len(found) == 4 and [x[2] for x in found] == [b"", b"a b", b"a b", b""]
    assert sorted((r.doc_id or 0, bytes(r.ids), bytes(r.decoded)) for r in bpe.round_trip(rows, file, pattern).collect()) == found
    assert bpe.encode(rows.limit(0), file, pattern).count() == 0


@pytest.fixture(scope="module")
def processor():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(open(queries.tokenizer(queries.UNIGRAM_FILE), "rb").read())
    unigram.rescored(model).trainer_spec.model_type = 1
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def test_counts_equal_the_library(processor):
    counter = unigram.model(queries.tokenizer(queries.UNIGRAM_FILE))
    r = random.Random(8)
    long = "".join(r.choice(PIECES) for _ in range(60_000))
    for text in [*texts(6000, 25, 4), long, "", "word " * 20_000]:
        assert counter.count(text)[0] == len(processor.encode(text))


def test_whole_text_path_equals_segments():
    counter = unigram.model(queries.tokenizer(queries.UNIGRAM_FILE))
    for text in texts(500, 30, 6):
        marked = (" " + text).replace(" ", unigram.MARK)
        assert not text or counter.count(text) == counter.path(marked)


def test_ties_go_to_the_earliest_start():
    u = unigram.Unigram([("a", -1.0), ("b", -1.0), ("ab", -2.0)], dummy_prefix=False)
    assert u.path("ab") == (1, -2.0)


def test_count_rows(spark):
    rows = spark.createDataFrame([(1, "a b"), (None, None), (2, "")], "doc_id long, text string")
    found = {r.doc_id: r.n_tokens for r in unigram.count_tokens(rows, queries.tokenizer(queries.UNIGRAM_FILE)).collect()}
    assert found[None] == 0 and found[2] == 0 and found[1] == 2


def test_fractional_scores_and_user_pieces_equal_the_library():
    """Sums are kept as the library keeps them, as 32-bit floats, over texts of many thousand pieces."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    r = random.Random(12)
    model = pb.ModelProto()
    model.ParseFromString(open(queries.tokenizer(queries.UNIGRAM_FILE), "rb").read())
    unigram.rescored(model).trainer_spec.model_type = 1
    for p in model.pieces:
        if p.type == 1:
            p.score = -r.uniform(3, 14)
    for user in ((), ("ordering",)):
        for p in [p for p in model.pieces if p.piece in user]:
            p.type = 4
        content = model.SerializeToString()
        processor, counter = sentencepiece.SentencePieceProcessor(model_proto=content), unigram.read_model(content)
        words = "the of ordering house \u00e9t\u00e9 x1 reordering \n unglaublich".split(" ")
        long = [" ".join(r.choice(words) for _ in range(5000)) for _ in range(4)]
        for text in [*texts(500, 40, 21), *long]:
            assert counter.count(text)[0] == len(processor.encode(text))


def test_count_of_repeated_rows_and_clashing_names(spark):
    rows = spark.createDataFrame([(1, "a b", 5), (1, "a b", 6)], "doc_id long, text string, n_tokens int")
    file = queries.tokenizer(queries.UNIGRAM_FILE)
    assert [tuple(x)[:2] for x in unigram.count_tokens(rows, file).collect()] == [(1, 2), (1, 2)]
    assert unigram.count_tokens(rows.limit(0), file).count() == 0


def test_a_group_of_one_pre_token_is_remembered_once():
    own = bpe.Codec(bpe.codec(queries.tokenizer(queries.BPE_FILE), queries.pattern()).vocabulary.ranks, queries.pattern())
    own.encode("so qwyzzlek qwyzzlek, qwyzzlek")
    assert " qwyzzlek" in own.groups and " qwyzzlek," in own.groups and "so" not in own.pack
    for word in (" vbqwuth", " vbqwuth!"):
        own.encode("a" + word)
    assert " vbqwuth" in own.groups and set(own.pack) == {" qwyzzlek", ",", " vbqwuth", "!"}


def test_pairs_of_tokens_are_bounded(codec, reference, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_PAIRS", 50)
    v = bpe.Vocabulary(codec.vocabulary.ranks)
    for text in texts(300, 25, 9):
        content = text.encode()
        found = bpe.Prefixes(v, content).tokens()
        assert b"".join(v.bytes_of[i] for i in found) == content
        assert sum(map(len, v.known.values())) <= 51 and v.pairs <= 51


def test_a_worker_keeps_only_what_is_asked_for_again(codec, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_GROUPS", 8_000)
    own = bpe.Codec(codec.vocabulary.ranks, queries.pattern())
    once, again = [f"w{i}x" for i in range(30_000)], "these words come again"
    packed = own.encode_packed(" ".join(once))
    assert own.decode_packed(packed).decode() == " ".join(once)
    assert len(own.groups) < 1_000 and len(own.groups.older) < 1_000
    assert [own.encode_packed(again) for _ in range(3)] == [codec.encode_packed(again)] * 3
    assert {"these", " words", " come", " again"} <= set(own.groups)


def test_marks_and_both_generations_give_what_is_computed():
    cache = common.Bounded(lambda x: x[::-1], 50, 64)
    keys = [f"k{i * i % 97}" for i in range(5_000)]
    assert [cache[k] for k in keys] == [k[::-1] for k in keys]
    assert len(cache) <= 50 and len(cache.older) <= 50 and cache.marked <= 32 and len(cache) + len(cache.older) > 20
