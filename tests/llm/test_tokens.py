"""Encoding, token counts and token files against the libraries they stand for."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer, models, normalizers

from diffmill.llm import bpe, token_counts, token_files
from diffmill.llm.simple8b import pack, unpack

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = " \n\t  aàb'sre1２x漢字́😀​\x1c\x85\xa0.,-!\r　llve"


def sha(x):
    return hashlib.sha256(x).hexdigest()


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_encoder_equals_library(library):
    encoder = bpe.TextEncoder(bpe.BytePairs(bpe.read_ranks(RANKS)), P.PATTERN, kept=50)
    draw = random.Random(1)
    texts = ["".join(draw.choices(ALPHABET, k=draw.randint(0, 30))) for _ in range(3000)]
    texts += ["a" * 5000, "".join(draw.choices("etaoinshr", k=20_000)), "x   y", "x \n y  ", "  "]
    for start in range(0, len(texts), 40):
        some = texts[start : start + 40]
        ids, sizes = encoder.encode(some)
        for text, own in zip(some, np.split(ids, np.cumsum(sizes)[:-1])):
            assert own.tolist() == library.encode_ordinary(text), repr(text)
    assert encoder.encode([])[0].tolist() == [] and encoder.encode([""])[1].tolist() == [0]


def test_words_are_remembered_without_marks(library):
    encoder = bpe.TextEncoder(bpe.BytePairs(bpe.read_ranks(RANKS)), P.PATTERN, kept=50)
    text = "a zqxwvu, zqxwvu. zqxwvu; zqxwvu zqxwvu?! zqxwvu.\nzqxwvu é. ² ². .. ."
    assert encoder.encode([text])[0].tolist() == library.encode_ordinary(text)
    assert {"zqxwvu", "é"} < set(encoder.parts)
    assert not {"zqxwvu,", "zqxwvu.", "zqxwvu;", "zqxwvu.\nzqxwvu", "é."} & set(encoder.parts)


def test_words_of_latin_letters():
    letters = [chr(i) for i in range(1, 0x180)]
    assert [x for x in letters if token_files._WORD(x)] == [x for x in letters if x.isalpha() and x < "\u0100"]
    assert [token_files._WORD(x)[1] for x in ("ab", "ab.", "é?")] == ["", ".", "?"]
    assert not any(map(token_files._WORD, ["", ".", "a..", "a b", "a\n", "a.\n", "a-", "1", "aĀ"]))


def test_queue_is_empty_between_calls():
    pairs = bpe.BytePairs(bpe.read_ranks(RANKS))
    pairs.encode(b"qwertyuiopasdfghjkl")
    assert not any(pairs.leaves)


def check_digests(rows, texts, library):
    for r in rows:
        text = texts[r.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()))
        assert r.decoded_sha256 == sha(text.encode())


def test_digests(odd, none, docs, library):
    rows = bpe.digests(odd, RANKS, P.PATTERN).collect()
    assert len(rows) == odd.count()
    check_digests(rows, {r.doc_id: r.text for r in odd.collect()}, library)
    check_digests(bpe.digests(docs, RANKS, P.PATTERN).collect(), {r.doc_id: r.text for r in docs.collect()}, library)
    assert bpe.digests(none, RANKS, P.PATTERN).count() == 0


def test_encode_keeps_columns(odd):
    coded = bpe.encode(odd, RANKS, P.PATTERN)
    assert set(coded.columns) == set(odd.columns) and dict(coded.dtypes)["ids"] == "array<int>"
    assert bpe.decode(coded.selectExpr("doc_id", "CAST(NULL AS array<int>) AS ids"), RANKS).head().decoded == b""
    mixed = coded.selectExpr("doc_id", "text", "CASE WHEN doc_id % 2 = 0 THEN ids END AS ids")
    for r in bpe.decode(mixed, RANKS).collect():
        assert r.decoded == ((r.text or "").encode() if r.doc_id % 2 == 0 else b"")
    odd_ids = coded.limit(1).selectExpr("array(-1, 5, 1000000, CAST(NULL AS int)) AS ids")
    assert bpe.decode(odd_ids, RANKS).head().decoded == bpe.BytePairs(bpe.read_ranks(RANKS)).strings[5]


def test_unknown_ids_decode_to_nothing():
    pairs = bpe.BytePairs(bpe.read_ranks(RANKS))
    assert pairs.decode([*pairs.encode(b"ok"), 10**6, -1]) == b"ok"


def test_simple8b_round_trip():
    draw = np.random.default_rng(0)
    for trial in range(100):
        lengths = draw.integers(0, 90, draw.integers(0, 12))
        ids = draw.integers(0, 2**62, int(lengths.sum()), dtype=np.uint64)
        ids >>= draw.integers(0, 62, len(ids)).astype(np.uint64)
        if trial % 3 == 0:
            ids %= np.uint64(3)
        words, offsets = pack(ids, lengths)
        assert (unpack(words, offsets, lengths) == ids).all()
        ends = np.cumsum(lengths)
        for k, n in enumerate(lengths):  # one document of a block
            one = unpack(words[offsets[k] : offsets[k + 1]], np.array([0, offsets[k + 1] - offsets[k]]), lengths[k : k + 1])
            assert (one == ids[ends[k] - n : ends[k]]).all()


def test_simple8b_escapes_large_ids():
    ids = np.array([2**64 - 1, 14, 2**60, 5], np.uint64)
    words, offsets = pack(ids, np.array([4]))
    assert (unpack(words, offsets, np.array([4])) == ids).all()
    assert len(pack(np.zeros(60, np.uint64), np.array([60]))[0]) == 1


@pytest.mark.parametrize("table", ["odd", "docs", "none"])
def test_token_files(spark, tmp_path, request, table):
    frame = request.getfixturevalue(table)
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    library.encode_special_tokens = True
    path = str(tmp_path / "files")
    token_files.write_tokens(frame, path, P.path("word_bpe_49k.json"), end_id=2, block_ids=500, kept=100)
    found = token_files.checked(token_files.read_documents(spark, path)).collect()
    assert len(found) == frame.count()
    start, texts = 0, {r.doc_id: r.text for r in frame.collect()}
    for r in sorted(found):
        ids = [*library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens) == (start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_token_files_of_special_tokens(spark, tmp_path):
    texts = [
        "a story <|endoftext|> next", "<|startoftext|><|endoftext|>", "x<|endoftext|>y", "<|ENDOFTEXT|> <|endoftext |>",
        "a\n<|startoftext|>É\u0301<|endoftext|>\u0301b",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    path = str(tmp_path / "files")
    token_files.write_tokens(frame, path, P.path("word_bpe_49k.json"), end_id=2)
    rows = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in token_files.read_documents(spark, path).collect()}
    assert rows == {i: [*library.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    assert rows[0] == [320, 1134, 49407, 1131, 2]


def test_spellings_share_a_remembered_word():
    encoder = token_files.WordEncoder(P.path("word_bpe_49k.json"), 2, kept=1000)
    sent, words = [], encoder._words

    def seen(some):
        sent.extend(some)
        return words(some)

    encoder._words = seen
    for text in ("Zqxwvu zqxwvu, ZQXWVU!! (a)", "zqxwvu.$$$\tzQxwvu É é. É, " + "b" * 64):
        encoder.encode(pa.array([text]))
    assert sorted(sent) == ["b" * 64, "zqxwvu", "é"]
    assert set(encoder.known) == {"zqxwvu", "é", "", ",", ".", "!!", ".$$$", "(a)"}


def test_ids_equal_library_around_every_character():
    characters = [*map(chr, range(0x180)), "\u0301", "\u0345", "\u200d", "\u2028", "\u212a", "\u3000", "中", "\ufb01"]
    texts = [
        None, "", " ", "\r\n\x0b\x0c", "<|endoftext|> <|ENDOFTEXT|>. x<|endoftext|>", "don't DON'T dogs' 'tis",
        *(f"a{c}b A{c}, {c} {c}.É{c}\u0301 <|{c}|>" for c in characters),
    ]
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    encoder = token_files.WordEncoder(P.path("word_bpe_49k.json"), 2, kept=50)
    for some in (texts[i : i + 100] for i in range(0, len(texts), 100)):
        ids, lengths = encoder.encode(pa.array(some, pa.string()))
        for text, one in zip(some, np.split(ids, np.cumsum(lengths)[:-1])):
            assert one.tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 2]
    assert [x.tolist() for x in encoder.encode(pa.array([None, None], pa.string()))] == [[2, 2], [1, 1]]


def test_tokenizers_that_keep_capitals_are_refused(tmp_path):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    library.normalizer = normalizers.NFC()
    library.save(str(tmp_path / "capitals.json"))
    with pytest.raises(ValueError, match="lower-cases"):
        token_files.WordEncoder(str(tmp_path / "capitals.json"), 2, 100)


def test_blocks_close_at_the_first_document_end(spark, tmp_path):
    frame = spark.createDataFrame([(i, "a " * (i * 7 % 40)) for i in range(1300)], "doc_id bigint, text string")
    path = str(tmp_path / "files")
    token_files.write_tokens(frame.coalesce(1), path, P.path("word_bpe_49k.json"), end_id=2, block_ids=60)
    parts = {}
    for r in spark.read.parquet(path).orderBy("part", "ids_before").collect():
        parts.setdefault(r.part, []).append(r)
    for blocks in parts.values():
        assert all(sum(b.lengths[:-1]) < 60 <= sum(b.lengths) for b in blocks[:-1])
        assert [b.ids_before for b in blocks] == [sum(sum(x.lengths) for x in blocks[:k]) for k in range(len(blocks))]
    pairs = [p for k in sorted(parts) for b in parts[k] for p in zip(b.doc_ids, b.lengths)]
    assert pairs == [(i, i * 7 % 40 + 1) for i in range(1300)]


def test_piece_counts_equal_library(odd, none, docs):
    starts, others = token_counts.read_pieces(P.path("piece_bpe_32k.model"))
    vocabulary = {"[UNK]": 0}
    for piece in [*starts, *("##" + p for p in others)]:
        vocabulary.setdefault(piece, len(vocabulary))
    library = models.WordPiece(vocabulary, unk_token="[UNK]", max_input_chars_per_word=10**9, continuing_subword_prefix="##")
    counts = {}

    def pieces(word):
        if word not in counts:
            counts[word] = [t.value for t in library.tokenize(word)]
        return counts[word]

    for frame in (odd, docs):
        texts = {r.doc_id: r.text for r in frame.collect()}
        for r in token_counts.token_counts(frame, P.path("piece_bpe_32k.model"), kept=50).collect():
            found = [pieces(w) for w in re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")]
            assert (r.n_words, r.n_tokens) == (len(found), sum(map(len, found)))
            assert r.n_unknown == sum(f == ["[UNK]"] for f in found)
    assert token_counts.token_counts(none, P.path("piece_bpe_32k.model")).count() == 0
