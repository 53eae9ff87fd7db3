"""Byte-level BPE and token files against the public libraries."""

import hashlib
import zlib

import random
import string

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from foldspark.llm import byte_bpe, common, token_files, word_tokens

PATH, PATTERN = byte_bpe.default_vocabulary()
BPE = byte_bpe.load(PATH, PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(BPE.tokens)}, special_tokens={})
FRESH = Tokenizer.from_file(token_files.default_vocabulary())
WORDS = word_tokens.WordTokenizer(token_files.default_vocabulary())
SMALL = word_tokens.WordTokenizer(token_files.default_vocabulary(), words=8)


def encode(tokenizer, texts):
    return [x.tolist() for x in tokenizer.encode(*common.text_bytes(pa.array(texts, pa.string())))]


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_byte_bpe_equals_the_library(text):
    (ids,) = BPE.encode([text])
    assert ids.tolist() == LIBRARY.encode_ordinary(text)
    assert BPE.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(max_codepoint=255)) | st.text() | st.text("aBc'.,!1 <|>\n\x1c\x85\u0301"), max_size=4))
def test_word_tokenizer_equals_the_library(texts):
    want = [FRESH.encode(t, add_special_tokens=False).ids for t in texts]
    assert encode(WORDS, texts) == want and encode(SMALL, texts) == want


def test_word_tokenizer_on_odd_words():
    texts = ["H\u0331 \u1e96 I\u0307 \u0130", "x" * 100 + " " + "X" * 100, "A\x1cB\x85C\xa0D", "\u212a\u2126 \ufb01 \u03a3\u03a3", None, "", " ", "don't 'S I'LL it's.'s"]
    assert encode(WORDS, texts) == [FRESH.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_other_vocabularies_get_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    other, fresh = word_tokens.WordTokenizer(path), Tokenizer.from_file(path)
    texts = ["Two words.", "  white  space\n\n", "<|endoftext|> x", None]
    assert not other.by_word and WORDS.by_word
    assert encode(other, texts) == [fresh.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_long_pieces_equal_the_library():
    rng = random.Random(1)
    for size, letters in ((2049, "ab"), (5000, "a"), (4000, "日本語"), (9000, string.ascii_lowercase), (1_000_000, string.ascii_letters)):
        text = "".join(rng.choices(letters, k=size))
        assert BPE.encode([text])[0].tolist() == LIBRARY.encode_ordinary(text)


def test_memo_keeps_what_is_asked_for_again():
    memo = common.Memo(4)
    for k in range(50):
        for w in memo.missing({"often", f"w{k}"}):
            memo.new[w] = w.encode()
        assert k == 0 or "often" in memo.new
        assert len(memo.new) + len(memo.old) <= 6


def test_long_runs_and_special_strings():
    texts = ["a" * 3000, " " * 3000, "ab" * 1500, "<|endoftext|>", "'ll 've't", "\n\n \n x", None, ""]
    assert [x.tolist() for x in BPE.encode(texts)] == [LIBRARY.encode_ordinary(t or "") for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70_000), max_size=3000), st.integers(1, 70_000))
def test_coder_round_trip(ids, spread):
    docs = [np.array([i % spread for i in ids[k : k + 100]], np.uint32) for k in range(0, len(ids), 100)]
    row = token_files.pack_group(0, 0, list(range(len(docs))), docs)
    assert token_files.unpack_group(row).tolist() == [x for d in docs for x in d.tolist()]


def test_coder_finds_damage_and_compresses():
    ids = (np.random.default_rng(0).zipf(1.5, 200_000) % 49_000).astype(np.uint32)
    row = token_files.pack_group(0, 0, [1], [ids])
    assert len(row["block_ids"]) == 4 and (token_files.unpack_group(row) == ids).all()
    p = np.bincount(ids) / len(ids)
    assert len(row["words"]) * 8 / len(ids) < -(p[p > 0] * np.log2(p[p > 0])).sum() * 1.02 + 0.05
    broken = bytearray(row["words"])
    broken[len(broken) // 2] ^= 1
    with pytest.raises(ValueError):
        token_files.unpack_group(row | {"words": bytes(broken)})


def test_frequencies_fit_the_table():
    for counts in ([1] * 40_000 + [10**9, 0, 5], [0, 0], [7], [1, 1, 1], [10**12, 1]):
        freq = token_files.normalise(np.array(counts))
        assert freq.sum() == (1 << token_files.SCALE_BITS) * any(counts) and all((f > 0) == (c > 0) for f, c in zip(freq, counts, strict=True))


def test_round_trip_query(spark, odd_docs, odd_rows, no_docs):
    want = []
    for r in odd_rows:
        ids = LIBRARY.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.round_trip(odd_docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert byte_bpe.round_trip(no_docs).count() == 0
    back = byte_bpe.decode(byte_bpe.encode(odd_docs))
    assert sorted((bytes(r.data) for r in back.collect())) == sorted((r[1] or "").encode() for r in odd_rows)
    assert byte_bpe.encode_checked(odd_docs).count() == len(odd_rows)


def test_token_files(spark, odd_docs, odd_rows, no_docs, monkeypatch):
    monkeypatch.setattr(token_files, "GROUP_IDS", 500)
    got = token_files.token_ids(odd_docs).collect()
    want, start = [], 0
    assert sorted(got, key=repr) == sorted(token_files.token_ids(odd_docs.repartition(5)).collect(), key=repr)
    ids_of = {}
    for r in sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*FRESH.encode(r[1] or "", add_special_tokens=False).ids, 2]
        ids_of.setdefault(r[0], []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        want.append((r[0], start, len(ids)))
        start += len(ids)
    once = [k for k, v in ids_of.items() if len(v) == 1]
    assert sorted((r.doc_id, r.start, r.n_tokens) for r in got if r.doc_id in once) == sorted(w for w in want if w[0] in once)
    for k, found in ids_of.items():
        assert sorted((r.n_tokens, r.ids_crc32) for r in got if r.doc_id == k) == sorted(found)
    assert sorted(r.start for r in got)[0] == 0 and len(got) == len(odd_rows)
    assert token_files.token_ids(no_docs).count() == 0


def test_token_files_order_rows_with_one_doc_id_by_text(spark):
    rng = random.Random(9)
    rows = [(rng.randint(-3, 3), rng.choice([None, "", "the same beginning of more than thirty-two characters "]) and "the same beginning of more than thirty-two characters " + "".join(rng.choices("ab \u00e9\U0001f642", k=rng.randint(0, 9)))) for _ in range(80)]
    rows += [(k % 7 - 3, "".join(rng.choices("xyzXYZ \u00e9\U0001f642", k=40))) for k in range(120)]
    want, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = [*FRESH.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = token_files.token_ids(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).orderBy("start").collect()
    assert [tuple(r) for r in got] == want
