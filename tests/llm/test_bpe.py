import hashlib
import unicodedata

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerline.llm import bpe
from ledgerline.llm.lexicon import Lexicon, compile_lexicon

PATH = public_tokenizers.path("word_bpe_49k.json")
TRUTH = Tokenizer.from_file(PATH)
TEXTS = ["Hello, World's  DON'T 123 ñandú Σας ΟΔΟΣ", "a<|endoftext|>b <|STARTOFTEXT|> x", "", "  \n", "İx \x1c y\x85z é", None, "x" * 3000, "日本語 текст 😀😀 ½²", "<|startoftext|><|endoftext|>"]


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(PATH)


def same(codec, text):
    e = TRUTH.encode(text or "", add_special_tokens=False)
    ids, decoded = codec.coded(text)
    assert np.frombuffer(ids, "<u4").tolist() == e.ids
    assert decoded == TRUTH.decode(e.ids, skip_special_tokens=False) == codec.decode(e.ids)


@pytest.mark.parametrize("text", TEXTS)
def test_cases(codec, text):
    same(codec, text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8", max_codepoint=0x2FFF), max_size=60))
def test_any_text(codec, text):
    # letters that Unicode has got since are no letters for every library yet
    text = "".join(c for c in text if unicodedata.category(c) != "Cn")
    same(codec, text)


@pytest.mark.parametrize("text", ["x" * 40_000, "ab" * 10_000, "walking" * 5_000, "".join(map(chr, np.random.default_rng(5).integers(97, 123, 60_000)))], ids=["letter", "pair", "word", "any"])
def test_long_words(codec, text):
    same(codec, text)


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=2, max_size=200) | st.text("abelnst", min_size=2, max_size=200).map(str.encode))
def test_long_merges(codec, word):
    ids = [codec._first[b] for b in word[:-1]] + [codec._last[word[-1]]]
    assert codec._merge_long(ids) == codec.merge(word)


def test_lexicon(tmp_path, codec):
    words = [b"a", b"ab", b"walking", b"talking", b"talked", b"walked", "größe".encode()]
    (tmp_path / "x").write_bytes(compile_lexicon({w: codec.merge(w) for w in words}))
    lexicon = Lexicon(str(tmp_path / "x"))
    assert len(lexicon) == len(words)
    assert all(lexicon.get(w) == codec.merge(w) for w in words)
    assert all(lexicon.get(w) is None for w in (b"", b"walk", b"b", b"walkings"))
    assert lexicon.states < sum(map(len, words))  # prefixes and suffixes are shared
    (tmp_path / "y").write_bytes(compile_lexicon({}))
    assert Lexicon(str(tmp_path / "y")).get(b"a") is None


def test_column(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    digest = bpe.digests(bpe.ship_lexicon(docs, PATH), PATH)
    for r in docs.select("text", digest("text").alias("x")).collect():
        e = TRUTH.encode(r.text or "", add_special_tokens=False)
        assert r.x.n_tokens == len(e.ids)
        assert r.x.ids_sha256 == hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest()
        assert r.x.decoded_sha256 == hashlib.sha256(TRUTH.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()
    empty = docs.limit(0)
    assert empty.select(bpe.digests(bpe.ship_lexicon(empty, PATH), PATH)("text")).count() == 0
