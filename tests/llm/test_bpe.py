from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusloom.llm import bpe

LIB = Tokenizer.from_file(bpe.default_path())
CODEC = bpe.Codec(bpe.Vocabulary(bpe.default_path()))
ODD = ["", "  ", "Hello<|endoftext|>World <|startoftext|> x", "<|endoftext|>", "don't won't I'M it'S", "a b c\x1cd\x85e f　g", "ΣΑΣ ΟΔΟΣ σς", "İstanbul ǅ ﬁ ½ ² Ⅷ", "é é Å", "日本語テキスト 123 4५६", "👩‍👩‍👧 ok!!! ... <|ENDOFTEXT|> <|endoftext", "x" * 3000, "ab" * 2000, "\x00\x01 \x7f", "ſ ß ẞ K   ​", "rrrr rrrrr rrrrrrr"]


def same(texts):
    ids, decoded = CODEC.encode([t.encode() for t in texts])
    for text, i, d in zip(texts, ids, decoded):
        expected = LIB.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(i, "<u4").tolist() == expected
        assert d.decode() == LIB.decode(expected, skip_special_tokens=False)
        assert CODEC.decode(i) == d


def test_odd_texts():
    same(ODD)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), max_size=4))
def test_any_text(texts):
    same(texts)


@settings(max_examples=200, deadline=None)
@given(st.text("abrtnesi'. <|>", max_size=60))
def test_few_letters(text):
    same([text])


def test_small_cache_gives_equal_results():
    small = bpe.Codec(bpe.Vocabulary(bpe.default_path()), cache_pieces=5)
    texts = [t.encode() for t in ODD]
    for _ in range(2):
        for t in texts:
            assert small.encode([t]) == CODEC.encode([t])


def test_documents(spark, sf):
    rows = bpe.query(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = LIB.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(LIB.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "a"), (None, "Hello", "b"), (2, "", "c"), (2, "", "c")], "doc_id long, text string, n_tokens string")
    rows = bpe.encode_decode(df, bpe.default_path()).collect()
    assert sorted((str(r.doc_id), r.n_tokens, tuple(r.ids), r.decoded) for r in rows) == [("1", 0, (), ""), ("2", 0, (), ""), ("2", 0, (), ""), ("None", 1, (3306,), "hello</w>")]
    assert bpe.encode_decode(df.where("false"), bpe.default_path()).count() == 0


def test_other_files_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
