"""BPE against the tokenizers library."""

import hashlib
import struct

import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer
from weekwise.llm import bpe
from weekwise.llm.registry import QUERIES

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
REFERENCE = Tokenizer.from_file(PATH)
ODD = [
    "", None, " ", "it's we'll I'VE done'd", "ΑΣ ΣΑΣ İstanbul ẞß", "éä ẛ̣ ﬁ", "a<|endoftext|>b <|startoftext|><|ENDOFTEXT|>",
    "x" * 5000, "ab" * 4000, "1234½Ⅷ ٣", "🙂👩‍👩‍👧 ...!!??---", " a　b\u0085c​d", "日本語 한국어 ไทย हिन्दी", "a\x00b\x1fc﻿",
    "tab\tnew\nline\r\x0b\x0c", "<|endoftext|>", "aaaaaaaaaaaaaaaaaaaaaa aaaaaaaaaaaaaa",
]


def expected(text):
    e = REFERENCE.encode(text or "", add_special_tokens=False)
    return e.ids, REFERENCE.decode(e.ids, skip_special_tokens=False)


def test_odd_texts(docs):
    got = {r.doc_id: (r.ids, r.decoded, r.n_tokens) for r in bpe.bpe_encode(docs(ODD), PATH).collect()}
    for i, text in enumerate(ODD):
        ids, decoded = expected(text)
        assert got[i] == (ids, decoded, len(ids)), text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    model = bpe.load(PATH)
    ids = model.encode(text)
    assert (ids, model.decode(ids)) == expected(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("abtheés'1.,!~日 \n"), max_size=70), max_size=8))
def test_words_together(texts):
    """Words encoded side by side, those of over 64 bytes apart, and caches that turn over at once."""
    model = bpe.Bpe(PATH)
    for most in (bpe.CACHED_BYTES, 0):
        model.held += most == 0
        for _ in range(2):
            got = [([int.from_bytes(ids[k : k + 4], "little") for k in range(0, len(ids), 4)], decoded) for ids, decoded in model.encode_all(texts)]
            assert got == [expected(t) for t in texts]
            if not most:
                model.held = bpe.CACHED_BYTES + 1


def test_query_and_repeated_rows(spark, docs):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = QUERIES["op10_bpe_encoding"](spark, sf).collect()
    assert len(found) == len(texts)
    for r in found:
        ids, decoded = expected(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.bpe_encode(docs(["a", "a"], [None, None]), PATH).count() == 2
    assert bpe.bpe_encode(docs([]), PATH).count() == 0
