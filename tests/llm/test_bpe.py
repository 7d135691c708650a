import hashlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pulsegrid.llm import bpe

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def pair():
    return bpe.PrefixEncoder(PATH), Tokenizer.from_file(PATH)


def ids_of(enc, text):
    return np.frombuffer(enc.encode(text), "<u4").tolist()


ODD = ["", " ", "  \n\n  x", "Don't we'll 'S", "a\x1cb\x1d c\x85d\xa0e", "<|endoftext|>", "x<|endoftext|> y<|endoftext|>", "字漢字 العربية 🙂🙂", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "=" * 300, " " * 500 + "z", "½²ªº", "İΣς", "​﻿é", "1234567 89", "\t\tif (x) {\r\n"]


def test_equals_library_on_odd_texts(pair):
    enc, tok = pair
    for text in ODD:
        want = tok.encode(text, add_special_tokens=False).ids
        assert ids_of(enc, text) == want, text
        assert enc.decode(enc.encode(text)) == tok.decode(want, skip_special_tokens=False)


def test_every_character_of_the_basic_plane(pair):
    enc, tok = pair
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)} 1" for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    for t, e in zip(texts, tok.encode_batch(texts, add_special_tokens=False)):
        assert ids_of(enc, t) == e.ids, repr(t)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aAeht ins'.,\n1éß<|>"), max_size=60))
def test_equals_library_on_random_texts(pair, text):
    enc, tok = pair
    assert ids_of(enc, text) == tok.encode(text, add_special_tokens=False).ids


def test_query_form(spark, pair):
    _, tok = pair
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] + [(None, None, "x"), (1, " ", "x")], "doc_id long, text string, n_tokens string")
    out = bpe.digests(docs, PATH).collect()
    assert len(out) == len(ODD) + 2
    for r in out:
        text = ODD[r["doc_id"]] if r["doc_id"] is not None else ""
        ids = tok.encode(text, add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.digests(docs.limit(0), PATH).count() == 0
    assert sorted(len(r["ids"]) for r in bpe.encode(docs, PATH).collect()) == sorted(r["n_tokens"] for r in out)


def test_caches_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 20_000)
    enc, plain = bpe.PrefixEncoder(PATH), bpe.PrefixEncoder(PATH)
    rng = np.random.default_rng(0)
    texts = [" ".join("".join(map(chr, rng.integers(97, 123, 8))) for _ in range(20)) for _ in range(60)]
    most = 0
    for t in texts:
        got = enc.encode(t)
        most = max(most, enc.known.held)
        monkeypatch.setattr(bpe, "CACHE_BYTES", 1 << 30)
        assert got == plain.encode(t)
        monkeypatch.setattr(bpe, "CACHE_BYTES", 20_000)
    assert most < 40_000 and plain.known.held > 200_000
