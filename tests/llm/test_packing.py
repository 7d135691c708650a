import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from pulsegrid.llm import packing

PATH = P.path("word_bpe_49k.json")


def reference_ids(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]


ODD = ["", None, "a", "Don't stop, it's 1/2 ½ of 3²", "İstanbul Σίσυφος ΟΔΟΣ", "é J̌ x\x1cy z", "<|endoftext|> and <|startoftext|>x", "字 漢字 العربية", "''s 'll' \t tab", "word " * 5000, "x" * 3000, "ªº µ× ÷ ǰ"]


def test_word_tokenizer_equals_library():
    tok = Tokenizer.from_file(PATH)
    mine = packing.WordTokenizer(PATH)
    for text, ids in zip(ODD, mine.encode([t or "" for t in ODD])):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(text or "", add_special_tokens=False).ids, text


@pytest.mark.parametrize("rows", [[], [(i, t) for i, t in enumerate(ODD)] + [(None, "tail"), (3, "again"), (3, "again")]])
def test_pieces_cover_documents_once(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "body")
    docs = docs.selectExpr("doc_id", "body as text", "doc_id as start", "'x' as sequence_id")
    out = [r.asDict() for r in packing.pack(docs, PATH, window=256).collect()]
    tok = Tokenizer.from_file(PATH)
    want = sorted((str(d), len(reference_ids(tok, t))) for d, t in rows)
    assert sum(r["length"] for r in out) == sum(n for _, n in want)
    by_doc = {d: t for d, t in rows}
    for r in out:
        if r["doc_id"] not in (None, 3):
            ids = reference_ids(tok, by_doc[r["doc_id"]])
            assert r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes())
    fills = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fills.get(r["sequence_id"], 0)
        fills[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(f <= 256 for f in fills.values())


@pytest.mark.parametrize("unit", [1, 4])
def test_sum_of_squares_picks_the_least_sum(unit):
    rng = np.random.default_rng(3)
    w = 64
    bins, top = packing.SumOfSquares(w, unit, most_open=10**9), w // unit
    for size in rng.integers(1, w, 400).tolist():
        n, fill = bins.count.copy(), bins.fill.copy()
        costs = []
        for h in range(top + 1):
            if fill[h] + size <= w:
                m, to = n.copy(), -(-int(fill[h] + size) // unit)
                m[h] -= h > 0
                m[to] += to < top
                costs.append(int((m[1:top] ** 2).sum()))
        bins.place(size, None)
        assert int((bins.count[1:top] ** 2).sum()) == min(costs)
    assert [x for x in bins.full() if x[0] == "rule"]


def test_open_windows_are_bounded_and_nothing_is_lost():
    rng = np.random.default_rng(4)
    bins, sizes, out = packing.SumOfSquares(256, 4, most_open=5), rng.integers(1, 256, 700).tolist(), []
    for i, size in enumerate(sizes):
        bins.place(size, (i, 0, b"abcd" * size, size))
        assert bins.n_open <= 5
        out += bins.full()
    out += bins.drain()
    assert {why for why, *_ in out} >= {"rule", "bound"}
    for _, pieces, size in out:
        n = sum(length for _, length in pieces)
        assert n <= size and size - n < 4 and (size == 256 or n == size == 1 << (n.bit_length() - 1))
    starts = sorted((p[0], p[1], length) for _, pieces, _ in out for p, length in pieces)
    at = {}
    for doc, start, length in starts:
        assert at.get(doc, 0) == start
        at[doc] = start + length
    assert at == dict(enumerate(sizes))


SPACES = [" ", "\u0085", "\u00a0", "\u1680", *map(chr, range(0x2000, 0x2010)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000", "\ufeff", "\x1c", "\t", "\n"]


def test_odd_white_space_with_a_fresh_and_a_warm_cache():
    tok, rng = Tokenizer.from_file(PATH), np.random.default_rng(6)
    texts = ["".join(rng.choice(["a", "b", "the", "é", ".", "7", *SPACES], rng.integers(1, 12))) for _ in range(3000)]
    warm = packing.WordTokenizer(PATH)
    for _ in range(2):
        for t, ids in zip(texts, warm.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, ascii(t)
    one = packing.WordTokenizer(PATH)
    for t in texts[:300]:
        assert np.frombuffer(one.encode([t])[0], "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, ascii(t)


def test_generations_of_known_words(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_BYTES", 2000)
    tok, mine = Tokenizer.from_file(PATH), packing.WordTokenizer(PATH)
    for k in range(40):
        text = f"again word{k} and {'x' * 300} é\u00a0{k}"
        assert np.frombuffer(mine.encode([text])[0], "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids
    assert len(mine.known) + len(mine.older) < 60 and not [w for w in mine.known if len(w) > packing.KEPT_CHARS]


def test_padding_does_not_grow_with_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(64)
    out = packing.pack(docs, PATH).groupBy("sequence_id", "padded_to").agg({"length": "sum"}).collect()
    assert sum(r["padded_to"] for r in out) - sum(r["sum(length)"] for r in out) < packing.UNIT * len(out)
    assert all(r["padded_to"] in (2048, r["sum(length)"]) for r in out)
