import numpy as np
import pyarrow as pa
import pytest

from pulsegrid.llm import language
from pulsegrid.llm.tables import fold

WORDS = {"aa": ["the", "ship", "was", "cold"], "bb": ["das", "schöne", "wüste"], "cc": ["où", "être", "vélo"]}


def greedy(text: bytes, learned: bytes) -> int:
    """Phrases by plain substring search."""
    n = at = 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at : end + 1] in learned:
            end += 1
        n += 1
        at = end
    return n


def test_automaton_accepts_exactly_the_substrings():
    text = b"abcbcabcca"
    nxt = language.suffix_automaton(text)
    subs = {text[i:j] for i in range(len(text)) for j in range(i, len(text) + 1)}
    rng = np.random.default_rng(0)
    for probe in [*subs, *(bytes(rng.choice(list(b"abc"), 4)) for _ in range(200))]:
        state = 0
        for c in probe:
            state = nxt[state].get(c, -1) if state >= 0 else -1
        assert (state >= 0) == (probe in subs)


@pytest.mark.parametrize("lane", [1, 7, 32, 512])
def test_phrases_equal_brute_force(lane):
    rng = np.random.default_rng(1)
    texts = {k: language.folded(" ".join(rng.choice(w, 40))) for k, w in WORDS.items()}
    texts["zz"] = b"a" * 300  # a parse that starts elsewhere never meets
    model = language.Model.build(texts, lane=lane)
    every = sum(WORDS.values(), [])
    docs = ["the ship", "", "x", "Où être, THE schöne 12 wüste! " * 9, "é", "a" * 2000, "ba" + "a" * 700 + "b" * 40 + "a" * 900]
    docs += [" ".join(rng.choice(every, rng.integers(0, 300))) for _ in range(30)] + ["".join(rng.choice(list("abéx the"), 900))]
    raw = [d.encode() for d in docs]
    offs = np.cumsum([0, *map(len, raw)])
    got, size = model.phrases(np.frombuffer(b"".join(raw), np.uint8), offs)
    for i, d in enumerate(docs):
        f = language.folded(d)
        assert size[i] == len(f)
        assert [greedy(f, texts[k]) for k in sorted(texts)] == got[:, i].tolist()


def test_model_stays_within_its_bound(spark):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(300)), f"l{i % 9}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, docs.doc_id >= 0, language.Params(table_bytes=1 << 20))
    assert len(model.langs) == 9 and model.step.nbytes <= 1 << 20


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(WORDS[k], 20)), k, "x") for i, k in enumerate(list(WORDS) * 60)]
    rows += [(500, None, "aa", "x"), (501, "12 !! 34", "aa", "x"), (502, "", None, "x"), (None, "the ship", None, "x"), (3, rows[3][1], "aa", "x"), (503, "— ★", None, "x"), (504, "the ship " * 30000, None, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_held_out_accuracy_and_edges(docs):
    held = fold("doc_id", 3) == 1
    model = language.fit(docs, ~held, language.Params(max_chars=2000))
    assert model.langs == list(WORDS)
    out = {(r["doc_id"]): r for r in language.identify(docs, model).collect()}
    assert all(out[i]["lang_pred"] == list(WORDS)[i % 3] for i in range(180))
    assert {out[i]["lang_pred"] for i in (500, 501, 502, 503)} == {"und"}
    assert out[None]["lang_pred"] == out[504]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert language.identify(docs.limit(0), model).count() == 0
    none = language.fit(docs.limit(0), ~held)
    assert {r["lang_pred"] for r in language.identify(docs, none).collect()} == {"und"}


def test_language_of_long_texts_only_is_learned(spark):
    rng = np.random.default_rng(4)
    words = {**WORDS, "dd": ["kala", "meri", "yksi", "joki"], "ee": ["zorg", "blik", "punt"]}
    rows = [(i, " ".join(rng.choice(words["aa"], 20)), "aa") for i in range(300)]
    rows += [(1000 + i, " ".join(rng.choice(words["dd"], 600)), "dd") for i in range(400)]  # each text is longer than max_chars
    rows += [(None, "12 " * 900 + "zorg blik punt", "ee")] * 400 + [(None, "77 !", "ee")] * 400  # equal rows; the letters come last
    rows += [(9000, "7 8 9", "ff"), (9001, "meri joki kala", None), (9002, "the ship was", None), (9003, "blik punt zorg", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, docs.doc_id.isNull() | (docs.doc_id < 9001), language.Params(max_chars=2000))
    assert model.langs == ["aa", "dd", "ee"]
    out = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs.where("lang is null"), model).collect()}
    assert out == {9001: "dd", 9002: "aa", 9003: "ee"}


def test_stretches_fill_the_room():
    assert language.fill(["a" * 90], 80) == ["a" * 80]
    assert [len(x) for x in language.fill(["a" * 90] * 20, 80)] == [10] * 8
    assert language.fill(["ab", "cde"], 80) == ["ab", "cde"]


def test_order_of_rows_does_not_matter():
    model = language.Model.build({"aa": b"the ship", "bb": b"das"}, lane=4)
    texts = ["the ship das", "das", ""]
    a, b = model.predict(pa.array(texts)), model.predict(pa.array(texts[::-1]))
    assert a[0] == b[0][::-1]
