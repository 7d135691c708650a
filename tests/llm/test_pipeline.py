import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from pulsegrid.llm.tables import read
from tests.llm.test_linededup import brute as brute_lines
from tests.llm.test_neardup import brute as brute_near

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = read(spark, SF, "documents"), []
    for name, stage in cp.STAGES:
        result = stage(spark, docs, SF)
        rows = result.collect()
        out.append((name, docs.collect(), rows, result.columns))
        docs = spark.createDataFrame(rows, result.schema)
    return out


def test_stages_keep_the_columns(steps):
    assert [n for n, *_ in steps] == ["toxicity", "quality", "line dedup", "near dedup", "packing"]
    for name, before, after, columns in steps[:-1]:
        assert columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}


def test_filters_follow_the_labels(spark, steps):
    labels = {r["doc_id"]: r for r in read(spark, SF, "labels").collect()}
    (_, before, after, _), (_, before_q, after_q, _) = steps[:2]
    gone, poor = ({r["doc_id"] for r in b} - {r["doc_id"] for r in a} for b, a in ((before, after), (before_q, after_q)))
    assert not [d for d in gone if d in labels and not labels[d]["toxic"]]
    assert not [d for d in poor if d in labels and labels[d]["quality"]]


def test_lines_and_near_copies_equal_brute_force(steps):
    _, before, after, _ = steps[2]
    want = brute_lines([(r["doc_id"], r["text"]) for r in before], 50)
    assert {r["doc_id"]: r["text"] for r in after} == {d: t for (d, _), (t, n, gone) in want.items() if not gone or gone < n}
    assert all(r["n_chars"] == len(r["text"]) for r in after)
    _, before, after, _ = steps[3]
    assert sorted(str(r["doc_id"]) for r in after) == sorted({c for _, c in brute_near([(r["doc_id"], r["text"]) for r in before])})


def test_packing_holds_every_token_once(steps):
    _, before, after, _ = steps[4]
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = {r["doc_id"]: len(tok.encode(r["text"], add_special_tokens=False).ids) + 1 for r in before}
    got = {}
    for r in after:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want


def test_run_equals_the_stages(spark, steps):
    got = cp.run(spark, SF).collect()
    assert sum(r["length"] for r in got) == sum(r["length"] for r in steps[4][2])
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in steps[4][2]}


CLASHES = "toxic_score string, quality_1 string, lines_before string, lines_removed long, class_id string, row int"


def test_odd_rows_pass_every_stage(spark):
    """Nulls in any column, empty and blank texts, a very long one, repeated rows and columns of the stages' own names."""
    good = [r for r in read(spark, SF, "documents").join(read(spark, SF, "labels").where("quality = 1 and toxic = 0"), "doc_id").orderBy("doc_id").limit(4).collect()]
    line = " ".join(f"w{k}" for k in range(60))
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in good]
    rows += [rows[0], rows[0], (90001, None, None, None, None), (None, None, "en", "s", 0), (None, "a text of its own", None, None, 17), (90002, "", "en", None, 0), (90003, " \n ", "en", "s", 3)]
    rows += [(90004, line, "en", "s", len(line)), (90005, line + "\nown words", "en", "s", None), (90006, "word " * 40_000, None, "s", 200_000)]
    extra = ("x", "y", "z", 7, "c", 5)
    docs = spark.createDataFrame([(*r, *extra) for r in rows], f"doc_id long, text string, lang string, source string, n_chars int, {CLASHES}")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF).collect()
        assert all(tuple(r)[5:] == extra for r in out), name
        ids = [r["doc_id"] for r in out]
        assert {r[0] for r in rows[:4]} | {90001} <= set(ids), name
        assert [r["text"] for r in out if r["doc_id"] == 90001] == [None]
        assert ids.count(rows[0][0]) == (1 if name == "near dedup" else 3), name
        empty = stage(spark, docs.limit(0), SF)
        assert empty.columns == docs.columns and empty.count() == 0
    cut = {r["doc_id"]: r for r in cp.cut_repeated_lines(spark, docs, SF).collect()}
    assert 90005 in cut and cut[90005]["text"] == "own words" and cut[90005]["n_chars"] == len("own words") and cut[90004]["text"] == line
    near = cp.keep_one_copy(spark, docs, SF).collect()
    assert sum(r["text"] is None for r in near) == 2 and sum(r["text"] == "" for r in near) == 1
    packed = cp.pack(spark, docs, SF).collect()
    assert sum(r["length"] for r in packed if r["doc_id"] == 90001) == 1 and cp.pack(spark, docs.limit(0), SF).count() == 0
