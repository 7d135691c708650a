import random
import re
from collections import Counter

import pytest

from pulsegrid.llm import collocation

SCHEMA = "doc_id long, lang string, text string, phrase string, n long, gram string"


def plain_pieces(rows):
    for _, lang, text, *_ in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            yield "und" if lang is None else lang, [w for w in re.split("[ \t]", piece) if w]


def plain(rows, least, longest, top, cover):
    f, total = Counter(), Counter()
    for lang, ws in plain_pieces(rows):
        total[lang] += len(ws)
        for i in range(len(ws)):
            for k in range(1, min(longest, len(ws) - i) + 1):
                f[lang, tuple(ws[i : i + k])] += 1
    found = {g: n for g, n in f.items() if len(g[1]) > 1 and n >= least}
    dropped = {(lang, ws[i : i + j]) for (lang, ws), n in found.items() for j in range(2, len(ws)) for i in range(len(ws) - j + 1) if 100 * n >= cover * found[lang, ws[i : i + j]]}
    out = {}
    for (lang, ws), a in found.items():
        if (lang, ws) not in dropped:
            cuts = [(1000 * a * total[lang] // (f[lang, ws[:k]] * f[lang, ws[k:]]), k) for k in range(1, len(ws))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), a, f[lang, ws[:k]], f[lang, ws[k:]], total[lang], score))
    return sorted((lang, k + 1, r[2].decode(), *r[3:]) for lang, rs in out.items() for k, r in enumerate(sorted(rs)[:top]))


def texts(n, seed):
    rng = random.Random(seed)
    words = ["a", "B", "c", "d", "é", "ß", "x-y", "#", " w", "aa", "I'm", " "]
    fixed = ["one two three four five six seven eight nine ten eleven twelve", "a b a b a b a b a", "c c c c c c c c", "p q r s t u, v w p q r s t u"]
    for _ in range(n):
        if rng.random() < 0.3:
            yield rng.choice(fixed)
        else:
            yield "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", "\x0c;"]) for _ in range(rng.randrange(40)))


@pytest.mark.parametrize(("seed", "least", "longest", "top", "cover"), [(1, 3, 5, 2000, 100), (2, 6, 4, 25, 60), (3, 2, 2, 10, 100), (4, 40, 6, 2000, 90)])
def test_equals_plain_counts(spark, seed, least, longest, top, cover):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["en", "en", "de", None, "und", ""]), t, "p", 1, "g") for i, t in enumerate(texts(150, seed))]
    rows += [(None, "en", None, "p", 1, "g"), (1, "en", "", "p", 1, "g"), (1, "fr", " .\t", "p", 1, "g"), (2, "long", "k l " * 6000 + "m" * 5000 + " k l", "p", 1, "g")] + rows[:10]
    out = collocation.collocations(spark.createDataFrame(rows, SCHEMA).repartition(3), least, longest, top, cover)
    assert sorted(map(tuple, out.collect())) == plain(rows, least, longest, top, cover)


def test_empty_tables_and_tables_without_words(spark):
    for rows in ([], [(1, None, None, "p", 1, "g"), (2, "en", " . ", "p", 1, "g")]):
        assert collocation.collocations(spark.createDataFrame(rows, SCHEMA), 1).count() == 0


def test_paths_are_compacted_and_cut_into_bounded_rows(spark):
    line = " ".join(f"w{i}" for i in range(700))
    rows = [(1, "en", f"{line}. {line}. x y z w0 w1 w2 w3 w4", "p", 1, "g"), (2, "en", "o p o p o p o p o p o p o p", "p", 1, "g"), (3, "en", "A b c d e f! g a b c d e f; a b c d e", "p", 1, "g")]
    graph = collocation.Graph(spark.createDataFrame(rows, SCHEMA), least=2)
    got = {(r["passage"], r["words"], r["n"]) for r in collocation.passages(graph).collect()}
    whole = [p for p in got if "w9 " in p[0] or "w600 " in p[0] or "w300 " in p[0]]
    assert {w for *_, w in whole} == {2} and all(w <= collocation.SEGMENT + 4 for _, w, _ in got)
    edges = {p for text, words, _ in got for k in range(words - 4) for p in [tuple(text.split()[k : k + 5])]}
    assert edges == {tuple(f"w{i + j}" for j in range(5)) for i in range(696)} | {("o", "p", "o", "p", "o"), ("p", "o", "p", "o", "p"), tuple("abcde"), tuple("bcdef")}
    assert ("a b c d e", 5, 3) in got and ("b c d e f", 5, 2) in got  # unequal weights are not joined


def test_pairs_that_share_a_bit_change_no_count(spark, monkeypatch):
    monkeypatch.setattr(collocation, "hashes", lambda names: collocation.np.zeros(len(names), collocation.np.uint64))  # in this process only: the driver's part
    rows = [(i, "en", t, "p", 1, "g") for i, t in enumerate(texts(60, 9))]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"lang": [r[1] for r in rows], "text": [r[2] for r in rows]})

    class All:
        value = bytes([255]) * (1 << collocation.FILTER_BITS - 3)

    counts = Counter()
    for out in collocation.edges(All, 5, 7)([batch]):
        for part in set(out.column("part").to_pylist()):
            found = collocation.merged((part,), pa.table(out).filter(pa.compute.equal(pa.table(out).column("part"), part)))
            for g, k, n in zip(*(found.column(c).to_pylist() for c in ("gram", "words", "n"))):
                for j in range(2, k + 1):
                    counts[" ".join(g.split(" ")[:j])] += n
    want = Counter(" ".join(ws[i : i + k]) for _, ws in plain_pieces(rows) for i in range(len(ws)) for k in range(2, 6) if i + k <= len(ws))
    assert counts == want
