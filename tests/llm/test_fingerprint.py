import hashlib

import numpy as np
import pytest

from pulsegrid.llm import fingerprint as fp


def texts_of(n, seed=0):
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{k}" + ("." if k % 5 == 0 else "\n" if k % 7 == 0 else "") for k in rng.integers(0, 300, rng.integers(0, 400))) for _ in range(n)]


def test_peeling_recovers_exactly_the_differing_digests():
    texts = texts_of(2) + ["same. same. same. other"] * 2
    texts[1] = texts[0][:-60] + " new words here"
    digests, offs = fp.pieces(texts)
    sets = [set(digests[offs[i] : offs[i + 1]].tolist()) for i in range(4)]
    assert len(sets[2]) == 4  # repeats keep their number
    both = fp.sketch(digests, offs, np.arange(4), np.full(4, 288))
    which, key, sign, clean = both.minus(np.array([0, 2, 1]), np.array([1, 3, 0])).peel()
    assert clean.all()
    for w, (a, b) in enumerate(((0, 1), (2, 3), (1, 0))):
        got = {(k, s) for i, k, s in zip(which.tolist(), key.tolist(), sign.tolist()) if i == w}
        assert got == {(k, 1) for k in sets[a] - sets[b]} | {(k, -1) for k in sets[b] - sets[a]}


def test_fingerprints_compare_by_themselves():
    texts = [*texts_of(40), "", "one", "same. same. same. other"]
    texts += [fp.edit(t, f) for t, f in zip(texts, texts[1:])]
    digests, offs = fp.pieces(texts)
    base, sets = fp.prints(digests, offs), [set(digests[i:j].tolist()) for i, j in zip(offs, offs[1:])]
    every = [base.text(i) for i in range(len(texts))]
    assert all(set(fp.digests_of(e).tolist()) == s for e, s in zip(every, sets))
    rng = np.random.default_rng(2)
    pairs = [(i, i + 43) for i in range(42)] + [tuple(rng.integers(0, len(texts), 2)) for _ in range(200)]
    for i, j in pairs:
        both = sets[i] | sets[j]
        assert fp.likeness(every[i], every[j]) == (len(sets[i] & sets[j]) / len(both) if both else 1.0)


def brute(rows):
    rows = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1] is not None, r[1] or ""))
    texts = [r[1] or "" for r in rows]
    out = []
    for i, (doc, _) in enumerate(rows):
        t, f = texts[i], texts[(i + 1) % len(rows)]
        e = t[: len(t) - len(t) // 3] + f[: len(t) // 3]
        digests, offs = fp.pieces([t, e, f])
        a, b, c = (set(digests[offs[k] : offs[k + 1]].tolist()) for k in range(3))
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        out.append((doc, len(t), hashlib.sha256(e.encode()).hexdigest(), round(like(a, b), 9), round(like(a, c), 9)))
    return sorted(out, key=str)


@pytest.mark.parametrize("case", ["many", "edges", "one", "none"])
def test_equals_brute_force_over_ranges(spark, case):
    rows = {
        "many": [(i * 7 % 1009, t) for i, t in enumerate(texts_of(300))],
        "edges": [(3, ""), (None, "x y"), (None, None), (9, "é" * 10), (9, "é" * 10), (-5, " \n "), (2, "a " * 60000)],
        "one": [(1, "only text. of its kind")],
        "none": [],
    }[case]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_chars string")
    out = fp.fingerprints(docs, parts=3).collect()
    got = sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in out), key=str)
    assert got == brute(rows)
    prints = {}
    for r in out:
        assert prints.setdefault((r["doc_id"], r["n_chars"]), r["fingerprint"]) == r["fingerprint"] or r["doc_id"] is None
    for r in out:
        assert fp.likeness(r["fingerprint"], r["edited_fingerprint"]) == r["near_edited"]
    following = sorted(out, key=lambda r: -(r["doc_id"] or 0))
    if case == "many":
        for r, f in zip(following, [*following[1:], following[0]]):
            assert fp.likeness(r["fingerprint"], f["fingerprint"]) == r["near_next"]
        assert len({r["fingerprint"] for r in out}) == len({t for _, t in rows})
