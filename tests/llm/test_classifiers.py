import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import quality, sample, textvec, toxicity
from pulsegrid.llm.tables import fold

BAD = ["idiot", "scum", "trash"]


def corpus(n=600, seed=0):
    rng = np.random.default_rng(seed)
    docs, labels = [], []
    for i in range(n):
        words = [f"w{k}" for k in rng.integers(0, 400, rng.integers(5, 60))]
        toxic, poor = int(i % 4 == 0), int(i % 5 == 0)
        if toxic:
            words.insert(rng.integers(0, len(words)), BAD[i % 3])
        if poor:
            words = [w.upper() + "!!" for w in words]
        docs.append((i, " ".join(words), "x"))
        labels.append((i, 1 - poor, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    docs += [(1000, None, "x"), (1001, "", "x"), (None, "w1 idiot", "x"), (3, docs[3][1], "x"), (1002, "idiot " * 40000, "x")]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity_held_out_and_edges(tables):
    docs, labels = tables
    params = toxicity.Params(l1=1.0, shards=2)
    model = toxicity.fit(docs, labels, fold("doc_id", 5) != 0, params=params)
    assert 0 < len(model.at) < 3000  # compact
    out = toxicity.score(docs, model).withColumn("held", fold("doc_id", 5) == 0).collect()
    assert len(out) == docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    held = [r for r in out if r["held"] and r["doc_id"] is not None and r["doc_id"] < 600]
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 == 0) for r in held]) > 0.9
    by = {r["doc_id"]: r["score"] for r in out}
    assert by[1000] == by[1001] and by[1002] > 0.5


def test_toxicity_score_is_the_sum_of_distinct_features():
    p = toxicity.Params(bits=12)
    rng = np.random.default_rng(1)
    model = toxicity.Model(p, np.arange(1 << 12), rng.normal(size=1 << 12), -1.0)
    texts = ["a b a b c", "", "One  two, THREE", "é à x"]
    for t, s in zip(texts, model.score(pa.array(texts))):
        _, h, _, _ = textvec.words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
        at = {int(textvec.mix(h[i : i + 1], 1)[0]) >> 52 for i in range(len(h))}
        for gap, salt in ((1, 2), (2, 3)):
            at |= {int(textvec.mix(h[i : i + 1] * np.uint64(0x9E3779B97F4A7C15 | 1) + h[i + gap : i + gap + 1], salt)[0]) >> 52 for i in range(len(h) - gap)}
        assert s == pytest.approx(1 / (1 + np.exp(1.0 - sum(model.weight[a] for a in at))))


def test_nothing_labelled_and_empty_tables(tables):
    docs, labels = tables
    for fit, score in ((lambda d: toxicity.fit(d, labels.limit(0), F.lit(True)), toxicity.score), (lambda d: quality.fit(d, labels.limit(0), F.lit(True), quality.editorial_grade()), quality.score)):
        assert score(docs, fit(docs)).count() == docs.count()
        assert score(docs.limit(0), fit(docs.limit(0))).count() == 0


def test_quality_keeps_sound_documents(tables):
    docs, labels = tables
    model = quality.fit(docs, labels, fold("doc_id", 5) != 0, quality.editorial_grade(), quality.Params(shards=2, passes=6))
    assert np.all(np.diff(model.thresholds) > 0)
    out = quality.score(docs, model).withColumn("held", fold("doc_id", 5) == 0).collect()
    held = [r for r in out if r["held"] and r["doc_id"] is not None and r["doc_id"] < 600]
    assert np.mean([r["keep"] == (r["doc_id"] % 5 != 0) for r in held]) > 0.95
    for r in out:
        assert r["p_ge_1"] >= r["p_ge_2"] and r["expected_grade"] == pytest.approx(r["p_ge_1"] + r["p_ge_2"])


def test_ordinal_gradient_is_that_of_the_likelihood():
    """One AdaGrad step moves every coordinate along the sign of a finite difference of the likelihood."""
    p = quality.Params(bits=8, l2=0.0, passes=1)
    m = 1 << p.bits
    text, rng = "some Words 12 here!!", np.random.default_rng(0)

    def loss(state, grade):
        model = quality.Model(p, state[0, :m], quality.thresholds(state[0, m:]))
        e, *tails = model.score(pa.array([text]))
        probs = np.concatenate([[1.0], np.ravel(tails), [0.0]])
        return np.log(probs[grade] - probs[grade + 1])

    for grade in range(3):
        state = np.vstack([rng.normal(size=m + 2) * 0.3, np.zeros(m + 2)])
        moved = quality._step(p)([text], np.array([float(grade)]), state.copy())[0] - state[0]
        for j in np.flatnonzero(np.abs(moved) > 1e-6):
            up = state.copy()
            up[0, j] += 1e-6
            assert np.sign(loss(up, grade) - loss(state, grade)) == np.sign(moved[j])


def plain_quality_features(text, bits):
    """{coordinate: root of its share} from words, their shapes and one coordinate for words said twice in a row, a word at a time."""
    _, h, s, e = textvec.words(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]), textvec.TOKEN)
    buf = np.frombuffer(text.encode(), np.uint8)
    counts = {}
    for i in range(len(h)):
        word = int(textvec.mix(h[i : i + 1], 5)[0]) >> (65 - bits)
        shape = int(textvec.mix(textvec.shapes(buf, np.array([0, len(buf)]), s[i : i + 1], e[i : i + 1]), 6)[0]) >> (65 - bits) | 1 << (bits - 1)
        for at in (word, shape, *([3] if i and h[i] == h[i - 1] else [])):
            counts[at] = counts.get(at, 0) + 1
    return {at: (n / len(h)) ** 0.5 for at, n in counts.items()}


def test_quality_score_is_the_sum_of_weighted_shares():
    p = quality.Params(bits=10)
    rng = np.random.default_rng(2)
    model = quality.Model(p, rng.normal(size=1 << p.bits), np.array([-0.4, 0.9]))
    texts = ["one two two TWO 12!", "", "é à, é é", "a " * 50]
    expected, *tails = model.score(pa.array(texts))
    for k, t in enumerate(texts):
        total = sum(model.weight[at] * x for at, x in plain_quality_features(t, p.bits).items())
        want = [1 / (1 + np.exp(c - total)) for c in model.thresholds]
        assert [x[k] for x in tails] == pytest.approx(want) and expected[k] == pytest.approx(sum(want))


def test_quality_training_equals_the_update_written_out():
    """All passes of a shard, coordinate by coordinate: AdaGrad on log(P(>= grade) - P(> grade)), thresholds as a first one and log gaps."""
    p = quality.Params(bits=9, passes=2)
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{j}" for j in rng.integers(0, 20, rng.integers(1, 9))) + ("!!" if i % 3 == 0 else "") for i in range(40)]
    y = np.array([float(i % 3) for i in range(40)])
    m = 1 << p.bits
    start = np.zeros((2, m + 2))
    start[0, m] = -2.0
    got = quality._step(p)(texts, y, start.copy())
    w, g2, raw, raw2 = {}, {}, [-2.0, 0.0], [0.0, 0.0]
    sig = lambda z: 1 / (1 + np.exp(-z))
    for k in range(p.passes):
        for i in np.random.default_rng(k).permutation(len(texts)):
            x, grade = plain_quality_features(texts[i], p.bits), int(y[i])
            s, cut = sum(w.get(a, 0.0) * v for a, v in x.items()), [raw[0], raw[0] + np.exp(raw[1])]
            up = sig(s - cut[grade - 1]) if grade else 1.0
            down = sig(s - cut[grade]) if grade < 2 else 0.0
            moved = {a: max(-1, min(1, 1 - up - down)) * v - p.l2 * w.get(a, 0.0) for a, v in x.items()}
            d_cut = [0.0, 0.0]
            if grade:
                d_cut[grade - 1] -= up * (1 - up) / max(up - down, 1e-9)
            if grade < 2:
                d_cut[grade] += down * (1 - down) / max(up - down, 1e-9)
            d_raw = [max(-1, min(1, d_cut[0] + d_cut[1])), max(-1, min(1, d_cut[1] * np.exp(raw[1])))]
            for a, g in moved.items():
                g2[a] = g2.get(a, 0.0) + g * g
                w[a] = w.get(a, 0.0) + p.rate * g / np.sqrt(g2[a] + 1e-8)
            for j in range(2):
                raw2[j] += d_raw[j] ** 2
                raw[j] += p.rate * d_raw[j] / np.sqrt(raw2[j] + 1e-8)
    assert len(w) > 20 and [got[0, a] for a in w] == pytest.approx(list(w.values()), abs=1e-9)
    assert got[0, m:].tolist() == pytest.approx(raw, abs=1e-9) and not [a for a in np.flatnonzero(got[0, :m]) if a not in w]


def test_conflicting_labels_teach_nothing(spark):
    """Of ids with several labels only those that agree are used; an id of several documents teaches by the least text."""
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (3, None), (None, "n"), (4, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (3, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    got = sample.labelled(docs, labels, F.col("toxic").cast("double"), F.lit(True), 10, "doc_id", "text").collect()
    assert sorted((r["text"], r["y"]) for r in got) == [("", 0.0), ("a", 1.0)]


def test_training_equals_plain_ftrl():
    """One shard's passes against the update rule written out coordinate by coordinate."""
    p = toxicity.Params(bits=12, l1=0.3, passes=2)
    rng = np.random.default_rng(11)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 30, rng.integers(0, 12))) + (" scum" if i % 3 == 0 else "") for i in range(60)]
    y = np.array([float(i % 3 == 0) for i in range(60)])
    bias, z, n = 1 << p.bits, {}, {}
    for k in range(p.passes):
        for i in np.random.default_rng(k).permutation(len(texts)):
            _, _, buf, offs = next(textvec.blocks(pa.array([texts[i]], pa.large_string())))
            at = [*toxicity.features(buf, offs, p.bits)[1].tolist(), bias]
            w = {}
            for c in at:
                zc, nc, l1 = z.get(c, 0.0), n.get(c, 0.0), 0.0 if c == bias else p.l1
                w[c] = 0.0 if abs(zc) <= l1 else -(zc - np.sign(zc) * l1) / ((p.beta + nc**0.5) / p.alpha + p.l2)
            g = 1 / (1 + np.exp(-sum(w.values()))) - y[i]
            for c in at:
                nc = n.get(c, 0.0)
                z[c] = z.get(c, 0.0) + g - ((nc + g * g) ** 0.5 - nc**0.5) / p.alpha * w[c]
                n[c] = nc + g * g
    got = toxicity._step(p)(texts, y, np.zeros((2, bias + 1), np.float32))
    kept = [c for c in z if abs(z[c]) > p.l1 / 4 + 1e-3 or c == bias]
    assert len(kept) > 50
    assert [got[0, c] for c in kept] == pytest.approx([z[c] for c in kept], abs=1e-3)
    assert [got[1, c] for c in kept] == pytest.approx([n[c] for c in kept], abs=1e-3)
    assert not [c for c in np.flatnonzero(got[0]) if c not in z]
