import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import topk


def brute(rows, is_query, k):
    ok = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v in ok:
        if is_query(i):
            s = sorted(((-sum(a * b for a, b in zip(v, w)), j) for j, w in ok if j != i))[:k]
            out += [(i, r + 1, j, -d) for r, (d, j) in enumerate(s)]
    return sorted(out)


def rows_of(kind, n, rng):
    if kind == "ties":
        return [(i, [float(x) for x in rng.integers(-1, 2, 4)]) for i in range(n)]
    if kind == "clustered":  # strong components: queries stop early
        return [(i, [float(10 * (j == i % 6) + rng.normal() * 0.05) for j in range(6)]) for i in range(n)]
    return [(i, [float(x) for x in rng.normal(size=6)]) for i in range(n)]


@pytest.mark.parametrize("kind", ["ties", "clustered"])
@pytest.mark.parametrize("n", [5, 400])
def test_equals_brute_force(spark, kind, n):
    rows = rows_of(kind, n, np.random.default_rng(n))
    rows += [(9000, None), (9001, [1.0, None]), (9002, [float("nan"), 1.0]), (None, [1.0, 2.0]), (9020, [0.0] * 6), (9040, [2.0]), (9060, [float("inf")])] if n else []
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = topk.search(topk.integer_vectors(df), F.col("vec_id") % 20 == 0, k=7, row_block=90, query_block=9)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 20 == 0, 7)


@pytest.mark.parametrize("query_block", [4, 900])
def test_repeated_query_rows_are_one_query(spark, query_block):
    """Query 20 comes 20 times, query 40 with two vectors; a candidate row counts once, with its best score, and equal candidates each."""
    rng = np.random.default_rng(7)
    rows = [(i, [int(x) for x in rng.integers(-9, 10, 6)]) for i in range(300)]
    rows += [rows[20]] * 19 + [(40, [-x for x in rows[40][1]])] + [rows[33]]
    want = []
    for qid in sorted({i for i, _ in rows if i % 20 == 0}):
        own = [v for i, v in rows if i == qid]
        best = sorted((-max(sum(a * b for a, b in zip(v, w)) for v in own), j) for j, w in rows if j != qid)[:20]
        want += [(qid, r + 1, j, -d) for r, (d, j) in enumerate(best)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = topk.search(df, F.col("vec_id") % 20 == 0, k=20, row_block=90, query_block=query_block)
    assert sorted(map(tuple, got.collect())) == want


def test_bound_stops_early_on_clustered_rows():
    rng = np.random.default_rng(5)
    x = np.floor(64 * np.array([v for _, v in rows_of("clustered", 3000, rng)]))
    lists = topk.SortedLists(np.arange(3000), x)
    stops = [lists.walk(i, x[i], 5) for i in range(50)]
    assert all(why == "bound" and depth < 1500 for *_, why, depth in stops)
    for i, (at, score, *_) in enumerate(stops):
        every = np.delete(x @ x[i], i)
        assert np.sort(score)[::-1][:5].tolist() == np.sort(every)[::-1][:5].tolist()
        at, score, why, depth = lists.walk(i, x[i], 5, float(every.max()) + 1)  # k better rows are known: the walk ends sooner
        assert not len(at) and depth <= stops[i][3]


def test_walk_ends_when_no_row_is_unseen():
    x = np.random.default_rng(9).integers(-30, 31, (2000, 40)).astype(float)
    lists = topk.SortedLists(np.arange(2000), x)
    at, score, why, depth = lists.walk(0, x[0], 20)
    assert why in ("seen", "bound") and depth < 2000
    assert np.sort(score)[::-1][:20].tolist() == np.sort((x @ x[0])[1:])[::-1][:20].tolist()


def test_large_numbers_are_exact(spark):
    rows = [(i, [2**25 + i, -(2**20) * i, 7]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = topk.search(df, F.col("vec_id") == 20, k=3).collect()
    want = sorted((-sum(a * b for a, b in zip(rows[20][1], v)), i) for i, v in rows if i != 20)[:3]
    assert [(-r["score"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(topk.integer_vectors(df), F.col("vec_id") % 20 == 0).count() == 0
