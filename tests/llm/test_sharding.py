import zlib

import pytest

from pulsegrid.llm import sharding


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 100, 1000, 4097])
def test_permutation_is_a_bijection(n):
    assert sorted(sharding.permute(x, n, 9) for x in range(n)) == list(range(n))


@pytest.mark.parametrize("n", [0, 1, 7, 333])
def test_columns_equal_plain_python_and_law_holds(spark, n):
    texts = ["", None, "é" * 7, "same"]
    rows = [(i * 3 - 50, texts[i % 4], "s") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    out = sorted(sharding.shard(docs, 16, seed=5).collect(), key=lambda r: r["doc_id"])
    assert [r["slot"] * 16 + r["shard"] for r in out] == [sharding.permute(i, n, 5) for i in range(n)]
    for r, (doc, text, _) in zip(out, rows):
        raw = (text or "").encode()
        assert (r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (doc, len(raw) + 1, zlib.crc32(raw), "rows", None)
    by_shard = {}
    for r in out:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    sizes = [len(by_shard.get(k, [])) for k in range(16)]
    assert max(sizes) - min(sizes) <= 1


def test_null_and_repeated_ids_get_own_slots(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "a"), (4, "b"), (4, "b"), (4, None)], "doc_id long, text string")
    out = sharding.shard(docs, 2, seed=1).collect()
    assert len({(r["shard"], r["slot"]) for r in out}) == 5


def test_same_rows_in_another_layout_get_the_same_places(spark):
    docs = spark.range(500).selectExpr("id as doc_id", "cast(id % 7 as string) as text")
    a = {tuple(r) for r in sharding.shard(docs.repartition(7), parts=3).collect()}
    assert a == {tuple(r) for r in sharding.shard(docs.orderBy("doc_id", ascending=False).coalesce(1), parts=5).collect()}
