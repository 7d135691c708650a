import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, H string, grp string, pos int"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(hashes, fanout):
    """(root, the siblings of every node as (before, after) from the bottom up)."""
    paths, at, level = [[] for _ in hashes], list(range(len(hashes))), hashes
    while len(level) > 1:
        for i, k in enumerate(at):
            run = level[k - k % fanout : k - k % fanout + fanout]
            paths[i].append(("".join(run[: k % fanout]), "".join(run[k % fanout + 1 :])))
        level = [sha("".join(level[k : k + fanout])) for k in range(0, len(level), fanout)]
        at = [k // fanout for k in at]
    return level[0], paths


def plain(rows, shown, fanout):
    if not rows:
        return []
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r[:5]), leaf(shown(r)[:5])))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([g[2] for g in sorted(groups[s])], fanout) for s in names}
    root, tops = plain_tree([trees[s][0] for s in names], fanout)
    out = []
    for s, top in zip(names, tops):
        for g, path in zip(sorted(groups[s]), trees[s][1]):
            h = g[3]
            for before, after in path + top:
                h = sha(before + h + after)
            out.append((g[1] if g[0] else None, g[2], trees[s][0], root, sha("".join(b + a for b, a in path + top)), h, h == root))
    return out


@pytest.mark.parametrize(("n", "fanout"), [(0, 3), (1, 3), (4, 3), (40, 2), (250, 3), (100, 5)])
def test_equals_plain_trees(spark, n, fanout):
    rng = random.Random(n)
    texts = [None, "", "a\nb", "no line end", "é\n" * 5000]
    rows = [(rng.choice([None, i, i, i // 2]), rng.choice([None, "", "s", "s", "s", "é", "~", f"x{i % 7}"]), rng.choice([None, "en"]), rng.choice([None, i]), rng.choice(texts), "h", "g", 1) for i in range(n)]
    rows += rows[: n // 3]  # repeated rows
    even = lambda r: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
    shown = lambda r: (*r[:4], r[4].replace("\n", "") if even(r) and r[4] is not None else r[4])
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    out = manifest.verify(manifest.build(spark.createDataFrame(rows, SCHEMA), {"text": tampered}, fanout))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    key = lambda r: tuple((v is not None, v if v is not None else 0) for v in r)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(plain(rows, shown, fanout), key=key)


def test_untouched_rows_verify_and_any_changed_field_is_found(spark):
    docs = spark.createDataFrame([(i, f"s{i % 4}", "en", i, f"t{i}") for i in range(50)], "doc_id long, source string, lang string, n_chars int, text string")
    assert all(r["verified"] for r in manifest.verify(manifest.build(docs)).collect())
    for field in ("source", "lang", "n_chars", "text"):
        out = manifest.verify(manifest.build(docs, {field: F.when(F.col("doc_id") == 7, None).otherwise(F.col(field))}))
        assert [r["doc_id"] for r in out.where("not verified").collect()] == [7]


def test_numbers_have_no_gaps_whatever_the_partitions(spark):
    from pulsegrid.llm.scratch import Scratch

    rows = spark.range(2000).selectExpr("case when id % 3 = 0 then 'a' else concat('b', id % 50) end as grp", "id % 40 as k")
    got = {}
    for r in manifest.number_within(rows.repartition(7), ["k"], Scratch(spark, "t")).collect():
        got.setdefault(r["grp"], []).append((r["pos"], r["k"], r["n"]))
    for g in got.values():
        g.sort()
        assert [p for p, *_ in g] == list(range(len(g))) and [k for _, k, _ in g] == sorted(k for _, k, _ in g) and {n for *_, n in g} == {len(g)}
