"""Exact top-k by inner product with the threshold algorithm over sorted per-dimension lists.

Rows are dealt into blocks by hash.  In a block each dimension has its list of rows sorted by value.  A query
reads all lists in step, from the top where its own component is positive and from the bottom where it is
negative, and scores every row it meets for the first time.  No row unseen at depth t can score above the sum of
the query's components times the values at depth t; once that bound is below the kth best score, or no row is
unseen, the query stops.  Depths double, so few numpy calls serve a query.

A task holds one block of queries and reads several row blocks after one another, one at a time; a query takes
its kth best score from block to block, so the bound can stop it early in later ones.  The tasks' results, k rows for
a query each at most, are merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROW_BLOCK, QUERY_BLOCK = 8192, 8192
ROW_BLOCKS_PER_TASK = 4
FIRST_DEPTH = 16
EXACT_SINGLE = 1 << 24  # whole numbers below this are exact in single precision


class SortedLists:
    """The rows of a block with their lists."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray | None = None):
        by_id = np.argsort(ids, kind="stable")  # then a smaller place is a smaller id
        self.ids, self.x = ids[by_id], np.ascontiguousarray(vectors[by_id])
        self.rows = by_id if rows is None else rows[by_id]
        self.lists = np.ascontiguousarray(np.argsort(self.x, axis=0, kind="stable").T.astype(np.int32))  # dimension x rank, ascending
        self.values = np.ascontiguousarray(np.take_along_axis(self.x, self.lists.T, axis=0).T)

    def walk(self, own: int, query: np.ndarray, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray, str, int]:
        """(places, scores, what stopped it, depth): the rows that are among the k best here and score ``floor`` or more.

        ``floor`` is a score that k other rows are known to reach.  Rows of the query's own id are left out.
        """
        n = len(self.ids)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        fresh = np.ones(n, dtype=bool)
        lo, hi = np.searchsorted(self.ids, own, "left"), np.searchsorted(self.ids, own, "right")
        fresh[lo:hi] = False
        left = n - (hi - lo)
        at, score, depth, kth = np.zeros(0, np.int64), np.zeros(0, self.x.dtype), 0, floor
        if not len(up) + len(down):  # every row scores 0 and stands at every depth
            at = np.flatnonzero(fresh)
            return at, np.zeros(len(at), self.x.dtype), "seen", 0
        while left:
            last, depth = depth, min(n, max(FIRST_DEPTH, 2 * depth))
            met = np.zeros(n, dtype=bool)
            met[self.lists[up, n - depth : n - last]] = True
            met[self.lists[down, last:depth]] = True
            met &= fresh
            new = np.flatnonzero(met)
            fresh[new] = False
            left -= len(new)
            got = self.x[new] @ query
            keep = got >= kth  # ties stay until the end
            at, score = np.concatenate([at, new[keep]]), np.concatenate([score, got[keep]])
            if len(at) >= k:
                kth = max(kth, np.partition(score, len(score) - k)[len(score) - k])
                keep = score >= kth
                at, score = at[keep], score[keep]
            if kth > self.values[up, n - depth] @ query[up] + self.values[down, depth - 1] @ query[down]:
                return at, score, "bound", depth
        return at, score, "seen", depth


class Best:
    """The k best rows of each query so far, by score and then by the smaller id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, vectors, k
        self.found: list[tuple] = [tuple(np.zeros(0, np.int64) for _ in range(3))] * len(ids)

    def read(self, block: SortedLists) -> None:
        for i, (own, query) in enumerate(zip(self.ids, self.x)):
            score, ids, rows = self.found[i]
            at, new, *_ = block.walk(own, query, self.k, float(score[-1]) if len(score) == self.k else -np.inf)
            if len(at):
                score, ids, rows = (np.concatenate(x) for x in ((score, new.astype(np.int64)), (ids, block.ids[at]), (rows, block.rows[at])))
                order = np.lexsort((ids, -score))[: self.k]
                self.found[i] = score[order], ids[order], rows[order]

    def table(self) -> pa.RecordBatch:
        score, ids, rows = (np.concatenate([f[j] for f in self.found]) if self.found else np.zeros(0, np.int64) for j in range(3))
        owner = np.repeat(self.ids, [len(f[0]) for f in self.found])
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (owner, ids, rows, score)], names=["query_id", "vec_id", "row", "score"])


def _matrix(vectors: list[pa.Array], width: int, kind: type) -> np.ndarray:
    """The vectors as rows, shorter ones padded with zeros."""
    out = np.zeros((sum(map(len, vectors)), width), dtype=kind)
    done = 0
    for v in vectors:
        size = v.value_lengths().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(done, done + len(v)), size)
        at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        out[row, at] = v.flatten().to_numpy(zero_copy_only=False)
        done += len(v)
    return out


def _search(k: int, width: int, kind: type):
    """Over rows (rg, qb, rb, vec_id, row, v) sorted by the first three; queries have rb -1 and come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, group, block, held = None, None, None, []

        def finish() -> None:
            nonlocal best, held
            if held:
                ids, rows = (np.concatenate([h[j].to_numpy() for h in held]) for j in (0, 1))
                x = _matrix([h[2] for h in held], width, kind)
                if block == -1:
                    best = Best(ids, x, k)
                elif best is not None:
                    best.read(SortedLists(ids, x, rows))
            held = []

        for batch in batches:
            keys = np.stack([batch.column(j).to_numpy() for j in range(3)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi == lo:
                    continue
                mine = tuple(keys[:2, lo])
                if (mine, keys[2, lo]) != (group, block):
                    finish()
                    if mine != group and best is not None:
                        yield best.table()
                        best = None
                    group, block = mine, keys[2, lo]
                held.append(tuple(batch.column(j).slice(lo, hi - lo) for j in (3, 4, 5)))
        finish()
        if best is not None:
            yield best.table()

    return run


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(vec_id, v) with v = floor(scale * component); rows with a null id, vector or component or a non-finite one are out."""
    v = F.col(vector_col).cast("array<double>")
    usable = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(F.coalesce(v, F.array()), lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return df.where(usable).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * scale)).alias("v"))


def search(vectors: DataFrame, is_query: Column, k: int = 20, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Each query's k best rows by inner product: query_id, rank from 1, vec_id, score.

    ``vectors`` is (vec_id, v array<long>); a shorter vector counts as padded with zeros; rows that share the
    query's id are its own and no candidates; ties go to the smaller id; fewer than k candidates give all.
    Every other row is a candidate, also one that shares its id with another.  Query rows that share an id are one query:
    a candidate row counts once, with its best score over their vectors.
    Scores are exact below 2**53.  An empty table or query set gives no rows.

    A row is sent once to each block of queries; there are as many as the queries need, or, of smaller ones, as the shuffle has
    partitions.
    """
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    largest = F.max(F.coalesce(F.array_max(F.transform("v", lambda x: F.abs(x))), F.lit(0)))
    n, q, width, most = vectors.agg(F.count("*"), F.approx_count_distinct(F.when(is_query, F.xxhash64("vec_id", "v"))), F.max(F.size("v")), largest).first()
    width = max(1, width or 1)
    kind = np.float32 if (most or 0) ** 2 * width < EXACT_SINGLE else np.float64
    rows_in = max(1, -(-n // row_block))
    groups = -(-rows_in // ROW_BLOCKS_PER_TASK)
    queries_in = max(1, -(-q // query_block), min(-(-q // 64), -(-parts // groups)))
    spread = lambda m, *by: F.pmod(F.xxhash64(*by), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    v = F.col("v").cast("array<float>" if kind is np.float32 else "array<double>").alias("v")
    rows = vectors.select("vec_id", "v", F.monotonically_increasing_id().alias("row")).withColumn("rb", spread(rows_in, "row"))  # repeated rows are spread, too
    rows = rows.select((F.col("rb") % groups).alias("rg"), every(queries_in).alias("qb"), "rb", "vec_id", "row", v)
    queries = vectors.where(is_query).select("vec_id", "v").distinct()
    queries = queries.select(every(groups).alias("rg"), spread(queries_in, "vec_id", "v").alias("qb"), F.lit(-1).alias("rb"), "vec_id", F.lit(-1).cast("long").alias("row"), v)
    dealt = queries.unionByName(rows).repartition(parts, "rg", "qb").sortWithinPartitions("rg", "qb", "rb")
    found = dealt.mapInArrow(_search(k, width, kind), "query_id long, vec_id long, row long, score long")
    found = found.groupBy("query_id", "vec_id", "row").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
