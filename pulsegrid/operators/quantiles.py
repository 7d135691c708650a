"""Exact quantiles of groups of any size, by selection.

Groups of up to ``LIMIT`` rows are aggregated by ``percentile``, whose buffer holds their values.  In larger ones each quantile's two ranks
are bracketed between values of a mergeable sketch, rows below the bracket are counted, and the rows inside it, about a hundredth,
go to the next round, until a bracket holds at most LIMIT different values; these are counted and added up in order.  What is
shuffled of all rows is sketches and counts, and no task holds the values of a group.  Results equal ``percentile`` to the last bit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.functions.arrays import finite
from pulsegrid.sources import shared

LIMIT = 1_000_000
GRID = 200
ACCURACY = 10_000  # a sketch errs by this part of the rows at most
COARSE = 1_000  # the same of whole columns, whose brackets may be wider


def most_rows(df: DataFrame, *key: str) -> int:
    """Of the largest group, or of the table."""
    return df.groupBy(*key).count().agg(F.max("count")).first()[0] or 0


def quantiles(long: DataFrame, keys: list[str], qs: list[float], most: int | None = None) -> DataFrame:
    """(keys, q): the quantiles of column v, nulls left out; a group without values has a null q.  Keys are not null.

    ``most``, where it is known, is a bound of the rows of a group.
    """
    limit, points = LIMIT, F.array(*map(F.lit, qs))
    if (most_rows(long, *keys) if most is None else most) <= limit:
        return long.groupBy(*keys).agg(F.percentile("v", points).alias("q"))
    sizes = shared.written(long.groupBy(*keys).agg(F.count("v").alias("_n")), "sizes")
    small = long.join(sizes.where(F.col("_n") <= limit), keys, "left_semi").groupBy(*keys).agg(F.percentile("v", points).alias("q"))
    large = sizes.where(F.col("_n") > limit)
    rows = long.where("v is not null").join(large, keys, "left_semi").select(*keys, "v")
    at = F.col("_point") * (F.col("_n") - 1)
    targets = large.select("*", F.posexplode(points).alias("_k", "_point")).select(*keys, "_k", F.floor(at).alias("_rank"), F.ceil(at).alias("_next"), at.alias("_at"), F.lit(0).cast("long").alias("_below"))
    return small.unionByName(selected(rows, targets, keys, limit))


def selected(rows: DataFrame, targets: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """(keys, q) by rounds: targets are (keys, _k, _rank, _next, _at, _below), ranks from 0 in the group, _below the rows known to be under the bracket."""
    by, grid = keys, F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    while True:
        sketch = rows.groupBy(*by).agg(F.percentile_approx("v", grid, ACCURACY).alias("_grid"), F.count("*").alias("_m"))
        share = lambda rank: (rank - F.col("_below")) / F.col("_m")
        low = F.greatest(F.floor((share(F.col("_rank")) - 2 / ACCURACY) * GRID).cast("int"), F.lit(0))
        high = F.least(F.ceil((share(F.col("_next") + 1) + 2 / ACCURACY) * GRID).cast("int"), F.lit(GRID))
        brackets = targets.join(sketch, by).select(*keys, "_k", F.when(low > 0, F.col("_grid")[low]).otherwise(float("-inf")).alias("_lo"), F.when(high < GRID, F.col("_grid")[high]).otherwise(float("inf")).alias("_hi"))
        met = rows.join(shared.written(brackets, "brackets"), by).where(F.col("v") <= F.col("_hi"))
        under = met.where(F.col("v") < F.col("_lo")).groupBy(*keys, "_k").agg(F.count("*").alias("_under"))
        rows = shared.written(met.where(F.col("v") >= F.col("_lo")).select(*keys, "_k", "v"), "inside")
        targets = shared.written(targets.join(under, [*keys, "_k"], "left").withColumn("_below", F.col("_below") + F.coalesce("_under", F.lit(0))).drop("_under"), "targets")
        by = [*keys, "_k"]
        counts = shared.written(rows.groupBy(*by, "v").agg(F.count("*").alias("_c")), "counts")
        if counts.groupBy(*by).count().agg(F.max("count")).first()[0] <= limit:
            break
    upto = F.sum("_c").over(Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("_upto", upto).join(targets, by).withColumn("_upto", F.col("_upto") + F.col("_below"))
    value = lambda rank: F.min(F.when(F.col("_upto") > F.col(rank), F.col("v")))
    found = placed.groupBy(*by, "_at", "_rank", "_next").agg(value("_rank").alias("_a"), value("_next").alias("_b"))
    one = F.when((F.col("_rank") == F.col("_next")) | (F.col("_a") == F.col("_b")), F.col("_a")).otherwise((F.col("_next") - F.col("_at")) * F.col("_a") + (F.col("_at") - F.col("_rank")) * F.col("_b"))
    ordered = F.array_sort(F.collect_list(F.struct("_k", one.alias("x"))))  # one element a quantile
    return found.groupBy(*keys).agg(F.transform(ordered, lambda s: s["x"]).alias("q"))


def cells(df: DataFrame, cols: list[str], keep: list[str] = []) -> DataFrame:
    """(keep, feature, v): a row per row and column, values that are not finite as null."""
    return df.select(*keep, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), finite(F.col(c).cast("double")).alias("v")) for c in cols])).alias("x")).select(*keep, "x.*")


def of_columns(df: DataFrame, values: dict[str, Column], qs: list[float]) -> dict[str, list[float] | None]:
    """Quantiles of each value over all rows, a few numbers each; None for a column without values.

    The columns stay side by side: a round is one aggregate of sketches and one of the values inside the brackets, so no row is multiplied
    by the columns.  Large tables are read some four times, so ``df`` should be a written one.
    """
    wide = df.select(*[v.cast("double").alias(f"c{i}") for i, v in enumerate(values.values())])
    sizes = wide.agg(F.count("*").alias("rows"), *[F.count(c).alias(c) for c in wide.columns]).first()
    points = F.array(*map(F.lit, qs))
    if sizes["rows"] <= LIMIT:
        got = wide.agg(*[F.percentile(c, points).alias(c) for c in wide.columns]).first()
        return {name: got[c] for name, c in zip(values, wide.columns)}
    found: dict[tuple[str, int], float] = {}
    # column and quantile -> rank, next rank, position, and the bracket: from, to, rows below it, rows inside
    held = {(c, k): (math.floor(q * (sizes[c] - 1)), math.ceil(q * (sizes[c] - 1)), q * (sizes[c] - 1), -math.inf, math.inf, 0, sizes[c]) for c in wide.columns if sizes[c] for k, q in enumerate(qs)}
    inside = lambda c, lo, hi: F.when((F.col(c) >= lo) & (F.col(c) <= hi), F.col(c))
    while held:
        spans = {(c, lo, hi): f"s{i}" for i, (c, lo, hi) in enumerate(dict.fromkeys((c, h[3], h[4]) for (c, _), h in held.items()))}
        grid = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
        sketch = wide.agg(*[F.percentile_approx(inside(*span), grid, COARSE).alias(name) for span, name in spans.items()]).first()
        for key, (rank, next_, at, lo, hi, below, m) in held.items():
            marks = sketch[spans[(key[0], lo, hi)]]
            i, j = math.floor(((rank - below) / m - 2 / COARSE) * GRID), math.ceil(((next_ + 1 - below) / m + 2 / COARSE) * GRID)
            held[key] = (rank, next_, at, marks[i] if i > 0 else lo, marks[j] if j < GRID else hi, below, m)
        met = wide.agg(*[x for i, ((c, _), h) in enumerate(held.items()) for x in (F.count_if(F.col(c) < h[3]).alias(f"b{i}"), F.count(inside(c, h[3], h[4])).alias(f"m{i}"))]).first()
        held = {key: (*h[:5], met[f"b{i}"], met[f"m{i}"]) for i, (key, h) in enumerate(held.items())}
        found |= {key: h[3] for key, h in held.items() if h[3] == h[4]}
        held = {key: h for key, h in held.items() if key not in found}
        if not held:
            break
        each = F.array(*[F.struct(F.lit(i).alias("_j"), inside(c, h[3], h[4]).alias("v")) for i, ((c, _), h) in enumerate(held.items())])
        counts = shared.written(wide.select(F.explode(each).alias("x")).where("x.v is not null").groupBy("x._j", "x.v").agg(F.count("*").alias("_c")), "counts")
        ends = {r["_j"]: r["n"] for r in counts.groupBy("_j").agg(F.count("*").alias("n")).collect()}
        ready = [i for i in range(len(held)) if ends[i] <= LIMIT]
        keys = list(held)
        ranks = F.create_map(*[x for i, h in enumerate(held.values()) for x in (F.lit(i), F.array(F.lit(h[0] - h[5]), F.lit(h[1] - h[5])))])[F.col("_j")]
        upto = F.sum("_c").over(Window.partitionBy("_j").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
        placed = counts.where(F.col("_j").isin(ready)).withColumn("_upto", upto).withColumn("_ranks", ranks)
        value = lambda k: F.min(F.when(F.col("_upto") > F.col("_ranks")[k], F.col("v")))
        for r in placed.groupBy("_j").agg(value(0).alias("a"), value(1).alias("b")).collect():
            key = keys[r["_j"]]
            rank, next_, at = held[key][:3]
            found[key] = r["a"] if rank == next_ or r["a"] == r["b"] else (next_ - at) * r["a"] + (at - rank) * r["b"]
        held = {key: h for key, h in held.items() if key not in found}
    return {name: [found[(c, k)] for k in range(len(qs))] if sizes[c] else None for name, c in zip(values, wide.columns)}


def of_table(df: DataFrame, values: dict[str, Column], q: float) -> dict[str, float | None]:
    """One quantile of each value over all rows, a number each."""
    return {c: got and got[0] for c, got in of_columns(df, values, [q]).items()}
