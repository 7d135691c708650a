"""Sharding by a Feistel permutation of global row numbers (DataFrame functions only).

Rows are numbered 0..N-1 in (id, checksum, size) order.  A generalised Feistel network permutes a rectangle
a * b of at least N numbers, and a number that lands at N or above is permuted again (cycle walking) until it
falls below N, so the result is a permutation of 0..N-1.  Place p means shard p % shards, slot p // shards:
counts differ by one at most, slots have no gaps, and both can be computed, and inverted, from the row number.

Only (id, size, checksum) is shuffled, once, by range of id; the text never leaves its scan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch

ROUNDS = 8
WALKS = 64
P1, P2 = 2147483647, 2147483629  # primes below 2**31: products stay below 2**62


def round_keys(seed: int) -> list[tuple[int, int, int]]:
    """(addend, factor, factor) of each round, by a fixed linear congruence from the seed."""
    keys, x = [], (seed * 6364136223846793005 + 1442695040888963407) % (1 << 64)
    for _ in range(ROUNDS):
        out = []
        for _ in range(3):
            x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
            out.append((x >> 33) % (P2 - 1) + 1)
        keys.append(tuple(out))
    return keys


def rectangle(n: int) -> tuple[int, int]:
    """Sides a, b with a * b >= n and fewer than a numbers to spare."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def permute(x: int, n: int, seed: int) -> int:
    """The permutation for one number in plain Python; the columns below compute the same."""
    a, b = rectangle(n)
    while True:
        left, right = x % a, x // a
        for k, (add, m1, m2) in enumerate(round_keys(seed)):
            f = (((right if k % 2 == 0 else left) + add) % P1 * m1 % P1 * m2) % P2
            if k % 2 == 0:
                left = (left + f) % a
            else:
                right = (right + f) % b
        x = right * a + left
        if x < n:
            return x


def permuted(x: Column, n: int, seed: int) -> Column:
    """Feistel rounds inside a cycle walk of higher-order functions, so no subexpression is copied.

    A walk visits each spare number once at most, so up to a = ``WALKS`` spare numbers it always ends in time;
    for larger n a number is spare with probability below 1/a, and the row fails loudly if it is still outside.
    """
    a, b = rectangle(n)
    keys = F.array(*[F.struct(F.lit(k % 2 == 0).alias("even"), *[F.lit(v).cast("long").alias(c) for c, v in zip(("add", "m1", "m2"), key)]) for k, key in enumerate(round_keys(seed))])

    def turn(s: Column, k: Column) -> Column:
        f = ((F.when(k["even"], s["r"]).otherwise(s["l"]) + k["add"]) % P1 * k["m1"] % P1 * k["m2"]) % P2
        return F.when(k["even"], F.struct(((s["l"] + f) % a).alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), ((s["r"] + f) % b).alias("r")))

    def once(v: Column) -> Column:
        start = F.struct((v % a).alias("l"), F.floor(v / a).cast("long").alias("r")) if a * b < 1 << 50 else F.struct((v % a).alias("l"), F.expr("0L").alias("r"))
        return F.aggregate(keys, start, turn, lambda s: s["r"] * F.lit(a).cast("long") + s["l"])

    walked = F.aggregate(F.sequence(F.lit(2), F.lit(WALKS)), once(x), lambda v, _: F.when(v < n, v).otherwise(once(v)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def number_rows(df: DataFrame, order: list, scratch: Scratch, parts: int) -> tuple[DataFrame, int]:
    """``df`` with a gapless long ``row`` from 0 in the given order, and the row count.

    The sorted rows are written with (partition, place in it); the running sum of the partition sizes, a table
    of at most ``parts`` rows, gives the offsets and is broadcast.
    """
    low = F.lit((1 << 33) - 1)
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = scratch.save(placed, "numbered").withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(low)).drop("_id")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("n"))  # one row per partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    out = placed.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part")
    return out.withColumn("row", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before"), total


def shard(docs: DataFrame, shards: int = 16, seed: int = 20240501, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard.

    size is the UTF-8 bytes plus one.  A null text has size 1 and the checksum 0 of an empty one; null ids come first; equal rows are
    interchangeable and get distinct slots; an empty table gives no rows; other columns are ignored.
    grown_shard is null, as the law is ``rows``: counts differ by one at most.
    """
    spark = docs.sparkSession
    small = docs.select(F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(F.col(text_col), F.lit(""))).alias("text_crc32"))
    rows, n = number_rows(small, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], Scratch(spark, "shard"), parts or int(spark.conf.get("spark.sql.shuffle.partitions")))
    place = permuted(F.col("row"), n, seed)
    return rows.withColumn("place", place).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("place") % shards).cast("int").alias("shard"), F.floor(F.col("place") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
