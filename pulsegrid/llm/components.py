"""Connected components of a link table, as joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .tables import join_keyed


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, label): the least id of the component of every id in ``links`` (a long, b long).

    Alternating large-star and small-star steps (Kiveris et al., 2014): neighbours above an id are linked to
    the least id around it, then those below.  Each round is written; it ends when a round changes nothing.
    The neighbourhood minimum is an aggregate, so a hub is combined before it is shuffled, and its links are joined by broadcast.
    """
    ordered = lambda d: d.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    now = scratch.save(ordered(links), "links")
    state = None
    n = now.count()  # no round makes more links
    if not n:
        return now.select(F.col("a").alias("id"), F.col("b").alias("label"))
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = join_keyed(both.where("b > a"), least, ["a"], 2 * n).select(F.col("m").alias("a"), "b")
        large = scratch.save(ordered(large), "large", n)
        # small star: among an id and its smaller neighbours, all to the least
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
        nxt = scratch.save(ordered(small), "small", n)
        scratch.drop(now, large)
        now = nxt
        found = tuple(now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
        if found == state:
            break
        state = found
    return now.select(F.col("b").alias("id"), F.col("a").alias("label")).unionByName(now.select(F.col("a").alias("id"), F.col("a").alias("label")).distinct())
