"""Merkle manifest of a table: a tree of digests for each group, one over the groups, and a proof for every row (DataFrame functions only).

Slot pivot: nodes carry (group, position), and conditional aggregates by (group, position div fanout) spread a parent's children into
``fanout`` columns.  Concatenating the columns and hashing gives the parent; leaving out a child's own column gives its siblings.

Rows are numbered within their group by range partitions and offsets, so no task holds a group.  Each level is written, and has a
``fanout``-th of the rows of the one below.  Proofs come down from the top: a pivot gets its parent's path once, and only the last
joins have as many rows as the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch

STEP = "array<struct<before:string,after:string>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(fields: list[Column]) -> Column:
    """sha256 of the fields one after the other: ``-`` for null, else UTF-8 byte count, ``:`` and the value as text."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def group_key(group: Column) -> Column:
    """A text that is never null and sorts as the group does, null first."""
    return F.when(group.isNull(), "").otherwise(F.concat(F.lit("="), group.cast("string")))


def number_within(df: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """``df`` with ``pos``, gapless from 0 within ``grp`` in the given order, and ``n``, the rows of the group.

    Rows are sorted by range of (grp, order).  Counts by partition and group, of which there are no more than partitions and groups together,
    give the offsets.
    """
    by = ["grp", *order]
    placed = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by)
    placed = scratch.save(placed.withColumn("_id", F.monotonically_increasing_id()), "numbered").withColumn("_part", F.shiftright("_id", 33))
    group = Window.partitionBy("grp")
    before = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = placed.groupBy("grp", "_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    runs = runs.select("grp", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(group).alias("n"))
    return placed.join(runs, ["grp", "_part"]).withColumn("pos", F.col("_id") + F.col("_shift")).drop("_part", "_id", "_shift")


def pivot(nodes: DataFrame, fanout: int) -> DataFrame:
    """Parents of (grp, pos, n, h): (grp, pos, n of the parents' level, kids: one column a slot, as an array)."""
    slot = F.col("pos") % fanout
    wide = nodes.groupBy("grp", F.floor(F.col("pos") / fanout).alias("pos")).agg(F.ceil(F.max("n") / fanout).alias("n"), *[F.max(F.when(slot == s, F.col("h"))).alias(f"slot{s}") for s in range(fanout)])
    return wide.select("grp", "pos", "n", F.array(*[f"slot{s}" for s in range(fanout)]).alias("kids"))


def siblings(kids: Column, slot: Column, fanout: int) -> Column:
    """What stands before and after a slot."""
    slot = slot.cast("int")
    return F.struct(F.array_join(F.slice(kids, F.lit(1), slot), "").alias("before"), F.array_join(F.slice(kids, slot + 2, F.lit(fanout)), "").alias("after"))


def tree(nodes: DataFrame, fanout: int, scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """(pivots from the bottom up, (grp, h) of the node that remains of each group) of numbered nodes; a lone node is what remains."""
    most, pivots, level = nodes.agg(F.max("n")).first()[0] or 0, [], nodes
    rest = level.where(F.col("n") == 1).select("grp", "h")
    while most > 1:
        pivots.append(scratch.save(pivot(level.where(F.col("n") > 1), fanout), f"level{len(pivots)}"))
        level = pivots[-1].select("grp", "pos", "n", F.sha2(F.array_join("kids", ""), 256).alias("h"))
        rest = rest.unionByName(level.where(F.col("n") == 1).select("grp", "h"))
        most = -(-most // fanout)
    return pivots, rest


def with_paths(nodes: DataFrame, pivots: list[DataFrame], fanout: int) -> DataFrame:
    """Numbered nodes with ``path``: (before, after) of every level from their own up; a node alone in its group has none."""
    above = None
    for level in [*reversed(pivots), nodes]:
        if above is None:
            above = level.withColumn("path", F.array().cast(STEP))
            continue
        high = above.select("grp", F.col("pos").alias("_up"), F.col("kids").alias("_kids"), F.col("path").alias("_path"))
        both = level.withColumn("_up", F.floor(F.col("pos") / fanout)).join(high, ["grp", "_up"], "left")  # the top of a group has no parent
        path = F.concat(F.array(siblings(F.col("_kids"), F.col("pos") % fanout, fanout)), F.col("_path"))
        above = both.withColumn("path", F.coalesce(F.when(F.col("_kids").isNotNull(), path), F.array().cast(STEP))).drop("_up", "_kids", "_path")
    return above


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, step: F.sha2(F.concat(step["before"], h, step["after"]), 256))


def proof_digest(path: Column) -> Column:
    """sha256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), ""), 256)


def build(docs: DataFrame, shown: dict[str, Column] | None = None, fanout: int = 3, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "source") -> DataFrame:
    """One row per row of docs: the id, leaf, subroot, root, path (siblings from the bottom up) and shown_leaf.

    Leaves ascend by id within a group, null ids first, and of one id by digest; rows equal in all fields are interchangeable.  Groups
    ascend by name in UTF-8 byte order, null first.  ``shown`` gives other values of some fields, as a holder of the row may
    show it; shown_leaf is the digest of those.  Any field may be null; empty and very long texts are values like others; other columns
    are ignored; an empty table gives no rows.
    """
    scratch, shown = Scratch(docs.sparkSession, "manifest"), shown or {}
    leaf, other = digest([F.col(f) for f in fields]), digest([shown.get(f, F.col(f)) for f in fields])
    base = docs.select(F.col(id_col).alias("id"), group_key(F.col(group_col)).alias("grp"), leaf.alias("h"), (other if shown else leaf).alias("shown"), F.rand(7).alias("salt"))
    nodes = scratch.save(number_within(scratch.save(base, "leaves"), ["id", "h", "salt"], scratch).drop("salt"), "placed")  # the salt deals out equal rows
    pivots, subroots = tree(nodes, fanout, scratch)
    tops = scratch.save(number_within(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "h"), ["name"], scratch), "tops")
    high, roots = tree(tops, fanout, scratch)
    root = roots.select("h").first()  # one row, none for an empty table
    tops = with_paths(tops, high, fanout).select(F.col("name").alias("grp"), F.col("h").alias("subroot"), F.col("path").alias("_path"))
    out = with_paths(nodes, pivots, fanout).join(tops, "grp")
    return out.select(F.col("id").alias(id_col), F.col("h").alias("leaf"), "subroot", F.lit(root and root[0]).cast("string").alias("root"), F.concat("path", "_path").alias("path"), F.col("shown").alias("shown_leaf"))


def verify(proofs: DataFrame) -> DataFrame:
    """Rows of ``build`` with proof_sha256, folded_root (from shown_leaf and path) and verified, without path and shown_leaf."""
    out = proofs.withColumn("proof_sha256", proof_digest(F.col("path"))).withColumn("folded_root", folded(F.col("shown_leaf"), F.col("path")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root")).drop("path", "shown_leaf")
