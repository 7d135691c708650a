"""Removal of later copies of long line runs, by a suffix order over line ids (DataFrame functions only).

A document is a sequence of line ids.  Prefix doubling gives every suffix the rank of its first 1, 2, 4, ... lines:
the rank of 2k lines is the order of the pair (rank of k lines here, rank of k lines k further on).  A suffix
whose prefix occurs once is settled and leaves, so each level is smaller than the one before.

A run of at least ``min_words`` words that occurs earlier is deleted.  Such a run is exactly the union of its
*minimal* runs, those that fall short without their last line or without their first.  A run of m lines is named by the ranks
of its first and last 2**j lines (2**j <= m < 2**(j+1)): all suffixes with those ranks form the interval of the suffix
order whose common prefix has at least these m lines, and all its members but the earliest are later copies.
A minimal run has at most ``min_words`` lines, as a line has a word at least, so doubling ends there.

Hot lines are rows of joins, which can be split, and are counted before they are shuffled; no task gathers the
occurrences of a line.  Windows are over the lines of one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch
from .tables import columns, join_keyed

DOC = ["d", "th"]
WHERE = [*DOC, "pos"]


def lines_of(text: Column) -> Column:
    """The lines of a text that are not blank, without blanks around them."""
    return F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.trim(x)), lambda x: x != "")


def _id(name: str) -> Column:
    """The id as a long that compares and joins; a null one is the smallest."""
    return F.coalesce(F.col(name).cast("long"), F.lit(-(1 << 63)))


def _rank(groups: DataFrame, keys: list[str]) -> DataFrame:
    """A long rank for each row that follows the order of ``keys``; rows are distinct, ranks have gaps."""
    return groups.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*keys, F.monotonically_increasing_id().alias("next"))


def _repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys)


def later_copies(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d, th, removed): the places, from 0 among its lines that are not blank, of the lines to delete in a document.

    d is the id (the smallest long if null) and th a hash of the text; documents without such lines have no row.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    lines = docs.select(_id(id_col).alias("d"), F.xxhash64(text_col).alias("th"), F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
    words = F.length("line") - F.length(F.replace("line", F.lit(" "))) + 1
    lines = scratch.save(lines.select(*WHERE, F.xxhash64("line").alias("h"), F.xxhash64(F.lit(7), "line").alias("h2"), words.cast("long").alias("w")), "lines")

    ids = _rank(_repeated(lines, ["h", "h2"]), ["h", "h2"])
    # rows equal in id and text are one document: each of its lines is kept once
    base = scratch.save(lines.join(ids, ["h", "h2"]).select(*WHERE, "w", F.col("next").alias("rank")).distinct(), "level")
    scratch.drop(lines)
    doc = Window.partitionBy(*DOC)
    levels, k = [base.select(*WHERE, "rank", F.lit(1).alias("k"))], 1
    n = levels[0].count()
    while 2 * k <= min_words and n:
        ahead = doc.orderBy("pos").rangeBetween(k, k)
        pairs = levels[-1].withColumn("second", F.max("rank").over(ahead)).where("second is not null").select(*WHERE, "rank", "second")
        names = _rank(_repeated(pairs, ["rank", "second"]), ["rank", "second"])
        k *= 2
        levels.append(scratch.save(pairs.join(names, ["rank", "second"]).select(*WHERE, F.col("next").alias("rank"), F.lit(k).alias("k")), "level", n))
        n = levels[-1].count()

    # islands: neighbouring lines that all occur elsewhere; c0, c1: words before and through a line
    near = base.select(*WHERE, "w").withColumn("island", F.col("pos") - F.row_number().over(doc.orderBy("pos")))
    island = Window.partitionBy(*DOC, "island")
    near = near.withColumn("c1", F.sum("w").over(island.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))).withColumn("c0", F.col("c1") - F.col("w"))
    near = near.withColumn("down", -F.col("c0"))
    whole = [F.min("pos").over(island).alias("lo"), F.max("pos").over(island).alias("hi"), F.max("c1").over(island).alias("total")]
    # the first line from which min_words words have gone by since this one began; the last that ended so many before this one ends
    beyond = F.min("pos").over(island.orderBy("down").rangeBetween(Window.unboundedPreceding, -min_words))
    before = F.max("pos").over(island.orderBy("c1").rangeBetween(Window.unboundedPreceding, -min_words))
    near = near.select(*WHERE, "c0", "c1", *whole, beyond.alias("beyond"), before.alias("before"))
    ends = F.coalesce(F.col("beyond") - 1, F.when(F.col("total") - F.col("c0") >= min_words, F.col("hi")))
    begins = F.coalesce(F.col("before") + 1, F.when(F.col("c1") >= min_words, F.col("lo")))
    runs = near.select(*DOC, F.explode(F.array(F.struct(F.col("pos").alias("s"), ends.alias("e")), F.struct(begins.alias("s"), F.col("pos").alias("e")))).alias("r"))
    runs = runs.where("r.s is not null and r.e is not null").select(*DOC, F.col("r.s").alias("pos"), (F.col("r.e") - F.col("r.s") + 1).alias("m"))
    runs = runs.withColumn("k", F.pow(F.lit(2), F.floor(F.log2("m"))).cast("int")).withColumn("other", F.col("pos") + F.col("m") - F.col("k"))

    ranks = levels[0]
    for level in levels[1:]:
        ranks = ranks.unionByName(level)
    runs = runs.join(ranks.withColumnRenamed("rank", "a"), [*WHERE, "k"])
    last = ranks.select(*DOC, F.col("pos").alias("other"), "k", F.col("rank").alias("b"))
    runs = scratch.save(runs.join(last, [*DOC, "other", "k"]).select(*WHERE, "m", "a", "b"), "runs", 2 * levels[0].count())
    scratch.drop(base, *levels[1:])

    at = F.struct(*WHERE)
    first = runs.groupBy("m", "a", "b").agg(F.min(at).alias("first"), F.max(at).alias("end"), F.count("*").alias("n")).where("first <> end").drop("end")
    late = join_keyed(runs, first, ["m", "a", "b"], runs.count()).where(at != F.col("first"))
    spans = late.select(*DOC, "pos", "m").distinct().select(*DOC, F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("m") - 1)).alias("at"))
    return spans.groupBy(*DOC).agg(F.array_sort(F.collect_set("at")).alias("removed"))


def dedupe(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] = ("lines_before", "lines_removed")) -> DataFrame:
    """``docs`` with the later copies of line runs of at least ``min_words`` words cut out of the text.

    Earlier means smaller (id, hash of the text, line); a null id comes first.  Two columns named by ``counts`` follow: the lines
    before and those removed (lines that are not blank); they take the place of columns of docs of these names.  A text that loses lines also loses its blank lines, and one that loses all is
    empty; other texts are left as they are.  Null and empty texts have no lines; rows equal in id and text
    count as one document; a run may repeat and overlap within one text; an empty table gives no rows.
    """
    gone = later_copies(docs, min_words, id_col, text_col).select("d", "th", "removed")
    old = F.col("row")[text_col]
    lines, n = lines_of(old), F.coalesce(F.size(lines_of(old)), F.lit(0))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed")), lambda i: F.element_at(lines, i + 1))
    text = F.when(F.col("removed").isNull(), old).otherwise(F.array_join(kept, "\n"))
    out = docs.select(F.struct(*columns(docs)).alias("row"), _id(id_col).alias("d"), F.xxhash64(text_col).alias("th")).join(gone, ["d", "th"], "left")
    names = [c for c in docs.columns if c not in counts]
    return out.select(*[(text if c == text_col else F.col("row")[c]).alias(c) for c in names], n.cast("int").alias(counts[0]), F.coalesce(F.size("removed"), F.lit(0)).alias(counts[1]))
