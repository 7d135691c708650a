"""Acceptance of recordings and quality of feature tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.config import Config
from pulsegrid.functions.arrays import finite
from pulsegrid.operators import timebase
from pulsegrid.sources import shared

# Expected class shares, tolerances, plausible ranges.
EXPECTED_SHARE = {1: 0.53, 2: 0.30, 3: 0.17}
SHARE_TOLERANCE, DURATION_TOLERANCE_S = 0.12, 5.0
EDA_FLOOR, TEMP_RANGE = -0.5, (10.0, 45.0)


def _found(df: DataFrame, check: str, detail) -> DataFrame:
    return df.select("subject", F.lit(check).alias("check"), detail.cast("string").alias("detail"))


def tracks(samples: DataFrame) -> DataFrame:
    """(subject, stream, n, length, gaps, low, mid): what the checks of samples need of each track; ``mid`` is the median of temperatures."""
    v = finite(F.col("v"))
    per = samples.groupBy("subject", "stream", F.when(F.col("stream") == "temp", v).alias("value"))  # plain sums: with a percentile among them all samples would be sorted
    cells = per.agg(F.count("*").alias("n"), F.max("sample_idx").alias("last"), F.count_if(v.isNull()).alias("gaps"), F.min(v).alias("low"))
    mid = F.percentile("value", 0.5, F.col("n"))
    return cells.groupBy("subject", "stream").agg(F.sum("n").alias("n"), (F.max("last") + 1).alias("length"), F.sum("gaps").alias("gaps"), F.min("low").alias("low"), mid.alias("mid"))


def label_counts(labels: DataFrame) -> DataFrame:
    """(subject, label, n, length) of each class."""
    return labels.groupBy("subject", "label").agg(F.count("*").alias("n"), (F.max("sample_idx") + 1).alias("length"))


def _streams(per: DataFrame, cfg: Config) -> DataFrame:
    want = [s for s in cfg.fs if s != "label"]
    got = per.groupBy("subject").agg(F.collect_set("stream").alias("has"), F.countDistinct(F.when(F.col("stream").startswith("acc_"), F.col("n"))).alias("lengths"))
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, want)), "has"))
    absent = _found(got.where(F.size(missing) > 0), "streams", F.array_join(missing, ","))
    return absent.unionByName(_found(got.where("lengths > 1"), "axes", F.lit("unequal")))


def _spread(per: DataFrame, classes: DataFrame, cfg: Config, tolerance: float) -> DataFrame:
    both = per.select("subject", "stream", "length").unionByName(classes.groupBy("subject").agg(F.max("length").alias("length")).withColumn("stream", F.lit("label")))
    seconds = F.col("length") / timebase.rate(cfg)
    spread = both.groupBy("subject").agg((F.max(seconds) - F.min(seconds)).alias("spread"))
    return _found(spread.where(F.col("spread") > tolerance), "duration", F.format_number("spread", 1))


def _nulls(per: DataFrame) -> DataFrame:
    return _found(per.where("gaps > 0"), "nulls", F.concat_ws(":", "stream", F.col("gaps").cast("string")))


def _ranges(per: DataFrame, floor: float, temp: tuple[float, float]) -> DataFrame:
    low = per.where((F.col("stream") == "eda") & (F.col("low") < floor))
    return _found(low, "eda_range", F.lit("low")).unionByName(_found(per.where(~F.col("mid").between(*temp)), "temp_range", F.lit("median")))


def _classes(classes: DataFrame, cfg: Config) -> DataFrame:
    wanted = F.array(*map(F.lit, cfg.keep_labels))
    has = classes.groupBy("subject").agg(F.collect_set("label").alias("has"))
    missing = has.select("subject", F.explode(F.array_except(wanted.cast("array<long>"), F.col("has").cast("array<long>"))).alias("label"))
    return _found(missing, "class", F.col("label"))


def _shares(classes: DataFrame, tolerance: float) -> DataFrame:
    of = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    shares = classes.groupBy("subject").agg(*[F.try_divide(of(F.col("label") == c), of(F.col("label").isin(*EXPECTED_SHARE))).alias(f"s{c}") for c in EXPECTED_SHARE])
    long = shares.select("subject", F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.abs(F.coalesce(f"s{c}", F.lit(0.0)) - e).alias("off")) for c, e in EXPECTED_SHARE.items()])).alias("x"))
    return _found(long.where(F.col("x.off") > tolerance), "share", F.col("x.label"))


def check_streams(samples: DataFrame, cfg: Config) -> DataFrame:
    """Streams that are absent, and axes of unequal length."""
    return _streams(tracks(samples), cfg)


def check_duration_spread(samples: DataFrame, labels: DataFrame, cfg: Config, tolerance: float = DURATION_TOLERANCE_S) -> DataFrame:
    return _spread(tracks(samples), label_counts(labels), cfg, tolerance)


def check_nulls(samples: DataFrame) -> DataFrame:
    return _nulls(tracks(samples))


def check_ranges(samples: DataFrame, floor: float = EDA_FLOOR, temp: tuple[float, float] = TEMP_RANGE) -> DataFrame:
    return _ranges(tracks(samples.where(F.col("stream").isin("eda", "temp"))), floor, temp)


def check_classes(labels: DataFrame, cfg: Config) -> DataFrame:
    """Classes in scope that a subject never has."""
    return _classes(label_counts(labels), cfg)


def check_label_share(labels: DataFrame, cfg: Config, tolerance: float = SHARE_TOLERANCE) -> DataFrame:
    """Class shares far from what the protocol gives; a missing class has share 0."""
    return _shares(label_counts(labels), tolerance)


def check_alignment(samples: DataFrame, labels: DataFrame, cfg: Config, stream: str = "eda") -> DataFrame:
    """Samples whose nearest label differs from the one by truncation, which is that label or the one before.

    Only samples nearer to the next label can, and only labels that differ from the one before, so no others are joined.
    """
    track = Window.partitionBy("subject").orderBy("sample_idx")
    before = F.when(F.lag("sample_idx").over(track) == F.col("sample_idx") - 1, F.lag("label").over(track))
    turns = labels.select("subject", F.col("sample_idx").alias("label_idx"), "label", before.alias("before")).where(F.col("label") != F.col("before"))
    at = F.col("sample_idx") / timebase.rate(cfg) * cfg.fs["label"]
    near = samples.where(F.col("stream") == stream).select("subject", F.greatest(F.rint(at), F.lit(0.0)).cast("long").alias("label_idx"), F.floor(at).cast("long").alias("cut")).where("cut < label_idx")
    off = near.join(turns.select("subject", "label_idx"), ["subject", "label_idx"]).groupBy("subject").agg(F.count("*").alias("n"))
    return _found(off, "alignment", F.col("n"))


def acceptance_report(samples: DataFrame, labels: DataFrame, cfg: Config) -> DataFrame:
    """All problems, one row each.

    One aggregate over the samples and one over the labels serve six checks; they are written, being a row per track and class.
    """
    per, classes = shared.written(tracks(samples), "tracks"), shared.written(label_counts(labels), "classes")
    return reduce(lambda a, b: a.unionByName(b), [
        _streams(per, cfg), _spread(per, classes, cfg, DURATION_TOLERANCE_S), _nulls(per), _ranges(per, EDA_FLOOR, TEMP_RANGE),
        _classes(classes, cfg), _shares(classes, SHARE_TOLERANCE), check_alignment(samples, labels, cfg),
    ])


def recording_summary(samples: DataFrame, labels: DataFrame, cfg: Config) -> DataFrame:
    """(subject, minutes, samples, share_1..share_3)."""
    sizes = samples.groupBy("subject").agg(F.count("*").alias("samples"))
    total = F.count_if(F.col("label").isin(*EXPECTED_SHARE))
    shares = labels.groupBy("subject").agg(*[F.try_divide(F.count_if(F.col("label") == c), total).alias(f"share_{c}") for c in EXPECTED_SHARE])
    minutes = timebase.durations(samples, labels, cfg).withColumn("minutes", F.col("duration") / 60).drop("duration")
    return minutes.join(sizes, "subject").join(shares, "subject")


def feature_quality(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, missing, verdict) from one aggregate over all columns: over half missing or constant is bad, over 1 % missing a warning."""
    row = df.agg(*[x for c in cols for x in (F.avg(finite(F.col(c)).isNull().cast("int")).alias(f"{c}|m"), (F.count(finite(F.col(c))) == 0).alias(f"{c}|e"), (F.min(finite(F.col(c))) == F.max(finite(F.col(c)))).alias(f"{c}|k"))])
    long = row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}|m`").alias("missing"), (F.col(f"`{c}|e`") | F.coalesce(F.col(f"`{c}|k`"), F.lit(True))).alias("constant")) for c in cols])).alias("x")).select("x.*")
    verdict = F.when(F.col("missing") > 0.5, "bad").when(F.col("constant"), "constant").when(F.col("missing") > 0.01, "warn").otherwise("ok")
    return long.select("feature", "missing", verdict.alias("verdict"))


def method_rates(df: DataFrame, cols: list[str], primary: dict[str, str]) -> DataFrame:
    """(method, fallback, verdict): share of windows not made by the primary method."""
    row = df.agg(*[F.avg((F.col(c) != primary[c]).cast("int")).alias(c) for c in cols])
    long = row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("method"), F.col(c).alias("fallback")) for c in cols])).alias("x")).select("x.*")
    return long.withColumn("verdict", F.when(F.col("fallback") > 0.5, "problem").when(F.col("fallback") > 0.05, "bad").otherwise("ok"))


def class_balance(df: DataFrame) -> DataFrame:
    """(label_name, n, share, subjects), share to three places."""
    per = df.groupBy("label_name").agg(F.count("*").alias("n"), F.countDistinct("subject").alias("subjects"))
    total = df.agg(F.count("*").alias("total"))
    return per.join(F.broadcast(total)).select("label_name", "n", F.round(F.col("n") / F.col("total"), 3).alias("share"), "subjects")
