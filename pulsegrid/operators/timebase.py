"""Time base, durations, alignment and slicing of regularly sampled streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.config import Config


def rate(cfg: Config, stream: str = "stream") -> Column:
    """Samples per second of each row's stream."""
    return F.create_map(*[x for k, v in sorted(cfg.fs.items()) for x in (F.lit(k), F.lit(float(v)))])[F.col(stream)]


def with_time(samples: DataFrame, cfg: Config) -> DataFrame:
    """Seconds since the start."""
    return samples.withColumn("t", F.col("sample_idx") / rate(cfg))


def stream_durations(samples: DataFrame, labels: DataFrame | None, cfg: Config) -> DataFrame:
    """(subject, stream, n, seconds) of each track, the label track included."""
    counts = samples.groupBy("subject", "stream").agg((F.max("sample_idx") + 1).alias("n"))
    if labels is not None:
        counts = counts.unionByName(labels.groupBy("subject").agg((F.max("sample_idx") + 1).alias("n")).withColumn("stream", F.lit("label")))
    return counts.withColumn("seconds", F.col("n") / rate(cfg))


def durations(samples: DataFrame, labels: DataFrame | None, cfg: Config) -> DataFrame:
    """(subject, duration): the shortest track."""
    return stream_durations(samples, labels, cfg).groupBy("subject").agg(F.min("seconds").alias("duration"))


def label_nearest(samples: DataFrame, labels: DataFrame, cfg: Config, truncate: bool = False) -> DataFrame:
    """Each sample's nearest label: an equi-join on the computed label index, half to even, clipped to the track."""
    fs = cfg.fs["label"]
    last = labels.groupBy("subject").agg(F.max("sample_idx").alias("last"))
    at = F.col("sample_idx") / rate(cfg) * fs
    at = (F.floor(at) if truncate else F.rint(at)).cast("long")
    left = samples.join(last, "subject").withColumn("label_idx", F.least(F.greatest(at, F.lit(0)), F.col("last"))).drop("last")
    return left.join(labels.select("subject", F.col("sample_idx").alias("label_idx"), "label"), ["subject", "label_idx"])


def slice_windows(samples: DataFrame, windows: DataFrame, cfg: Config, seconds: float | None = None) -> DataFrame:
    """Samples of every window [t_start, t_start + seconds): rows (w, t_start) x samples.

    Windows and samples meet by equality on the stretch of ``seconds`` a sample lies in, and a window goes to the two (or three) that it
    touches, so no range join is needed and no index is made that has no sample.  Windows are many from few rows of
    durations, which the planner takes for few: the hint keeps it from sending them to the driver.
    """
    seconds = cfg.win_s if seconds is None else seconds
    slack = 1 / min(float(v) for k, v in cfg.fs.items() if k != "label")  # a window's first sample may lie before t_start by less than a period
    place = lambda t: F.floor(t / seconds)
    touched = F.explode(F.sequence(place(F.col("t_start") - slack), place(F.col("t_start") + seconds + slack))).alias("_stretch")
    wanted = windows.select("subject", "w", "t_start", touched)
    known = samples.where(F.col("stream").isin(sorted(k for k in cfg.fs if k != "label"))).withColumn("_fs", rate(cfg))
    known = known.withColumn("_stretch", place(F.col("sample_idx") / F.col("_fs")))
    first, end = F.floor(F.col("t_start") * F.col("_fs")), F.ceil((F.col("t_start") + seconds) * F.col("_fs"))
    met = wanted.hint("merge").join(known, ["subject", "_stretch"]).where(F.col("sample_idx").between(F.greatest(first, F.lit(0)), end - 1))
    rest = [c for c in samples.columns if c not in ("subject", "stream", "sample_idx")]
    return met.select("subject", "stream", "sample_idx", "w", "t_start", *rest)


def decimate_mean(samples: DataFrame, fs: float, out_fs: float) -> DataFrame:
    """Mean of each full interval of round(fs / out_fs) samples, nulls skipped; a partial last one is dropped."""
    step = round(fs / out_fs)
    groups = samples.groupBy("subject", "stream", F.floor(F.col("sample_idx") / step).alias("out_idx")).agg(F.avg("v").alias("v"), F.count("*").alias("n"))
    return groups.where(F.col("n") == step).select("subject", "stream", F.col("out_idx").alias("sample_idx"), "v")


def label_distribution(labels: DataFrame, keep: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Share of each kept label among the kept samples of a subject."""
    counts = labels.where(F.col("label").isin(*keep)).groupBy("subject", "label").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("subject")))


def nearest_in_time(left: DataFrame, right: DataFrame, tolerance_s: float, take: list[str], side: str = "nearest", chunk_s: float = 3600.0) -> DataFrame:
    """``left`` with the columns ``take`` of the row of ``right`` nearest in time (both: subject, ts), and off_s, how far it is; nulls beyond the tolerance.

    ``side`` is nearest, before or after; a row of the same time counts as either, and of two as near the earlier is taken.  Of rows of
    ``right`` that share subject and time the one of the largest ``take`` counts.  Rows without subject or time meet nothing, those of ``left`` stay.

    Both tracks are dealt out by subject and stretch of time, so a long recording is many groups; a row of ``right`` also goes to the
    stretch whose edge is within its tolerance.  Within a group the latest and the next row are carried along the order of time: no pairs are made.
    """
    if side not in ("nearest", "before", "after"):
        raise ValueError(f"unknown side {side!r}")
    tolerance, chunk = round(tolerance_s * 1e6), max(round(chunk_s * 1e6), 2 * round(tolerance_s * 1e6), 1)
    at = F.unix_micros("ts")
    place = lambda shift=0: F.floor((F.col("_at") + shift) / chunk)
    lefts = left.withColumn("_row", F.struct(*[f"`{c}`" for c in left.columns])).select("subject", at.alias("_at"), "_row").withColumn("_chunk", F.coalesce(place(), F.lit(-1)))
    rights = right.where(F.col("ts").isNotNull() & F.col("subject").isNotNull()).select("subject", at.alias("_at"), F.struct(*take).alias("_take"))
    rights = rights.withColumn("_chunk", F.explode(F.array_distinct(F.array(place(-tolerance), place(), place(tolerance)))))
    rows = lefts.withColumn("_take", F.lit(None).cast(rights.schema["_take"].dataType)).unionByName(rights.withColumn("_row", F.lit(None).cast(lefts.schema["_row"].dataType)))
    known = F.when(F.col("_row").isNull(), F.struct("_at", "_take"))
    group = Window.partitionBy("subject", "_chunk")
    upto = lambda order: F.max(known).over(group.orderBy(order).rangeBetween(Window.unboundedPreceding, 0))
    after = F.max(F.when(F.col("_row").isNull(), F.struct((-F.col("_at")).alias("_at"), "_take"))).over(group.orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, 0))
    met = rows.withColumns({"_before": upto(F.asc("_at")), "_after": after}).where("_row is not null")
    back, ahead = F.col("_at") - F.col("_before._at"), -F.col("_after._at") - F.col("_at")
    near = F.lit(True) if side == "before" else F.lit(False) if side == "after" else F.coalesce(back <= ahead, ahead.isNull())
    off = F.when(near, back).otherwise(ahead)
    ok = off <= tolerance
    chosen = F.when(ok, F.when(near, F.col("_before._take")).otherwise(F.col("_after._take")))
    return met.select("_row.*", *[chosen[c].alias(c) for c in take], F.when(ok, off / 1e6).alias("off_s"))
