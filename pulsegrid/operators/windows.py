"""Sliding windows out of panes, purity-gated labels, nested sub-windows.

A pane is one step of one stream.  Samples are grouped into panes once; a window is a range of pane numbers, so
no sample is multiplied by the windows that hold it.  Recordings are dealt out by subject and chunk, a stretch of panes; the
panes at a chunk's start also go to the chunk before (its halo), whose last windows reach into them.  So grouping and
windowing share one exchange, and a long recording is many groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.config import Config
from pulsegrid.contract import LABEL_NAMES
from pulsegrid.functions.arrays import finite


def grid(durations: DataFrame, cfg: Config, keep: tuple[str, ...] = ()) -> DataFrame:
    """(subject, w, t_start) of the complete windows, with columns of the durations to ``keep``."""
    last = F.floor((F.col("duration") - cfg.win_s) / cfg.step_s)
    out = durations.where(F.col("duration") >= cfg.win_s).select("subject", *keep, F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("w"))
    return out.withColumn("t_start", F.col("w") * cfg.step_s)


def complete(df: DataFrame, durations: DataFrame, cfg: Config) -> DataFrame:
    """Rows of ``df`` (subject, w) whose window is one of the grid's."""
    last = F.floor((F.col("duration") - cfg.win_s) / cfg.step_s)
    ends = durations.where(F.col("duration") >= cfg.win_s).select("subject", last.alias("_last"))
    return df.join(ends, "subject").where(F.col("w").between(0, F.col("_last"))).drop("_last")


def chunk_of(pane: Column, cfg: Config) -> Column:
    return F.floor(pane / cfg.panes(cfg.chunk_s))


def chunks(pane: Column, cfg: Config) -> Column:
    """The chunks that need a pane: its own, and the one before for the panes that windows of that one reach into."""
    size, own = cfg.panes(cfg.chunk_s), chunk_of(pane, cfg)
    if size < cfg.panes(cfg.win_s):
        raise ValueError("a chunk is shorter than a window")
    return F.when((own > 0) & (pane % size < cfg.panes(cfg.win_s) - 1), F.array(own, own - 1)).otherwise(F.array(own))


def own(df: DataFrame, cfg: Config) -> DataFrame:
    """Rows of windows that begin in their chunk; those of the halo are left out."""
    return df.where(F.col("chunk") == chunk_of(F.col("w"), cfg))


def pane_of(cfg: Config) -> Column:
    """The pane of a sample of any stream but the labels."""
    sizes = F.create_map(*[x for s in sorted(cfg.fs) if s != "label" for x in (F.lit(s), F.lit(cfg.pane_size(s)))])
    return F.floor(F.col("sample_idx") / sizes[F.col("stream")])


def dealt(samples: DataFrame, cfg: Config) -> DataFrame:
    """Samples with their chunk, those of a halo twice, exchanged by (subject, chunk)."""
    known = samples.where(F.col("stream").isin(sorted(s for s in cfg.fs if s != "label")))
    return known.withColumn("chunk", F.explode(chunks(pane_of(cfg), cfg))).repartition("subject", "chunk")


def panes(samples: DataFrame, cfg: Config, by: tuple[str, ...] = ("subject",)) -> DataFrame:
    """(by, stream, pane, values) with values in order; non-finite ones are null."""
    rows = samples.where(F.col("stream").isin(sorted(s for s in cfg.fs if s != "label"))).select(*by, "stream", pane_of(cfg).alias("pane"), F.struct("sample_idx", finite(F.col("v")).alias("v")).alias("s"))
    got = rows.groupBy(*by, "stream", "pane").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return got.select(*by, "stream", "pane", F.transform("s", lambda x: x["v"]).alias("values"))


def window_arrays(df: DataFrame, cfg: Config, long: tuple[str, ...] = ("eda", "temp"), short: tuple[str, ...] = ("hr", "acc_x", "acc_y", "acc_z"), by: tuple[str, ...] = ("subject",), single: tuple[str, ...] = ()) -> DataFrame:
    """(by, w) with a 60 s array of each long stream and a 15 s array of each short one, starting at pane w; of a single one the pane itself."""
    ahead = Window.partitionBy(*by, "stream").orderBy("pane")
    over = lambda seconds: F.flatten(F.collect_list("values").over(ahead.rangeBetween(0, cfg.panes(seconds) - 1)))
    reach = over(cfg.short_s)
    for streams, values in ((long, over(cfg.win_s)), (single, F.col("values"))):
        reach = F.when(F.col("stream").isin(*streams), values).otherwise(reach) if streams else reach
    cells = df.where(F.col("stream").isin(*long, *short, *single)).withColumn("a", reach)
    return cells.groupBy(*by, F.col("pane").alias("w")).agg(*[F.first(F.when(F.col("stream") == s, F.col("a")), ignorenulls=True).alias(s) for s in (*long, *short, *single)])


def label_counts(labels: DataFrame, cfg: Config, by: list[str]) -> DataFrame:
    """Counts of each label code 0..7 as an array, per group: mergeable and small."""
    return labels.groupBy(*by).agg(F.array(*[F.count_if(F.col("label") == c) for c in range(8)]).alias("counts"))


def majority_label(labels: DataFrame, windows: DataFrame, cfg: Config) -> DataFrame:
    """``windows`` with label (null unless accepted), majority, share, n and reason.

    The majority takes the smaller code on ties; below the purity a window is impure, and only then is its
    code checked for scope.
    """
    size = round(cfg.fs["label"] * cfg.step_s)
    counted = label_counts(labels.withColumn("pane", F.floor(F.col("sample_idx") / size)), cfg, ["subject", "pane"])
    counted = counted.withColumn("chunk", F.explode(chunks(F.col("pane"), cfg)))
    span = Window.partitionBy("subject", "chunk").orderBy("pane").rangeBetween(0, cfg.panes(cfg.win_s) - 1)
    sums = counted.select("subject", "chunk", F.col("pane").alias("w"), *[F.sum(F.col("counts")[c]).over(span).alias(f"c{c}") for c in range(8)])
    total, most = sum(F.col(f"c{c}") for c in range(1, 8)) + F.col("c0"), F.greatest(*[F.col(f"c{c}") for c in range(8)])
    majority = F.coalesce(*[F.when(F.col(f"c{c}") == most, c) for c in range(8)])
    sums = own(sums, cfg).select("subject", "w", majority.alias("majority"), (most / total).alias("share"), total.alias("n"))
    return with_reason(windows.join(sums, ["subject", "w"], "left"), cfg)


def with_reason(df: DataFrame, cfg: Config) -> DataFrame:
    reason = F.when(F.coalesce(F.col("n"), F.lit(0)) == 0, "empty").when(F.col("share") < cfg.purity, "impure").when(~F.col("majority").isin(*cfg.keep_labels), "out_of_scope")
    return df.withColumn("reason", reason).withColumn("label", F.when(reason.isNull(), F.col("majority")).cast("int"))


def reject_counts(labelled: DataFrame) -> DataFrame:
    """Rejected windows of each subject by reason; no_hr is kept for the contract and always 0 here."""
    return labelled.groupBy("subject").agg(*[F.count_if(F.col("reason") == r).alias(r) for r in ("empty", "impure", "out_of_scope")], F.count_if(F.col("reason").isNull()).alias("accepted")).withColumn("no_hr", F.lit(0).cast("long"))


def sub_windows(windows: DataFrame, cfg: Config) -> DataFrame:
    """(subject, w, sub, sub_start): the blocks that tile each window."""
    k = cfg.panes(cfg.win_s) // cfg.panes(cfg.short_s)
    return windows.select("subject", "w", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("sub"), "t_start").select("subject", "w", "sub", (F.col("t_start") + F.col("sub") * cfg.short_s).alias("sub_start"))


def limit_accepted(df: DataFrame, n: int) -> DataFrame:
    """The first n rows of each subject by start time."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy("subject").orderBy("t_start"))).where(F.col("_k") <= n).drop("_k")


def label_name(label: Column) -> Column:
    return F.create_map(*[x for c, s in LABEL_NAMES.items() for x in (F.lit(c), F.lit(s))])[label]


def attach_meta(df: DataFrame) -> DataFrame:
    """label_name, and t_start to milliseconds."""
    return df.withColumn("label_name", label_name(F.col("label"))).withColumn("t_start", F.round("t_start", 3))


def baseline_aggregates(cfg: Config) -> list[Column]:
    """baseline_hr and baseline_temp of a group of samples: means over the first part, whatever the label; null if empty."""
    lo, hi = cfg.hr_range
    v = finite(F.col("v"))
    early = lambda s: (F.col("stream") == s) & (F.col("sample_idx") < F.ceil(F.lit(cfg.baseline_s * cfg.fs[s])))
    return [F.avg(F.when(early("hr") & (v > lo) & (v < hi), v)).alias("baseline_hr"), F.avg(F.when(early("temp"), v)).alias("baseline_temp")]


def baseline_refs(samples: DataFrame, cfg: Config) -> DataFrame:
    """(subject, baseline_hr, baseline_temp) of every subject with either stream."""
    return samples.where(F.col("stream").isin("hr", "temp")).groupBy("subject").agg(*baseline_aggregates(cfg))
