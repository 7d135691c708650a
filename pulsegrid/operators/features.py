"""The 42 features as columns over window arrays, and the plan that builds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid import contract
from pulsegrid.config import Config
from pulsegrid.functions import arrays as A
from pulsegrid.functions import signal
from pulsegrid.operators import windows


def plausible_hr(a: Column, cfg: Config) -> Column:
    lo, hi = cfg.hr_range
    return F.filter(a, lambda x: x.isNotNull() & (x > lo) & (x < hi))


def hr(df: DataFrame, cfg: Config, col: str = "hr") -> DataFrame:
    """Seven heart-rate features of a block; implausible samples are left out, none left gives nulls."""
    df = df.withColumn("_hr", plausible_hr(F.col(col), cfg))
    a = F.col("_hr")
    df = df.withColumns({
        "hr_mean": A.mean(a), "hr_sd": A.sd_pop(a), "hr_min": F.array_min(a), "hr_max": F.array_max(a),
        "hr_range": F.array_max(a) - F.array_min(a), "hr_slope": A.ls_slope(a, cfg.fs["hr"]),
    })
    return df.withColumn("hr_baseline_delta", F.col("hr_mean") - F.col("baseline_hr")).drop("_hr")


def imu(df: DataFrame, cfg: Config) -> DataFrame:
    """Seventeen motion features of a block of under four samples: nulls."""
    fs = cfg.fs["acc_x"]
    mag = F.zip_with(F.zip_with("acc_x", "acc_y", lambda x, y: x * x + y * y), "acc_z", lambda s, z: F.sqrt(s + z * z))
    df = df.withColumn("acc_mag", mag)
    ok = F.size("acc_x") >= 4
    out = {}
    for c in ("x", "y", "z", "mag"):
        a = F.col(f"acc_{c}")
        out |= {f"acc_{c}_mean": F.when(ok, A.mean(a)), f"acc_{c}_sd": F.when(ok, A.sd_pop(a)), f"acc_{c}_absint": F.when(ok, A.abs_integral(a, fs))}
    freq = signal.peak_frequency(fs, cfg.acc_band)
    out |= {f"acc_{c}_peakfreq": F.when(ok, freq(F.col(f"acc_{c}"))) for c in "xyz"}
    df = df.withColumns(out)
    flag = F.when(~ok, F.lit(None)).when(F.col("acc_mag_sd") > cfg.motion_sd, 1.0).otherwise(0.0)
    return df.withColumn("motion_flag", flag).withColumn("motion_fraction", F.col("motion_flag")).drop("acc_mag")


def temp(df: DataFrame, cfg: Config, col: str = "temp") -> DataFrame:
    """Six temperature features of a window; missing samples are left out."""
    df = df.withColumn("_t", F.filter(col, lambda x: x.isNotNull()))
    a = F.col("_t")
    df = df.withColumns({"temp_mean": A.mean(a), "temp_min": F.array_min(a), "temp_max": F.array_max(a), "temp_range": F.array_max(a) - F.array_min(a), "temp_slope": A.ls_slope(a, cfg.fs["temp"])})
    return df.withColumn("temp_baseline_delta", F.col("temp_mean") - F.col("baseline_temp")).drop("_t")


def _field(events: Column, name: str) -> Column:
    return F.transform(events, lambda e: e[name])


def scr_columns(events: Column, present: Column) -> dict[str, Column]:
    """Five response features; zeros, not nulls, without a response."""
    amp, rise, dur = (_field(events, k) for k in ("amp", "rise", "dur"))
    none = F.size(events) == 0
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return {
        "eda_scr_count": F.when(present, F.size(events).cast("double")),
        "eda_scr_amp_sum": F.when(present, total(amp)),
        "eda_scr_amp_mean": F.when(present, F.when(none, 0.0).otherwise(A.mean(amp))),
        "eda_scr_risetime_mean": F.when(present, F.when(none, 0.0).otherwise(A.mean(rise))),
        "eda_scr_duration_sum": F.when(present, total(dur)),
    }


def eda(df: DataFrame, cfg: Config, col: str = "eda") -> DataFrame:
    """Ten skin-conductance features of a window; nulls under five seconds or with a missing sample."""
    fs = cfg.fs["eda"]
    usable = (F.size(col) >= int(fs * 5)) & ~A.has_null(F.col(col))
    df = df.withColumn("_raw", F.when(usable, F.col(col)))
    if cfg.eda_split not in ("median", "sparse") or cfg.scr_find not in ("prominence", "onset"):
        raise ValueError("unknown eda_split or scr_find")
    sparse = cfg.eda_split == "sparse"
    split = (signal.eda_sparse if sparse else signal.eda_decompose)(fs)
    find = (signal.scr_onsets if cfg.scr_find == "onset" else signal.scr_events)(fs, cfg.scr_min_amp)
    df = df.withColumn("_parts", signal.with_events(split, find)(F.col("_raw")))
    tonic, phasic, raw = F.col("_parts.tonic"), F.col("_parts.phasic"), F.col("_raw")
    df = df.withColumns({
        "eda_scl_mean": A.mean(tonic), "eda_scl_sd": A.sd_pop(tonic), "eda_scr_sd": A.sd_pop(phasic), "eda_range": A.span(raw), "eda_slope": A.ls_slope(raw, fs),
        **scr_columns(F.col("_parts.events"), raw.isNotNull()), "eda_method": F.when(raw.isNotNull(), F.col("_parts.method") if sparse else F.lit("median")), "scr_method": F.when(raw.isNotNull(), cfg.scr_find),
    })
    return df.drop("_raw", "_parts")


def rollup_columns(blocks: list[Column], names: list[str]) -> dict[str, Column]:
    """Over sub-window structs: *_min by minimum, *_max by maximum, the rest by mean, nulls skipped."""
    out = {}
    for name in names:
        values = F.filter(F.array(*[b[name] for b in blocks]), lambda x: x.isNotNull())
        out[name] = F.array_min(values) if name.endswith("_min") else F.array_max(values) if name.endswith("_max") else A.mean(values)
    if "motion_fraction" in out:
        out["motion_flag"] = F.when(out["motion_fraction"] > 0.5, 1.0).when(out["motion_fraction"].isNotNull(), 0.0)
    return out


def block_starts(cfg: Config) -> range:
    """The panes, counted from a window's first, at which its blocks begin."""
    return range(0, cfg.panes(cfg.win_s), cfg.panes(cfg.short_s))


def beside(blocks: DataFrame, accepted: DataFrame, cfg: Config, by: tuple[str, ...], long: tuple[str, ...]) -> DataFrame:
    """The blocks (by, w, long panes, _block) that begin an accepted window (by, w, _window), with _window, the blocks that tile it as
    _b<pane>, and whole arrays of the long streams; one exchange of both by the key, no join."""
    rows = blocks.unionByName(accepted, allowMissingColumns=True)
    at = Window.partitionBy(*by).orderBy("w")
    found = {f"_b{k}": F.first("_block", ignorenulls=True).over(at.rangeBetween(k, k)) for k in block_starts(cfg)}
    whole = {f"_{s}": F.collect_list(s).over(at.rangeBetween(0, cfg.panes(cfg.win_s) - 1)) for s in long}
    rows = rows.withColumns({**found, **whole, "_window": F.first("_window", ignorenulls=True).over(at.rangeBetween(0, 0))})
    rows = rows.where(F.col("_block").isNotNull() & F.col("_window").isNotNull())
    return rows.withColumns({s: F.when(F.col(s).isNotNull(), F.flatten(f"_{s}")) for s in long}).drop("_block", *whole)


def rollup(blocks: DataFrame, names: list[str], cfg: Config, by: tuple[str, ...] = ("subject",)) -> DataFrame:
    """Each row's features over the blocks that tile the window which begins there: its own and those a block length on."""
    at, starts = Window.partitionBy(*by).orderBy("w"), block_starts(cfg)
    packed = blocks.withColumns({f"_b{k}": F.first(F.struct(*names)).over(at.rangeBetween(k, k)) for k in starts}).drop(*names)
    return packed.withColumns(rollup_columns([F.col(f"_b{k}") for k in starts], names)).drop(*[f"_b{k}" for k in starts])


def cross(df: DataFrame) -> DataFrame:
    still = 1 - F.col("motion_fraction")
    return df.withColumn("hr_delta_x_still", F.col("hr_baseline_delta") * still).withColumn("eda_range_gated", F.col("eda_range") * still)


def to_vector(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """The features as one array in contract order."""
    return df.withColumn("features", F.array(*(cols or contract.FEATURE_NAMES)))


def overview(samples: DataFrame, labels: DataFrame, cfg: Config) -> DataFrame:
    """(subject, duration, baseline_hr, baseline_temp): the shortest track and the references, from one aggregate over the samples and one over the labels."""
    streams = sorted(s for s in cfg.fs if s != "label")
    last = [F.max(F.when(F.col("stream") == s, F.col("sample_idx"))).alias(f"last_{s}") for s in streams]
    tracks = samples.where(F.col("stream").isin(streams)).groupBy("subject").agg(*last, *windows.baseline_aggregates(cfg))
    label = labels.groupBy("subject").agg(F.max("sample_idx").alias("last_label"))
    seconds = [(F.col(f"last_{s}") + 1) / float(cfg.fs[s]) for s in [*streams, "label"]]
    return tracks.join(label, "subject").select("subject", F.least(*seconds).alias("duration"), "baseline_hr", "baseline_temp")


def build_table(samples: DataFrame, labels: DataFrame, cfg: Config, limit: int | None = None) -> DataFrame:
    """The feature table: 42 features, subject, label, label_name, t_start, of the accepted windows.

    Samples are exchanged once, by subject and chunk; labels as counts per step.  Labels are judged before the costly
    helpers run, and every 15 s block is computed once for all windows of a chunk that hold it.  What goes on after the blocks
    is their features and each pane once: the accepted windows come to them in the same exchange, and the arrays of whole
    windows are made behind it, of accepted ones.
    """
    by, long = ("subject", "chunk"), ("eda", "temp")
    cells = windows.panes(windows.dealt(samples, cfg), cfg, by)
    arrays = windows.window_arrays(cells, cfg, (), by=by, single=long).withColumn("baseline_hr", F.lit(0.0))
    refs = ("baseline_hr", "baseline_temp")
    accepted = windows.majority_label(labels, windows.grid(overview(samples, labels, cfg), cfg, refs), cfg).where("label is not null")
    if limit is not None:
        accepted = windows.limit_accepted(accepted, limit)
    accepted = accepted.select("subject", windows.chunk_of(F.col("w"), cfg).alias("chunk"), "w", F.struct("label", "t_start", *refs).alias("_window"))
    names = contract.HR + contract.IMU
    blocks = imu(hr(arrays, cfg), cfg).select(*by, "w", *long, F.struct(*names).alias("_block"))
    both = beside(blocks, accepted, cfg, by, long).select(*by, "w", *long, "_window.*", *[c.alias(n) for n, c in rollup_columns([F.col(f"_b{k}") for k in block_starts(cfg)], names).items()])
    both = both.withColumn("hr_baseline_delta", F.col("hr_baseline_delta") - F.col("baseline_hr"))  # a mean of differences to one number
    out = windows.attach_meta(cross(temp(eda(both, cfg), cfg)))
    contract.exact([c for c in out.columns if c in contract.FEATURE_NAMES])
    return out.select(*contract.FEATURE_NAMES, *contract.META)
