"""Targets and label-blind robust scaling by subject."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pulsegrid.config import Config
from pulsegrid.contract import TIME
from pulsegrid.functions.arrays import finite
from pulsegrid.operators import quantiles
from pulsegrid.sources import shared

STRESS = 2


def make_target(df: DataFrame, task: str) -> DataFrame:
    """binary: 1 for stress, else 0; 3class: the label itself."""
    if task not in ("binary", "3class"):
        raise ValueError(f"unknown task {task!r}")
    return df.withColumn("y", F.when(F.col("label") == STRESS, 1).otherwise(0) if task == "binary" else F.col("label"))


def _quartiles(c: str, when: Column | None = None) -> Column:
    v = finite(F.col(c))
    return F.percentile(v if when is None else F.when(when, v), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))


def cohort_spread(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    """The interquartile range of each feature over all rows, exact, a number each."""
    found = quantiles.of_columns(df, {c: finite(F.col(c).cast("double")) for c in cols}, [0.25, 0.75])
    return {c: q and q[1] - q[0] for c, q in found.items()}


def cohort_iqr(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, iqr) over all rows, exact."""
    return df.sparkSession.createDataFrame(list(cohort_spread(df, cols).items()), "feature string, iqr double")


def ranked(df: DataFrame) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy("subject").orderBy(TIME)))


def beside_reference(df: DataFrame, cols: list[str], n_ref: int) -> DataFrame:
    """The rows after the first ``n_ref`` of their subject, with <col>_centre and <col>_spread of those first rows.

    One exchange by subject, none where the rows come dealt out by subject; a task holds the reference values of one subject, and its rows may go to disk.
    """
    all_rows = Window.partitionBy("subject").orderBy(TIME).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = ranked(df).withColumns({f"{c}_q": _quartiles(c, F.col("_rank") <= n_ref).over(all_rows) for c in cols})
    q = lambda c, k: F.col(f"{c}_q")[k]
    stats = [x for c in cols for x in (q(c, 1).alias(f"{c}_centre"), (q(c, 2) - q(c, 0)).alias(f"{c}_spread"))]
    return found.where(F.col("_rank") > n_ref).select(*df.columns, *stats)


def divisor(*rungs: Column) -> Column:
    """The first rung above zero, else one."""
    return F.coalesce(*[F.when(r > 0, r) for r in rungs], F.lit(1.0))


def centre_scale(df: DataFrame, cols: list[str], n_ref: int | None, cohort: dict[str, float], wider: str = "subject") -> DataFrame:
    """(subject, n_ref, <col>_centre, <col>_scale): median of the reference rows and the divisor of the cascade.

    The reference is the first ``n_ref`` rows by time, or all if None.  The second rung is the spread of the whole
    recording, or with wider='reference' that of the reference again (as a live scorer has it).
    """
    if (n_ref is None or wider == "subject") and quantiles.most_rows(df, "subject") > quantiles.LIMIT:
        return _centre_scale_large(df, cols, n_ref, cohort)
    names = [f"{c}_{k}" for c in cols for k in ("centre", "scale")]

    def refs(rows: pd.DataFrame) -> pd.DataFrame:
        first, _, n, centre, scale = _references(rows, cols, n_ref, cohort, wider)
        found = np.stack([centre, scale], axis=2).reshape(len(first), -1)
        return pd.DataFrame({"subject": rows["subject"].to_numpy()[first], "n_ref": n, **dict(zip(names, found.T))})

    out = T.StructType([df.schema["subject"], T.StructField("n_ref", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in names]])
    return by_subject(df.select("subject", TIME, *[F.col(c).cast("double").alias(c) for c in cols]), refs, out, TIME)


def by_subject(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], out: T.StructType, *order: str) -> DataFrame:
    """``f`` of whole subjects, as many at a time as a batch has, each in the given order; a task holds a batch and one subject."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for rows in batches:
            if not len(rows):
                continue
            name = rows["subject"].to_numpy()
            cut = int(np.argmax(name == name[-1]))  # rows come by subject: the last one may go on
            if cut or (held and held[-1]["subject"].iat[-1] != name[0]):
                held.append(rows[:cut])
                yield f(pd.concat(held, ignore_index=True))
                held = []
            held.append(rows[cut:])
        if held:
            yield f(pd.concat(held, ignore_index=True))

    return df.repartition("subject").sortWithinPartitions("subject", *order).mapInPandas(part, out)


def _quantiles(group: np.ndarray, v: np.ndarray, n: int, points: list[float]) -> np.ndarray:
    """Quantiles by group as ``percentile`` has them, a row a group, values that are not finite left out; NaN without values."""
    there = np.isfinite(v)
    group, v = group[there], v[there]
    v = v[np.lexsort((v, group))]
    size = np.bincount(group, minlength=n)
    start = (np.cumsum(size) - size)[:, None]
    if not len(v):
        return np.full((n, len(points)), np.nan)
    at = np.array(points) * np.maximum(size - 1, 0)[:, None]
    low, high = np.floor(at).astype(np.int64), np.ceil(at).astype(np.int64)
    a, b = (v[np.minimum(start + k, len(v) - 1)] for k in (low, high))
    return np.where(size[:, None] == 0, np.nan, np.where((low == high) | (a == b), a, (high - at) * a + (at - low) * b))


def _groups(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each subject, number of its subject for each row) of rows that come by subject."""
    name = rows["subject"].to_numpy()
    fresh = np.concatenate([[True], name[1:] != name[:-1]])
    return np.flatnonzero(fresh), np.cumsum(fresh) - 1


def _references(rows: pd.DataFrame, cols: list[str], n_ref: int | None, cohort: dict[str, float], wider: str = "subject") -> tuple[np.ndarray, ...]:
    """(first row, subject of each row, and by subject the reference rows, centres, divisors) of rows by subject and time; a centre without values is NaN."""
    first, group = _groups(rows)
    ref = np.arange(len(rows)) - first[group] < (len(rows) if n_ref is None else n_ref)
    centre, scale = np.empty((len(first), len(cols))), np.empty((len(first), len(cols)))
    for i, c in enumerate(cols):
        v = rows[c].to_numpy(dtype=np.float64)
        q = _quantiles(group[ref], v[ref], len(first), [0.25, 0.5, 0.75])
        spread = q[:, 2] - q[:, 0]
        if n_ref is not None and wider == "subject":
            whole = _quantiles(group, v, len(first), [0.25, 0.75])
            spread = np.where(spread > 0, spread, whole[:, 1] - whole[:, 0])
        centre[:, i], scale[:, i] = q[:, 1], np.where(spread > 0, spread, max(cohort.get(c) or 0.0, 0.0) or 1.0)
    return first, group, np.bincount(group[ref], minlength=len(first)), centre, scale


def _centre_scale_large(df: DataFrame, cols: list[str], n_ref: int | None, cohort: dict[str, float]) -> DataFrame:
    """The same where a recording is too long for one buffer: its quartiles by selection, those of the reference from its n_ref rows."""
    long = quantiles.quantiles(quantiles.cells(df, cols, ["subject"]), ["subject", "feature"], [0.25, 0.5, 0.75])
    whole = long.groupBy("subject").agg(*[F.max(F.when(F.col("feature") == c, F.col("q"))).alias(f"{c}|s") for c in cols])
    if n_ref is None:
        got = whole.join(df.groupBy("subject").agg(F.count("*").alias("n_ref")), "subject").withColumns({f"{c}|r": F.col(f"`{c}|s`") for c in cols})
    else:
        early = ranked(df).where(F.col("_rank") <= n_ref)
        got = early.groupBy("subject").agg(F.count("*").alias("n_ref"), *[_quartiles(c).alias(f"{c}|r") for c in cols]).join(whole, "subject")
    iqr = lambda c, k: F.col(f"`{c}|{k}`")[2] - F.col(f"`{c}|{k}`")[0]
    out = [(F.col(f"`{c}|r`")[1].alias(f"{c}_centre"), divisor(iqr(c, "r"), iqr(c, "s"), F.lit(cohort.get(c)).cast("double")).alias(f"{c}_scale")) for c in cols]
    return got.select("subject", "n_ref", *[x for pair in out for x in pair])


def clipped(z: Column, clip: float) -> Column:
    """Missing as 0."""
    return F.when(z.isNull(), 0.0).otherwise(F.greatest(F.least(z, F.lit(clip)), F.lit(-clip)))


def zscores(df: DataFrame, cols: list[str], clip: float) -> DataFrame:
    """Scaled, clipped, missing as 0; needs the columns of centre_scale."""
    out = {c: clipped((finite(F.col(c)) - F.col(f"{c}_centre")) / F.col(f"{c}_scale"), clip) for c in cols}
    return df.withColumns(out).drop("n_ref", *[f"{c}_{k}" for c in cols for k in ("centre", "scale")])


def standardise(df: DataFrame, mode: str, cols: list[str], n_ref: int = 100, clip: float = 20.0, min_ref: int = 5) -> DataFrame:
    """baseline: by the first n_ref rows of a subject; subject: by all of them; none: as it is.  Time is never scaled.

    A subject with fewer than ``min_ref`` reference rows is an error in baseline mode.
    """
    if mode == "none":
        return df
    if mode not in ("baseline", "subject"):
        raise ValueError(f"unknown mode {mode!r}")
    cols = [c for c in cols if c != TIME]
    if not cols:
        return df
    df = shared.written(df, "unscaled")  # read for the cohort, the references and the result; what made it runs once
    cohort, first = cohort_spread(df, cols), n_ref if mode == "baseline" else None
    if quantiles.most_rows(df, "subject") > quantiles.LIMIT:
        refs = _centre_scale_large(df, cols, first, cohort)
        if mode == "baseline":
            few = F.col("n_ref") < min_ref
            refs = refs.withColumn("n_ref", F.when(few, F.raise_error(F.concat(F.lit("too few reference rows: "), "subject"))).otherwise(F.col("n_ref")))
            refs = refs.where("n_ref is not null")
        return zscores(df.join(refs, "subject"), cols, clip)
    def scaled(rows: pd.DataFrame) -> pd.DataFrame:
        at, group, n, centre, scale = _references(rows, cols, first, cohort)
        if mode == "baseline" and n.min() < min_ref:
            raise ValueError(f"too few reference rows: {rows['subject'].iat[at[n.argmin()]]}")
        x = rows[cols].to_numpy(dtype=np.float64)
        z = (np.where(np.isfinite(x), x, np.nan) - centre[group]) / scale[group]
        return rows.assign(**dict(zip(cols, np.where(np.isnan(z), 0.0, np.clip(z, -clip, clip)).T)))

    out = T.StructType([T.StructField(f.name, T.DoubleType()) if f.name in cols else f for f in df.schema])
    return by_subject(df, scaled, out, TIME)


def cell_extremes(scaled: DataFrame, cols: list[str]) -> DataFrame:
    """(subject, p99_abs, max_abs, frac_gt_10) of |z| over all cells."""
    scaled = shared.written(scaled.select("subject", *[F.col(c).cast("double").alias(c) for c in cols]), "scaled")
    most = quantiles.most_rows(scaled, "subject") * len(cols)
    if most <= quantiles.LIMIT:

        def extremes(rows: pd.DataFrame) -> pd.DataFrame:
            first, group = _groups(rows)
            v = np.abs(rows[cols].to_numpy(dtype=np.float64))
            high = _quantiles(np.repeat(group, len(cols)), v.ravel(), len(first), [0.99])[:, 0]
            size = np.bincount(group) * len(cols)
            return pd.DataFrame({"subject": rows["subject"].to_numpy()[first], "p99_abs": high, "max_abs": np.maximum.reduceat(v.max(axis=1), first), "frac_gt_10": np.bincount(group, (v > 10).sum(axis=1)) / size})

        return by_subject(scaled, extremes, T.StructType([scaled.schema["subject"], *[T.StructField(c, T.DoubleType()) for c in ("p99_abs", "max_abs", "frac_gt_10")]]))
    cells = scaled.select("subject", F.explode(F.array(*cols)).alias("z")).select("subject", F.abs("z").alias("v"))
    rest = [F.max("v").alias("max_abs"), F.avg((F.col("v") > 10).cast("int")).alias("frac_gt_10")]
    high = quantiles.quantiles(cells, ["subject"], [0.99], most).select("subject", F.col("q")[0].alias("p99_abs"))
    return high.join(cells.groupBy("subject").agg(*rest), "subject")


def with_outlier(df: DataFrame, factor: float = 5.0) -> DataFrame:
    """Subjects whose greatest |z| is over ``factor`` times the median subject's."""
    df = shared.written(df, "extremes")  # a row a subject, read for the median and for the result
    median = quantiles.of_table(df, {"max_abs": F.col("max_abs")}, 0.5)["max_abs"]
    return df.withColumn("outlier", F.col("max_abs") > factor * F.lit(median).cast("double"))


def scale_report(raw: DataFrame, scaled: DataFrame, cols: list[str]) -> DataFrame:
    """(subject, n_windows, first_t, p99_abs, max_abs, outlier)."""
    size = raw.groupBy("subject").agg(F.count("*").alias("n_windows"), F.min(TIME).alias("first_t"))
    return with_outlier(size.join(cell_extremes(scaled, cols).drop("frac_gt_10"), "subject"))
