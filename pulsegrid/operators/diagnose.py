"""Diagnostics of confounds and of single subjects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.contract import TIME
from pulsegrid.functions.arrays import finite
from pulsegrid.operators import scaling

RESPONDER_FEATURES = ["eda_scl_mean", "eda_range", "eda_scr_count", "eda_scr_amp_sum"]


def _long(df: DataFrame, cols: list[str], keep: list[str]) -> DataFrame:
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("position"), F.lit(c).alias("feature"), finite(F.col(c)).alias("v")) for k, c in enumerate(cols)])).alias("x")
    return df.select(*keep, cells).select(*keep, "x.*")


def correlations(df: DataFrame, cols: list[str], least: int = 10) -> DataFrame:
    """(subject, feature, r) with elapsed time; null with too few pairs or without spread."""
    time_ok = df.groupBy("subject").agg(F.count("*").alias("rows"), (F.max(TIME) > F.min(TIME)).alias("moves")).where((F.col("rows") >= least) & F.col("moves")).select("subject")
    cells = _long(df, cols, ["subject", TIME]).join(time_ok, "subject", "left_semi").where("v is not null")
    r = F.try_divide(F.covar_pop("v", TIME), F.stddev_pop("v") * F.stddev_pop(TIME))
    spread = (F.max("v") > F.min("v")) & (F.max(TIME) > F.min(TIME))
    got = cells.groupBy("subject", "feature").agg(r.alias("r"), F.count("*").alias("n"), spread.alias("ok"))
    return got.select("subject", "feature", F.when((F.col("n") >= least) & F.col("ok"), F.col("r")).alias("r"))


def time_confound(df: DataFrame, cols: list[str], top: int | None = None) -> DataFrame:
    """(feature, mean_abs_r, sd_abs_r, mean_signed_r, flag), strongest first."""
    a = F.abs("r")
    out = correlations(df, cols).groupBy("feature").agg(F.avg(a).alias("mean_abs_r"), F.stddev_samp(a).alias("sd_abs_r"), F.avg("r").alias("mean_signed_r"))
    out = out.withColumn("flag", F.when(F.col("mean_abs_r") > 0.8, "strong").when(F.col("mean_abs_r") > 0.5, "moderate").otherwise("")).orderBy(F.col("mean_abs_r").desc_nulls_last(), "feature")
    return out if top is None else out.limit(top)


def cohens_d(c: str, one: Column, other: Column) -> Column:
    """Difference of means over the pooled sample deviation; null with under two rows on a side, 0 without spread."""
    v = finite(F.col(c))
    a, b = F.when(one, v), F.when(other, v)
    n, m = F.count(a), F.count(b)
    pooled = F.sqrt(F.try_divide((n - 1) * F.var_samp(a) + (m - 1) * F.var_samp(b), n + m - 2))
    return F.when((n >= 2) & (m >= 2), F.when(pooled == 0, 0.0).otherwise(F.try_divide(F.avg(a) - F.avg(b), pooled)))


def responders(df: DataFrame, cols: list[str] = RESPONDER_FEATURES) -> DataFrame:
    """(subject, n_stress, n_rest, d_<feature>..., verdict) of stress against the other labels; an unknown d counts as responder."""
    stress = F.col("label") == scaling.STRESS
    got = df.groupBy("subject").agg(F.count_if(stress).alias("n_stress"), F.count_if(~stress).alias("n_rest"), *[cohens_d(c, stress, ~stress).alias(f"d_{c}") for c in cols])
    d = F.abs(F.col(f"d_{cols[0]}"))
    return got.withColumn("verdict", F.when(d < 0.2, "non-responder").when(d < 0.5, "weak").otherwise("responder"))


def baseline_ref_health(df: DataFrame, cols: list[str], seconds: float = 600.0) -> DataFrame:
    """(subject, n_ref, min_sd, n_zero_sd, worst_feature, thin) of the rows before ``seconds``; without any: 0, null, -1, ''."""
    subjects = df.select("subject").distinct()
    early = df.where(F.col(TIME) < seconds)
    sizes = early.groupBy("subject").agg(F.count("*").alias("n_ref"))
    sd = _long(early, cols, ["subject"]).groupBy("subject", "feature", "position").agg(F.stddev_samp("v").alias("sd"), (F.min("v") == F.max("v")).alias("flat"))
    sd = sd.withColumn("sd", F.when(F.col("flat") & F.col("sd").isNotNull(), 0.0).otherwise(F.col("sd")))
    worst = sd.groupBy("subject").agg(F.min("sd").alias("min_sd"), F.count_if(F.col("sd") == 0).alias("n_zero_sd"), F.min_by("feature", F.when(F.col("sd").isNotNull(), F.struct("sd", "position"))).alias("worst_feature"))
    out = subjects.join(sizes, "subject", "left").join(worst, "subject", "left")
    n = F.coalesce("n_ref", F.lit(0))
    return out.select("subject", n.alias("n_ref"), "min_sd", F.coalesce("n_zero_sd", F.lit(-1)).alias("n_zero_sd"), F.coalesce("worst_feature", F.lit("")).alias("worst_feature"), (n < 20).alias("thin"))


def blowup(scaled: DataFrame, cols: list[str]) -> DataFrame:
    """(subject, p99_abs, max_abs, frac_gt_10, outlier)."""
    return scaling.with_outlier(scaling.cell_extremes(scaled, cols))


def verdict(resp: DataFrame, blow: DataFrame, subjects: list[str] | None = None) -> DataFrame:
    """(subject, cause) of subjects known to both."""
    both = resp.join(blow, "subject")
    if subjects is not None:
        both = both.where(F.col("subject").isin(subjects))
    return both.select("subject", F.when(F.col("outlier"), "blow-up").when(F.col("verdict") == "non-responder", "non-responder").otherwise("neither").alias("cause"))
