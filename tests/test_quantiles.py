import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import quantiles, scaling
from pulsegrid.plans import loso

QS = [0.0, 0.25, 0.5, 0.99, 1.0]


def table(spark):
    """Groups of many kinds: continuous, ties, one value, few rows, none, infinities."""
    rng = np.random.default_rng(0)
    rows = [("normal", float(v)) for v in rng.normal(0, 1, 6000)] + [("ties", float(v)) for v in rng.integers(0, 3, 5000)]
    rows += [("one", 7.0)] * 3000 + [("few", 1.0), ("few", 2.0)] + [("none", None)] * 5
    rows += [("mixed", 0.0 if i % 2 else float(v)) for i, v in enumerate(rng.gamma(0.3, 1e6, 7000))] + [("mixed", None)] * 50
    rows += [("far", v) for v in (float("inf"), float("-inf"), 1e308, -1e308)] + [("far", float(v)) for v in rng.normal(0, 1e300, 900)]
    return spark.createDataFrame(rows, "k string, v double").repartition(5)


@pytest.mark.parametrize("limit", [1, 40, 1000, 10**6])
def test_quantiles_equal_percentile(spark, monkeypatch, limit):
    rows = table(spark)
    want = {r["k"]: r["q"] for r in rows.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, QS))).alias("q")).collect()}
    monkeypatch.setattr(quantiles, "LIMIT", max(limit, 300))  # a bracket holds about a hundredth of a group and cannot be narrowed below a few values
    got = {r["k"]: r["q"] for r in quantiles.quantiles(rows, ["k"], QS).collect()}
    assert got == want


def test_scaling_of_long_recordings_equals_the_plain_plan(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(s, float(5 * i), 1 + i % 3, float(rng.normal()), None if i % 7 == 0 else float(rng.integers(0, 4)), float(i < 150)) for s, n in (("a", 900), ("b", 60), ("c", 500)) for i in range(n)]
    df = spark.createDataFrame(rows, "subject string, t_start double, label int, x double, y double, z double")
    cols = ["x", "y", "z"]

    def results():
        out = [sorted(map(tuple, scaling.standardise(df, mode, cols).select("subject", "t_start", *cols).collect())) for mode in ("baseline", "subject")]
        out.append(sorted(map(tuple, scaling.scale_report(df, scaling.standardise(df, "baseline", cols), cols).collect())))
        out.append(sorted(map(tuple, loso.impute_train_median(df.where("subject <> 'b'"), df, cols).collect())))
        return out

    plain = results()
    monkeypatch.setattr(quantiles, "LIMIT", 400)
    assert results() == plain
