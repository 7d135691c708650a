"""Scaling of many subjects: one exchange, subjects cut by batches, and spreads of whole columns by rounds."""

import math
import random

from pulsegrid.operators import quantiles, scaling


def table(spark, subjects, rows):
    rnd = random.Random(3)
    data = [(f"s{s}", 1, float(t), rnd.choice([None, math.nan, 1.0, 2.0, 5.0]), rnd.gauss(0, 1 + s), 7.0) for s in range(subjects) for t in range(rows)]
    return spark.createDataFrame(data, "subject string, label int, t_start double, a double, b double, c double")


def test_scaling_moves_rows_once(spark):
    plan = scaling.standardise(table(spark, 5, 20), "baseline", ["a", "b", "c"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan


def test_subjects_cut_by_batches_are_scaled_whole(spark):
    df, cols, key = table(spark, 7, 41), ["a", "b", "c"], lambda r: (r["subject"], r["t_start"])
    whole = sorted(scaling.standardise(df, "baseline", cols, 10).collect(), key=key)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 13)
    try:
        cut = sorted(scaling.standardise(df, "baseline", cols, 10).collect(), key=key)
        got = {r["subject"]: r.asDict() for r in scaling.cell_extremes(df.fillna(0.0), cols).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert cut == whole and len(got) == 7
    want = scaling._centre_scale_large(df, cols, 10, {"c": 2.0}).collect()
    assert {r["subject"]: r.asDict() for r in want} == {r["subject"]: r.asDict() for r in scaling.centre_scale(df, cols, 10, {"c": 2.0}).collect()}


def test_spreads_of_columns_by_rounds_equal_percentile(spark, monkeypatch):
    df, cols = table(spark, 6, 50), ["a", "b", "c"]
    want = scaling.cohort_spread(df, cols)
    for limit in (40, 5):
        monkeypatch.setattr(quantiles, "LIMIT", limit)
        assert scaling.cohort_spread(df, cols) == want
    assert scaling.cohort_spread(df.where("a > 9"), ["a"]) == {"a": None}
