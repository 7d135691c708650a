"""Rows after a warm-up of the same table: one exchange, no join, no Python, and the rows that references beside them give."""

import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from pulsegrid.operators import scaling, scoring
from pulsegrid.sources import fixtures

SF = "/root/testdata/sf0.001"
COLS = ["a", "b", "flat", "empty", "late"]


def table(spark):
    rnd = random.Random(5)
    odd = lambda: rnd.choice([None, math.nan, math.inf, -math.inf, 1.0, 2.0, 5.0, 1e300])
    sizes = {"short": 9, "just": 10, "one": 11, "long": 60, "wide": 200}
    data = [(s, float(t), odd(), rnd.gauss(0, 3), 4.0 if s != "wide" else float(t), None if t < 10 else 1.0, 0.0 if t < 10 else float(t)) for s, n in sizes.items() for t in range(n)]
    rnd.shuffle(data)
    return spark.createDataFrame(data, "subject string, t_start double, " + ", ".join(f"{c} double" for c in COLS)).repartition(3)


@pytest.mark.parametrize("cohort", [{"a": 2.0, "b": 1.5, "flat": 0.5, "empty": 3.0, "late": 7.0}, {"late": 0.0, "flat": None}, None])
def test_warmed_rows_equal_ready_rows(spark, cohort):
    df = table(spark)
    spreads = scaling.cohort_spread(df, COLS) if cohort is None else cohort
    want = scoring.ready_rows(df, scoring.wearer_reference(df, COLS, 10, spreads), COLS, 10).select(df.columns).collect()
    got = scoring.warmed_rows(df, COLS, 10, cohort).select(df.columns).collect()
    assert sorted(got) == sorted(want) and {r["subject"] for r in got} == {"one", "long", "wide"} and len(got) == 1 + 50 + 190


def test_only_columns_without_a_spread_ask_for_the_cohort(spark, monkeypatch):
    asked, known = [], scaling.cohort_spread
    monkeypatch.setattr(scaling, "cohort_spread", lambda df, cols: asked.append(cols) or known(df, cols))
    scoring.warmed_rows(table(spark), COLS, 10)
    scoring.warmed_rows(table(spark).where("subject = 'wide'"), ["b", "flat"], 10)
    assert asked == [["flat", "empty", "late"]]


def test_rows_dealt_out_by_subject_are_moved_once(spark):
    plan = lambda df: scoring.warmed_rows(df.select("subject", "t_start", "z1", "z2"), ["z1", "z2"], 590, {})._jdf.queryExecution().executedPlan().toString()
    dealt = fixtures.features(spark, SF, "subject")
    for text, moves in ((plan(dealt), 1), (plan(fixtures.features(spark, SF)), 2)):
        assert text.count("Exchange ") == moves and "Join" not in text and "InPandas" not in text
    assert dealt.exceptAll(fixtures.features(spark, SF)).count() == 0


def test_score_ready_rows_moves_nothing_after_its_table_is_written(spark):
    plan = __spark_entry__.queries()["score_ready_rows"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "InPandas" not in plan


def test_scores_by_own_first_rows_equal_those_by_references(spark):
    from pulsegrid.plans import export, loso

    rnd = random.Random(7)
    cols = ["eda_scl_mean", "eda_range"]
    df = spark.createDataFrame([(s, 1 + t // 7 % 3, float(t), rnd.gauss(t // 7 % 3, 1), 1.0) for s in "abc" for t in range(120)], "subject string, label int, t_start double, eda_scl_mean double, eda_range double")
    model, sidecar = export.fit_final(df, "3class", "rf", "eda_only", trees=loso.Trees(rf_trees=3, max_depth=3))
    refs = scoring.wearer_reference(df, cols, sidecar["n_ref"], sidecar["cohort_iqr"])
    key = lambda d: sorted((r["subject"], r["t_start"], r["state"]) for r in d.select("subject", "t_start", F.col("state")).collect())
    assert key(scoring.score(df, None, model, sidecar)) == key(scoring.score(df, refs, model, sidecar)) and len(key(scoring.score(df, None, model, sidecar))) == 60


def test_score_ready_rows_scores_all_rows_after_the_usual_warm_up(spark):
    """Nearly all rows of a wearer are after the warm-up, not the few after its 590th."""
    sizes = fixtures.features(spark, SF).groupBy("subject").count().collect()
    got = {r["subject"]: r["count"] for r in __spark_entry__.queries()["score_ready_rows"](spark, SF).groupBy("subject").count().collect()}
    assert got == {r["subject"]: r["count"] - 100 for r in sizes if r["count"] > 100}
