"""Fits by weighted cells of binned rows."""

import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import scaling, scoring
from pulsegrid.plans import export, loso

COLS = ["eda_scl_mean", "eda_range"]


def table(spark, subjects=4, rows=60):
    rnd = random.Random(5)
    data = [(f"s{s}", (y := 1 + rnd.randrange(3)), float(t), rnd.gauss(y, 1), float(rnd.randrange(4))) for s in range(subjects) for t in range(rows)]
    return spark.createDataFrame(data, "subject string, label int, t_start double, eda_scl_mean double, eda_range double")


def test_boosting_by_cells_predicts_as_by_rows(spark, monkeypatch):
    df = table(spark).withColumn("y", (F.col("label") == 2).cast("int"))
    binner, bins = loso.bucketizer(df, COLS), [f"{c}_bin" for c in COLS]
    rows = loso.assemble(binner.transform(df), bins)
    monkeypatch.setattr(loso, "WHOLE", 1)
    counted = loso.cells(rows, bins, "subject")
    assert counted.count() < 240 and counted.agg(F.sum("_n")).first()[0] == 240
    few = loso.assemble(loso.weighted(counted, bins), bins)
    assert few.agg(F.sum("weight")).first()[0] == pytest.approx(240)
    est = loso.make_estimator("gbt", "binary", 0, loso.Trees(gbt_rounds=3, max_depth=3))
    whole = est.fit(rows.join(loso.class_weights(rows), "y")).transform(rows).orderBy("subject", "t_start").select("probability").collect()
    got = est.fit(few).transform(rows).orderBy("subject", "t_start").select("probability").collect()
    assert all(a[0][1] == pytest.approx(b[0][1], abs=1e-9) for a, b in zip(got, whole))


def test_expected_drops_are_the_mean_over_all_orders(spark):
    df = spark.createDataFrame([("s", float(i), i % 2, float(i % 3), float(i // 2)) for i in range(5)], "subject string, t_start double, y int, a_bin double, b_bin double")
    fitted = loso.make_estimator("rf", "binary", 0, loso.Trees(rf_trees=3, max_depth=3)).fit(loso.assemble(df.withColumn("weight", F.lit(1.0)), ["a_bin", "b_bin"]))
    rows = df.collect()
    got = dict(loso.expected_drops(df.withColumn("_n", F.lit(1)), fitted, ["a", "b"]))
    right = lambda data: loso.assemble(fitted.transform(loso.assemble(spark.createDataFrame(data, "o int, y int, a_bin double, b_bin double"), ["a_bin", "b_bin"])).drop("x"), ["a_bin"]).groupBy("o").agg(F.avg((F.col("y") == F.col("prediction")).cast("int")).alias("r"))
    whole = right([(0, r["y"], r["a_bin"], r["b_bin"]) for r in rows]).first()["r"]
    for c in ("a", "b"):
        data = []
        for o, order in enumerate(permutations(range(5))):
            for r, k in zip(rows, order):
                v = {n: r[n] for n in ("a_bin", "b_bin")} | {f"{c}_bin": rows[k][f"{c}_bin"]}
                data.append((o, r["y"], v["a_bin"], v["b_bin"]))
        assert got[c] == pytest.approx(whole - right(data).agg(F.avg("r")).first()[0])


def test_runs_and_the_final_model_by_cells(spark, monkeypatch, tmp_path):
    df = table(spark)
    monkeypatch.setattr(loso, "WHOLE", 100)
    got = loso.run(df, "binary", "rf", "eda_only", permutation=True, trees=loso.Trees(rf_trees=3, max_depth=3))
    assert got.predictions.count() == 240 and got.folds.count() == 4
    assert {r["feature"] for r in got.permutation.collect()} == set(COLS) == {r["feature"] for r in got.importance.collect()}
    model, sidecar = export.fit_final(df, "3class", "rf", "eda_only", trees=loso.Trees(rf_trees=3, max_depth=3))
    assert sidecar["n_train_windows"] == 240
    export.save(spark, model, sidecar, f"{tmp_path}/m")
    model, sidecar = export.load(spark, f"{tmp_path}/m")
    refs = scoring.wearer_reference(df, COLS, 10, sidecar["cohort_iqr"])
    assert scoring.score(df, refs, model, sidecar | {"n_ref": 10}).where("state is not null").count() == 200


def test_runs_take_the_same_way_whatever_the_tables_size(spark, monkeypatch):
    """Neither fits nor importance by permutation change with the bound of the final model: no orders are drawn and rows are fitted."""
    monkeypatch.setattr(loso, "permutation_drops", None)
    got = []
    for whole in (1, 500_000):
        monkeypatch.setattr(loso, "WHOLE", whole)
        run = loso.run(table(spark, 3, 20), "binary", "rf", "eda_only", permutation=True, trees=loso.Trees(rf_trees=3, max_depth=3))
        got.append([sorted(d.collect()) for d in (run.predictions, run.permutation, run.importance)])
    assert got[0] == got[1] and len(got[0][0]) == 60 and len(got[0][1]) == 2


@pytest.mark.parametrize("kind,task", [("rf", "3class"), ("gbt", "binary")])
def test_cells_by_a_models_thresholds_predict_as_their_rows(spark, kind, task):
    """Also of values on a threshold."""
    df = scaling.make_target(table(spark), task)
    fitted = loso.make_estimator(kind, task, 0, loso.Trees(rf_trees=4, gbt_rounds=3, max_depth=4)).fit(loso.assemble(df.withColumn("weight", F.lit(1.0)), COLS))
    found = loso.told_apart(df, fitted, COLS)
    on = found.select("y", *[F.col(f"{c}_bin").alias(c) for c in COLS])
    bins = [f"{c}_bin" for c in COLS]
    for rows in (df.select("y", *COLS), on):
        want = fitted.transform(loso.assemble(rows, COLS)).groupBy("y", "prediction").count().collect()
        got = fitted.transform(loso.assemble(loso.told_apart(rows, fitted, COLS), bins)).groupBy("y", "prediction").agg(F.sum("_n").alias("n")).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert found.count() < 240


def test_registered_runs_have_the_same_folds_at_every_size(spark, monkeypatch):
    """A fold per subject also of twelve subjects, and three groups also of two."""
    from pulsegrid import queries_model

    calls = []
    monkeypatch.setattr(loso, "groups", None)
    monkeypatch.setattr(loso, "run", lambda *a, k=None, **kw: calls.append(k) or type("Done", (), {"summary": None, "permutation": None}))
    monkeypatch.setattr(loso, "sweep", lambda *a, k=None, **kw: calls.append(k))
    for n in (2, 12):
        monkeypatch.setattr(queries_model.X, "features", lambda *_: table(spark, n, 2))
        for q in (queries_model.loso_rf, queries_model.loso_gbt, queries_model.permutation_importance, queries_model.ablation_sweep):
            q(spark, "")
    assert calls == [None, None, 3, 3] * 2
