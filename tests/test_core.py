import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid import contract, queries
from pulsegrid.config import Config, one_hertz
from pulsegrid.functions import arrays as A
from pulsegrid.operators import diagnose, features, metrics, quality, scaling, scoring, timebase, windows
from pulsegrid.plans import export, loso
from pulsegrid.sources import ingest

CFG = one_hertz()


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_contract():
    assert len(contract.FEATURE_NAMES) == 42
    assert {k: len(v) for k, v in contract.FEATURE_SETS.items()} == {"all": 42, "no_temp": 36, "no_posture": 38, "clean": 34, "eda_only": 10, "hr_only": 7, "eda_hr": 17, "time_only": 1, "clean_plus_time": 35, "eda_plus_time": 11}
    for name in ("time_only", "clean_plus_time", "eda_plus_time"):
        with pytest.raises(contract.ContractError):
            contract.guard(contract.FEATURE_SETS[name], name)
    with pytest.raises(contract.ContractError):
        contract.guard(["other"])
    with pytest.raises(contract.ContractError):
        contract.exact(contract.FEATURE_NAMES[:-1])
    with pytest.raises(contract.ContractError):
        contract.resolve("eda_only", ["x"])


def test_array_statistics(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(100, 1, n).tolist()) for i, n in enumerate([1, 2, 5, 40])]
    df = frame(spark, rows, "i int, a array<double>").select("i", A.mean(F.col("a")).alias("m"), A.sd_pop(F.col("a")).alias("sd"), A.ls_slope(F.col("a"), 4.0).alias("s"), A.abs_integral(F.col("a"), 4.0).alias("g"))
    for r in df.collect():
        x = np.array(rows[r["i"]][1])
        assert r["m"] == pytest.approx(x.mean()) and r["sd"] == pytest.approx(x.std(), abs=1e-9) and r["g"] == pytest.approx(np.abs(x - x.mean()).sum() / 4, abs=1e-9)
        assert r["s"] is None if len(x) < 2 else r["s"] == pytest.approx(np.polyfit(np.arange(len(x)) / 4, x, 1)[0], abs=1e-9)


@pytest.mark.parametrize("seconds,count", [(59.9, 0), (60.0, 1), (64.9, 1), (65.0, 2)])
def test_grid_has_complete_windows_only(spark, seconds, count):
    assert windows.grid(frame(spark, [("s", seconds)], "subject string, duration double"), CFG).count() == count


@pytest.mark.parametrize("codes,reason", [([1] * 30 + [2] * 30, "impure"), ([1] * 54 + [2] * 6, None), ([1] * 53 + [2] * 7, "impure"), ([4] * 57 + [1] * 3, "out_of_scope")])
def test_majority_label(spark, codes, reason):
    labels = frame(spark, [("s", i, c) for i, c in enumerate(codes)], "subject string, sample_idx long, label int")
    grid = frame(spark, [("s", 0, 0.0), ("t", 0, 0.0)], "subject string, w long, t_start double")
    got = {r["subject"]: r for r in windows.majority_label(labels, grid, CFG).collect()}
    assert got["s"]["reason"] == reason and got["s"]["majority"] == codes[0] and got["t"]["reason"] == "empty"
    assert got["s"]["label"] == (codes[0] if reason is None else None)


def test_hr_block_edges(spark):
    rows = [("none", [20.0, 220.0, None]), ("one", [70.0]), ("some", [70.0, 10.0, 76.0])]
    df = frame(spark, rows, "subject string, hr array<double>").withColumn("baseline_hr", F.when(F.col("subject") == "some", 70.0))
    got = {r["subject"]: r for r in features.hr(df, CFG).collect()}
    assert all(got["none"][c] is None for c in contract.HR)
    assert got["one"]["hr_sd"] == 0 and got["one"]["hr_slope"] is None and got["one"]["hr_baseline_delta"] is None
    assert got["some"]["hr_slope"] == pytest.approx(6) and got["some"]["hr_baseline_delta"] == pytest.approx(3)


def test_imu_block_edges(spark):
    rows = [(n, [0.1] * n, [float(k % 2) for k in range(n)], [0.0] * n) for n in (3, 7, 8)]
    got = {r["n"]: r for r in features.imu(frame(spark, rows, "n int, acc_x array<double>, acc_y array<double>, acc_z array<double>"), Config()).collect()}
    assert all(got[3][c] is None for c in contract.IMU)
    assert got[7]["acc_y_peakfreq"] is None and got[7]["acc_y_mean"] is not None
    assert got[8]["acc_x_peakfreq"] == 0.0 and got[8]["motion_flag"] == 1.0


def test_rollup_gate_needs_more_than_half(spark):
    for flags, want in (([1, 1, 0, 0], 0.0), ([1, 1, 1, 0], 1.0)):
        df = frame(spark, [("s", 3 * k, float(f), float(f)) for k, f in enumerate(flags)], "subject string, w long, motion_flag double, motion_fraction double")
        r = features.rollup(df, ["motion_flag", "motion_fraction"], CFG).where("w = 0").first()
        assert r["motion_flag"] == want and r["motion_fraction"] == sum(flags) / 4


def test_eda_block_edges(spark):
    rows = [(n, [1.0 + (k % 5) * 0.001 for k in range(n)]) for n in (19, 25, 240)] + [(0, [1.0, None] * 30)]
    got = {r["n"]: r for r in features.eda(frame(spark, rows, "n int, eda array<double>"), Config()).collect()}
    assert all(got[n][c] is None for c in contract.EDA for n in (19, 0))
    assert got[25]["eda_scl_sd"] == 0 and got[25]["eda_scr_count"] == 0.0 and got[25]["eda_scr_amp_mean"] == 0.0


def feature_rows(spark, n_subjects=4, n=130, seed=0):
    rng = np.random.default_rng(seed)
    df = pd.DataFrame(rng.normal(size=(n_subjects * n, 42)), columns=contract.FEATURE_NAMES)
    df["subject"] = [f"s{k // n}" for k in range(len(df))]
    df["label"] = (np.arange(len(df)) // 10 % 3 + 1).astype(np.int32)
    df["label_name"] = df["label"].map(contract.LABEL_NAMES)
    df["t_start"] = (np.arange(len(df)) % n) * 5.0
    df.loc[df["label"] == 2, "eda_range"] += 3
    return spark.createDataFrame(df, ingest.FEATURE_TABLE)


def test_build_table_matches_slices(spark):
    """The window plan against plain numpy over one recording."""
    rng = np.random.default_rng(4)
    n, data = 80, {}
    for s in ("eda", "temp", "hr", "acc_x", "acc_y", "acc_z"):
        data[s] = rng.normal(60 if s == "hr" else 1, 0.1, n)
    samples = frame(spark, [("p", s, i, float(v)) for s, x in data.items() for i, v in enumerate(x)], "subject string, stream string, sample_idx long, v double")
    labels = frame(spark, [("p", i, 2) for i in range(n)], "subject string, sample_idx long, label int")
    got = {r["t_start"]: r for r in features.build_table(samples, labels, CFG).collect()}
    assert sorted(got) == [0.0, 5.0, 10.0, 15.0, 20.0]
    for t0, r in got.items():
        t = int(t0)
        blocks = [data["hr"][t + k : t + k + 15] for k in (0, 15, 30, 45)]
        assert r["hr_mean"] == pytest.approx(np.mean([b.mean() for b in blocks])) and r["hr_min"] == pytest.approx(min(b.min() for b in blocks))
        assert r["hr_sd"] == pytest.approx(np.mean([b.std() for b in blocks])) and r["hr_range"] == pytest.approx(np.mean([np.ptp(b) for b in blocks]))
        w = data["temp"][t : t + 60]
        assert r["temp_slope"] == pytest.approx(np.polyfit(np.arange(60), w, 1)[0]) and r["temp_baseline_delta"] == pytest.approx(w.mean() - data["temp"].mean())
        assert r["eda_range"] == pytest.approx(np.ptp(data["eda"][t : t + 60])) and r["eda_range_gated"] == pytest.approx(r["eda_range"] * (1 - r["motion_fraction"]))
        assert r["label_name"] == "stress"
    assert features.build_table(samples, labels, CFG, limit=2).count() == 2


def test_general_slices_equal_panes(spark):
    samples = frame(spark, [("p", "eda", i, float(i * i % 17)) for i in range(90)], "subject string, stream string, sample_idx long, v double")
    grid = windows.grid(timebase.durations(samples, None, CFG), CFG)
    a = {(r["w"]): r["s"] for r in timebase.slice_windows(samples, grid, CFG).groupBy("w").agg(F.sum("v").alias("s")).collect()}
    cells = windows.window_arrays(windows.panes(samples, CFG), CFG, ("eda",), ())
    b = {r["w"]: sum(r["eda"]) for r in cells.join(grid, ["subject", "w"]).collect()}
    assert a == b and len(a) == 7


def test_slices_of_any_start_and_rate_without_a_broadcast_of_windows(spark):
    cfg = Config(fs={"eda": 4.0, "temp": 0.7, "label": 1.0})
    samples = frame(spark, [("s", st, i, float(i)) for st, n in (("eda", 800), ("temp", 140), ("other", 9)) for i in range(n)], "subject string, stream string, sample_idx long, v double")
    starts = [0.0, 0.1, 5.0, 59.9, 60.0, 61.43, 119.99, 150.0, 400.0]
    wins = frame(spark, [("s", k, t) for k, t in enumerate(starts)], "subject string, w int, t_start double")
    rows = timebase.slice_windows(samples, wins, cfg)
    want = {(k, st, i) for k, t in enumerate(starts) for st, fs, n in (("eda", 4.0, 800), ("temp", 0.7, 140)) for i in range(n) if np.floor(t * fs) <= i < np.ceil((t + 60) * fs)}
    got = [(r["w"], r["stream"], r["sample_idx"]) for r in rows.collect()]
    assert len(got) == len(want) and set(got) == want
    assert "BroadcastHashJoin" not in rows._jdf.queryExecution().executedPlan().toString()  # the plan as it ran


@pytest.mark.parametrize("name", ["temp_features", "motion_gate", "rollup_short_windows", "cross_features"])
def test_complete_windows_are_told_by_a_row_a_subject(spark, name):
    plan = queries.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(sequence" not in plan  # the grid


def test_scaling_rungs_and_errors(spark):
    cols = ["eda_range"]
    rows = [("a", float(t), 5.0 if t < 100 else float(t)) for t in range(140)] + [("b", float(t), 1.0) for t in range(120)]
    df = frame(spark, rows, "subject string, t_start double, eda_range double")
    refs = {r["subject"]: r for r in scaling.centre_scale(df, cols, 100, {"eda_range": 0.0}).collect()}
    assert refs["a"]["eda_range_scale"] == pytest.approx(np.subtract(*np.percentile([r[2] for r in rows[:140]], [75, 25]))) and refs["b"]["eda_range_scale"] == 1.0
    z = scaling.zscores(df.limit(3).withColumn("eda_range", F.when(F.col("t_start") == 0, None).otherwise(F.col("t_start") * 100)).join(frame(spark, [("a", 5, 0.0, 4.0)], "subject string, n_ref int, eda_range_centre double, eda_range_scale double"), "subject"), cols, 20.0)
    assert sorted(r["eda_range"] for r in z.collect()) == [0.0, 20.0, 20.0]
    few = frame(spark, [("c", float(t), float(t)) for t in range(4)], "subject string, t_start double, eda_range double")
    with pytest.raises(Exception, match="too few reference rows"):
        scaling.standardise(few, "baseline", cols).collect()
    assert scaling.standardise(few.union(frame(spark, [("c", 9.0, 9.0)], few.schema)), "baseline", cols).count() == 5
    assert scaling.standardise(few, "none", cols) is few


def test_effect_size_edges(spark):
    rows = [("flat", 2, 1.0)] * 3 + [("flat", 1, 1.0)] * 3 + [("lone", 2, 1.0)] + [("lone", 1, float(k)) for k in range(3)]
    got = {r["subject"]: r for r in diagnose.responders(frame(spark, rows, "subject string, label int, x double"), ["x"]).collect()}
    assert got["flat"]["d_x"] == 0.0 and got["lone"]["d_x"] is None and got["lone"]["verdict"] == "responder"
    short = frame(spark, [("s", float(t), float(t)) for t in range(9)] + [("k", float(t), 1.0) for t in range(20)], "subject string, t_start double, x double")
    assert [(r["subject"], r["r"]) for r in diagnose.correlations(short, ["x"]).collect()] == [("k", None)]


def test_known_confusion_gives_known_scores(spark):
    rows = [("f", y, p) for (y, p), n in {(0, 0): 4262, (0, 1): 86, (1, 0): 284, (1, 1): 1564}.items() for _ in range(n)]
    preds = frame(spark, rows, "subject string, y int, yhat int")
    assert metrics.fold_metrics(preds, []).first()["macro_f1"] == pytest.approx(0.9263120961022027, abs=1e-12)
    assert [tuple(r) for r in metrics.confusion(preds, [0, 1, 2]).orderBy("y").collect()] == [(0, 4262, 86, 0), (1, 284, 1564, 0), (2, 0, 0, 0)]
    assert {r["class"]: r["support"] for r in metrics.per_class(preds).collect()}["macro"] == 6196


def test_table_round_trips(spark, tmp_path):
    df = feature_rows(spark, 2, 10)
    for fmt in ("parquet", "csv"):
        ingest.write_table(df, f"{tmp_path}/{fmt}", fmt)
        back = ingest.read_table(spark, f"{tmp_path}/{fmt}", df.schema, fmt)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    ingest.write_features(df, f"{tmp_path}/f")
    ingest.write_features(df.where("subject = 's0'").limit(3), f"{tmp_path}/f")
    back = ingest.load_features(spark, f"{tmp_path}/f")
    assert {r["subject"]: r["count"] for r in back.groupBy("subject").count().collect()} == {"s0": 3, "s1": 10} and back.columns == df.columns
    with pytest.raises(contract.ContractError):
        contract.check_columns(df.drop("hr_sd"))
    assert [r["subject"] for r in ingest.pending(df, df.where("subject = 's0'")).collect()] == ["s1"]


def test_loso_never_leaks_and_skips_single_class_folds(spark):
    df = feature_rows(spark, 3, 40)
    lonely = df.where("subject <> 's2'").withColumn("label", F.lit(1)).unionByName(df.where("subject = 's2'"))
    usable = {r["fold"]: r["usable"] for r in loso.folds(scaling.make_target(lonely, "binary")).collect()}
    assert usable == {"s0": True, "s1": True, "s2": False}
    got = loso.run(df, "binary", "rf", "eda_only", trees=loso.Trees(rf_trees=5, max_depth=4))
    assert got.predictions.count() == 120 and {r["subject"] for r in got.folds.collect()} == {"s0", "s1", "s2"}
    assert got.importance.agg(F.sum("importance_mean")).first()[0] == pytest.approx(1)
    assert got.summary.first()["balanced_acc_mean"] > 0.7


def test_registered_runs_take_every_fold_task_and_set(spark, monkeypatch):
    """A fold per subject up to the bound, both tasks and the eight sets of the sweep; the operators' own defaults are whole."""
    from pulsegrid import queries_model

    calls, df = [], feature_rows(spark, 4, 5)

    class Done:
        summary = permutation = spark.createDataFrame([("t", "m", "all", 0.0)], "task string, model string, feature_set string, balanced_acc_mean double")

    def noted(df, task, model, feature_set, seed=0, mode="baseline", permutation=False, k=None, trees=loso.Trees(), threads=4, scaled=None):
        calls.append((task, model, feature_set, k, trees))
        return Done

    monkeypatch.setattr(queries_model.X, "features", lambda *_: df)
    monkeypatch.setattr(loso, "run", noted)
    for q in (queries_model.loso_rf, queries_model.loso_gbt, queries_model.permutation_importance, queries_model.ablation_sweep):
        q(spark, "")
    assert {c[4] for c in calls} == {queries_model.TREES} and loso.Trees() == loso.Trees(400, 300, 30)
    assert [c[3] for c in calls] == [None, None, 3] + [3] * 16  # of four subjects
    assert len(calls) == 3 + 16 and len({c[:3] for c in calls[3:]}) == 16
    assert loso.groups(df) is None and loso.groups(df, 3) == 3


def test_gaps_are_filled_from_the_train_side_only(spark, monkeypatch):
    """Mode none: the held-out subject's values, far from all others, must not move the medians."""
    rows = [(f"s{i % 3}", 1 + (i // 3) % 3, float(i), 1000.0 if i % 3 == 0 else None if i % 4 == 0 else 5.0) for i in range(90)]
    df = spark.createDataFrame(rows, "subject string, label int, t_start double, eda_scl_mean double")
    seen, fill = [], loso.impute_train_median

    def noted(train, other, cols):
        out = fill(train, other, cols)
        seen.append(({r["subject"] for r in train.select("subject").distinct().collect()}, {r["eda_scl_mean"] for r in out.select("eda_scl_mean").distinct().collect()}, {r["subject"] for r in other.select("subject").distinct().collect()}))
        return out

    monkeypatch.setattr(loso, "impute_train_median", noted)
    got = loso.run(df, "binary", "rf", "eda_only", mode="none", trees=loso.Trees(rf_trees=3, max_depth=3), threads=1)
    assert got.predictions.count() == 90
    assert all(len(train) == 2 for train, *_ in seen)
    assert next(values for train, values, other in seen if other == {"s0"} and "s0" not in train) == {1000.0}
    assert next(values for train, values, other in seen if other == train == {"s1", "s2"}) == {5.0}


def test_results_are_saved_by_tag(spark, tmp_path):
    got = loso.run(feature_rows(spark, 3, 30), "binary", "rf", "eda_only", trees=loso.Trees(rf_trees=3, max_depth=3))
    for _ in range(2):  # a rerun replaces its own part
        loso.save_results(got, f"{tmp_path}/r", "binary", "rf", "eda_only", "baseline")
    loso.save_results(got, f"{tmp_path}/r", "binary", "rf", "clean", "baseline")
    for name, n in (("folds", 3), ("summary", 1), ("confusion", 2)):
        back = spark.read.parquet(f"{tmp_path}/r/{name}")
        assert {(r["feature_set"], r["count"]) for r in back.groupBy("feature_set").count().collect()} == {("eda_only", n), ("clean", n)}
    for _ in range(2):
        loso.save_table(got.summary, f"{tmp_path}/sweep", "task", "model")
        loso.save_table(got.folds, f"{tmp_path}/plain")
    assert spark.read.parquet(f"{tmp_path}/sweep").count() == 1 and spark.read.parquet(f"{tmp_path}/plain").count() == 3


def test_alignment_equals_both_lookups(spark):
    """Half-rate labels with gaps in the track, samples beyond its end."""
    cfg = Config(fs=one_hertz().fs | {"label": 0.5})
    label = {i: (i // 3) % 3 + 1 for i in range(20) if i not in (7, 8, 13)}
    samples = spark.createDataFrame([("s", "eda", i, 1.0) for i in range(50)], "subject string, stream string, sample_idx long, v double")
    labels = spark.createDataFrame([("s", i, c) for i, c in label.items()], "subject string, sample_idx long, label int")
    near = [(label.get(min(round(i / 2), 19)), label.get(min(i // 2, 19))) for i in range(50)]
    want = sum(a is not None and b is not None and a != b for a, b in near)
    assert want and [tuple(r) for r in quality.check_alignment(samples, labels, cfg).collect()] == [("s", "alignment", str(want))]


def test_acceptance_report_is_the_union_of_the_checks(spark):
    cfg = one_hertz()
    rows = [("a", s, i, None if s == "eda" and i == 3 else -1.0 if s == "eda" else 50.0) for s in cfg.fs if s not in ("label", "hr") for i in range(20 if s == "acc_z" else 40)]
    samples = spark.createDataFrame(rows, "subject string, stream string, sample_idx long, v double")
    labels = spark.createDataFrame([("a", i, 1 + i % 2) for i in range(40)], "subject string, sample_idx long, label int")
    single = [quality.check_streams(samples, cfg), quality.check_duration_spread(samples, labels, cfg), quality.check_nulls(samples), quality.check_ranges(samples), quality.check_classes(labels, cfg), quality.check_label_share(labels, cfg), quality.check_alignment(samples, labels, cfg)]
    got = sorted(map(tuple, quality.acceptance_report(samples, labels, cfg).collect()))
    assert got == sorted(tuple(r) for d in single for r in d.collect())
    assert {c for _, c, _ in got} == {"streams", "axes", "duration", "nulls", "eda_range", "temp_range", "class", "share"}
    empty = quality.acceptance_report(samples.limit(0), labels.limit(0), cfg)
    assert empty.collect() == []


@pytest.mark.parametrize("mode", ["baseline", "subject"])
def test_standardise_makes_its_input_once(spark, mode):
    calls = spark.sparkContext.accumulator(0)
    df = feature_rows(spark, 2, 30).select(*contract.FEATURE_SETS["eda_only"], *contract.META)

    def seen(parts):
        for p in parts:
            calls.add(len(p))
            yield p

    scaled = scaling.standardise(df.mapInPandas(seen, df.schema), mode, contract.FEATURE_SETS["eda_only"])
    assert scaled.count() == 60 and calls.value == 60


def test_a_sweep_makes_runs_of_the_same_columns_once(spark, monkeypatch):
    df = feature_rows(spark, 3, 30).select(*contract.FEATURE_SETS["eda_only"], *contract.META)
    sets, made, run = ["all", "eda_only", "time_only"], [], loso.run
    monkeypatch.setattr(loso, "run", lambda *a, **k: made.append((a, k)) or run(*a, **k))
    got = {r["feature_set"]: r for r in loso.sweep(df, ["binary"], ["rf"], sets, trees=loso.Trees(rf_trees=2, max_depth=2)).collect()}
    assert [a[3] for a, _ in made] == ["all", "time_only"] and set(got) == set(sets)
    a, k = made[0]
    own = run(*a[:3], "eda_only", *a[4:], **k).summary.first()
    assert [got["eda_only"][c] for c in own.asDict()] == list(own)


def test_grouped_folds_keep_scores_by_subject(spark):
    got = loso.run(feature_rows(spark, 5, 40), "binary", "rf", "eda_only", k=2, trees=loso.Trees(rf_trees=3, max_depth=3))
    assert {r["subject"] for r in got.folds.collect()} == {f"s{i}" for i in range(5)}


def test_permuted_shuffles_within_folds_without_gathering_one(spark):
    rows = [("a" if i % 3 else "b", f"s{i % 7}", float(i), float(i), float(-i), i % 2) for i in range(500)]
    df = spark.createDataFrame(rows, "fold string, subject string, t_start double, v double, u double, y int")
    places = loso.numbered(df.repartition(5), ["fold"], "t_start").select("fold", "t_start", "_r").collect()
    for fold in "ab":
        mine = sorted((r["t_start"], r["_r"]) for r in places if r["fold"] == fold)
        assert [r for _, r in mine] == list(range(len(mine)))
    got = loso.permuted(df, ["v", "u"], 3, 2).collect()
    hashes = {(r["c"], r["k"], r["subject"], r["t_start"]): r["h"] for r in df.crossJoin(spark.createDataFrame([(c, k) for c in "uv" for k in (0, 1)], "c string, k int")).select("c", "k", "subject", "t_start", F.xxhash64(F.lit(3) + F.col("k"), "c", "subject", "t_start").alias("h")).collect()}
    want = []
    for c, at in (("v", 3), ("u", 4)):
        for k in (0, 1):
            for fold in "ab":
                mine = sorted((r for r in rows if r[0] == fold), key=lambda r: (r[1], r[2]))
                order = sorted(mine, key=lambda r: hashes[c, k, r[1], r[2]])
                want += [(c, k, *r[:3], o[3] if c == "v" else r[3], o[4] if c == "u" else r[4]) for r, o in zip(mine, order)]
    assert sorted((r["_c"], r["_k"], r["fold"], r["subject"], r["t_start"], r["v"], r["u"]) for r in got) == sorted(want)


def test_permutation_drops_equal_a_column_at_a_time(spark):
    rng = np.random.default_rng(2)
    rows = [("f", f"s{i % 3}", float(i), float(rng.normal(i % 2, 0.3)), float(rng.normal()), i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "fold string, subject string, t_start double, v double, u double, y int")
    cols = ["v", "u"]
    fitted = loso.make_estimator("rf", "binary", 0, loso.Trees(rf_trees=5, max_depth=3)).fit(loso.assemble(df.withColumn("weight", F.lit(1.0)), cols))
    accuracy = lambda d: d.select(F.avg((F.col("y") == F.col("prediction")).cast("int"))).first()[0]
    whole, got = accuracy(fitted.transform(loso.assemble(df, cols))), dict(loso.permutation_drops(df, fitted, cols, 7, 3))
    for c in cols:
        each = [whole - accuracy(fitted.transform(loso.assemble(loso.permuted(df, [c], 7, 3).where(F.col("_k") == k), cols))) for k in range(3)]
        assert got[c] == pytest.approx(sum(each) / 3)
    assert got["v"] > 0.2 > abs(got["u"])


def test_export_load_and_score(spark, tmp_path):
    df = feature_rows(spark, 3, 120)
    with pytest.raises(contract.ContractError):
        export.fit_final(df, "binary", "rf", "time_only")
    model, sidecar = export.fit_final(df, "3class", "rf", "eda_only", trees=loso.Trees(rf_trees=5, max_depth=4))
    export.save(spark, model, sidecar, f"{tmp_path}/m")
    model, sidecar = export.load(spark, f"{tmp_path}/m")
    cols = sidecar["feature_names"]
    refs = scoring.wearer_reference(df.where("subject <> 's0' or t_start < 100"), cols, sidecar["n_ref"], sidecar["cohort_iqr"])
    assert {r["subject"]: r["ready"] for r in refs.collect()} == {"s0": False, "s1": True, "s2": True}
    out = scoring.score(df, refs, model, sidecar).collect()
    assert {r["subject"] for r in out} == {"s1", "s2"} and min(r["t_start"] for r in out) == 500.0
    assert all(sum(r["probabilities"].values()) == pytest.approx(1) and r["state"] in ("baseline", "stress", "amusement") for r in out)
    with pytest.raises(contract.ContractError):
        scoring.score(df.drop(cols[0]), refs, model, sidecar)
    old = json.dumps({**sidecar, "spark_version": "0"})
    spark.createDataFrame([(old,)], "value string").coalesce(1).write.mode("overwrite").text(f"{tmp_path}/m/contract")
    with pytest.raises(contract.ContractError):
        export.load(spark, f"{tmp_path}/m")
