"""Registered queries of quality, scaling, diagnostics, evaluation, scoring and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid import contract
from pulsegrid.config import Config
from pulsegrid.operators import diagnose, metrics, quality, scaling, scoring
from pulsegrid.plans import export, loso
from pulsegrid.queries import CFG, DEFECT, FEAT, PRED, REC, R, query, rounded, table_sql
from pulsegrid.sources import fixtures as X
from pulsegrid.sources import ingest, shared
from pulsegrid.streaming import live

COLS = X.FEATS
SWEEP_SETS = ["all", "no_posture", "no_temp", "clean", "eda_only", "time_only", "clean_plus_time", "eda_plus_time"]

# ---- tables ------------------------------------------------------------------------------------------------------


@query(f"WITH {FEAT} SELECT * FROM feat")
def table_round_trip(spark, sf):
    """The feature table written as compressed CSV, read, written as JSON by subject and read again."""
    df, path = X.features(spark, sf), shared.folder(spark, "round_trip")
    ingest.write_table(df, f"{path}/csv", "csv")
    back = ingest.read_table(spark, f"{path}/csv", df.schema, "csv")
    ingest.write_table(back.withColumn("part", F.pmod(F.hash("subject"), F.lit(8))), f"{path}/json", "json", ["part"])
    return ingest.read_table(spark, f"{path}/json", df.schema, "json").select(df.columns)


@query(f"WITH {FEAT} SELECT * FROM feat")
def robust_scale_none(spark, sf):
    """Mode none leaves every value, gaps included."""
    return scaling.standardise(X.features(spark, sf), "none", COLS)


# ---- acceptance --------------------------------------------------------------------------------------------------

STREAMS = """SELECT subject, 'streams' AS "check", array_to_string(list_sort(list_filter(['acc_x', 'acc_y', 'acc_z', 'eda', 'hr', 'temp'], lambda s: NOT list_contains(has, s))), ',') AS detail
    FROM (SELECT subject, list(DISTINCT stream) AS has FROM dlong GROUP BY subject) WHERE len(has) < 6
    UNION ALL SELECT subject, 'axes', 'unequal' FROM (SELECT subject, stream, count(*) AS n FROM dlong WHERE stream LIKE 'acc%' GROUP BY ALL) GROUP BY subject HAVING count(DISTINCT n) > 1"""
SPREAD = """SELECT subject, 'duration' AS "check", printf('%.1f', (max(n) - min(n))::DOUBLE) AS detail FROM (
    SELECT subject, stream, max(i) + 1 AS n FROM dlong GROUP BY ALL UNION ALL SELECT subject, 'label', max(i) + 1 FROM dlab GROUP BY subject) GROUP BY subject HAVING max(n) - min(n) > 5"""
NULLS = """SELECT subject, 'nulls' AS "check", stream || ':' || count(*)::VARCHAR AS detail FROM dlong WHERE v IS NULL GROUP BY subject, stream"""
RANGES = """SELECT subject, 'eda_range' AS "check", 'low' AS detail FROM dlong WHERE stream = 'eda' GROUP BY subject HAVING min(v) < -0.5
    UNION ALL SELECT subject, 'temp_range', 'median' FROM dlong WHERE stream = 'temp' GROUP BY subject HAVING NOT quantile_cont(v, 0.5) BETWEEN 10 AND 45"""
CLASSES = """SELECT s.subject, 'class' AS "check", c::VARCHAR AS detail FROM (SELECT DISTINCT subject FROM dlab) s, (SELECT unnest([1, 2, 3]) AS c)
    WHERE NOT EXISTS (SELECT 1 FROM dlab d WHERE d.subject = s.subject AND d.label = c)"""
SHARES = """SELECT subject, 'share' AS "check", c::VARCHAR AS detail FROM (
    SELECT subject, unnest([1, 2, 3]) AS c, unnest([count(*) FILTER (label = 1) / count(*) FILTER (label IN (1, 2, 3)) - 0.53,
        count(*) FILTER (label = 2) / count(*) FILTER (label IN (1, 2, 3)) - 0.30, count(*) FILTER (label = 3) / count(*) FILTER (label IN (1, 2, 3)) - 0.17]) AS off
    FROM dlab GROUP BY subject) WHERE abs(off) > 0.12"""
ALIGN = """SELECT p.subject, 'alignment' AS "check", count(*)::VARCHAR AS detail FROM (
        SELECT e.subject, e.i, least(greatest(round_even(e.i * 0.5, 0)::BIGINT, 0), last) AS near, least(floor(e.i * 0.5)::BIGINT, last) AS cut
        FROM dlong e JOIN (SELECT subject, max(i) AS last FROM half GROUP BY subject) USING (subject) WHERE e.stream = 'eda') p
    JOIN half a ON a.subject = p.subject AND a.i = near JOIN half b ON b.subject = p.subject AND b.i = cut WHERE a.label <> b.label GROUP BY p.subject"""
#: Labels at half the rate of the samples.
HALVED = "half AS (SELECT subject, i // 2 AS i, label FROM dlab WHERE i % 2 = 0)"
HALF = Config(fs=CFG.fs | {"label": 0.5})


@query(f"WITH {DEFECT} {STREAMS}")
def check_streams(spark, sf):
    return quality.check_streams(X.defective(spark, sf)[0], CFG)


@query(f"WITH {DEFECT} {SPREAD}")
def check_duration_spread(spark, sf):
    return quality.check_duration_spread(*X.defective(spark, sf), CFG)


@query(f"WITH {DEFECT} {NULLS}")
def check_nulls(spark, sf):
    return quality.check_nulls(X.defective(spark, sf)[0])


@query(f"WITH {DEFECT} {RANGES}")
def check_ranges(spark, sf):
    return quality.check_ranges(X.defective(spark, sf)[0])


@query(f"WITH {DEFECT} {CLASSES}")
def check_classes(spark, sf):
    return quality.check_classes(X.defective(spark, sf)[1], CFG)


@query(f"WITH {DEFECT} {SHARES}")
def check_label_share(spark, sf):
    return quality.check_label_share(X.defective(spark, sf)[1], CFG)


@query(f"WITH {DEFECT}, {HALVED} {ALIGN}")
def check_alignment(spark, sf):
    samples, labels = X.defective(spark, sf)
    return quality.check_alignment(samples, X.half_rate(labels), HALF)


OF_HALF = [q.replace("max(i) + 1 FROM dlab", "(max(i) + 1) * 2 FROM half").replace("FROM dlab", "FROM half") for q in (SPREAD, CLASSES, SHARES)]


@query(f"WITH {DEFECT}, {HALVED} " + " UNION ALL ".join(f"({q})" for q in (STREAMS, NULLS, RANGES, *OF_HALF, ALIGN)))
def acceptance_report(spark, sf):
    """All checks at once, the labels at half the rate of the samples."""
    samples, labels = X.defective(spark, sf)
    return quality.acceptance_report(samples, X.half_rate(labels), HALF)


@query(f"""WITH {DEFECT}, m AS (SELECT subject, min(n) / 60.0 AS minutes FROM (SELECT subject, stream, max(i) + 1 AS n FROM dlong GROUP BY ALL
            UNION ALL SELECT subject, 'label', max(i) + 1 FROM dlab GROUP BY subject) GROUP BY subject),
        n AS (SELECT subject, count(*) AS samples FROM dlong GROUP BY subject),
        s AS (SELECT subject, {', '.join(f'count(*) FILTER (label = {c}) / count(*) FILTER (label IN (1, 2, 3)) AS share_{c}' for c in (1, 2, 3))} FROM dlab GROUP BY subject)
    SELECT subject, {R('minutes')}, samples, {R('share_1')}, {R('share_2')}, {R('share_3')} FROM m JOIN n USING (subject) JOIN s USING (subject)""")
def recording_summary(spark, sf):
    return rounded(quality.recording_summary(*X.defective(spark, sf), CFG))


@query(f"""WITH {FEAT}, q AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS feature, avg(({c} IS NULL)::INT) AS missing, count(DISTINCT {c}) <= 1 AS flat FROM feat" for c in COLS) + f""")
    SELECT feature, {R('missing')}, CASE WHEN missing > 0.5 THEN 'bad' WHEN flat THEN 'constant' WHEN missing > 0.01 THEN 'warn' ELSE 'ok' END AS verdict FROM q""")
def feature_quality(spark, sf):
    return rounded(quality.feature_quality(X.features(spark, sf), COLS))


@query(f"""WITH q AS (SELECT 'returnflag' AS method, avg((l_returnflag <> 'N')::INT) AS fallback FROM lineitem UNION ALL SELECT 'linestatus', avg((l_linestatus <> 'O')::INT) FROM lineitem)
    SELECT method, {R('fallback')}, CASE WHEN fallback > 0.5 THEN 'problem' WHEN fallback > 0.05 THEN 'bad' ELSE 'ok' END AS verdict FROM q""")
def method_rates(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_returnflag").alias("returnflag"), F.col("l_linestatus").alias("linestatus"))
    return rounded(quality.method_rates(df, ["returnflag", "linestatus"], {"returnflag": "N", "linestatus": "O"}))


@query(f"""WITH {FEAT} SELECT CASE label WHEN 1 THEN 'baseline' WHEN 2 THEN 'stress' WHEN 3 THEN 'amusement' END AS label_name, count(*) AS n,
    {R('round(count(*) / sum(count(*)) OVER (), 3)', 'share')}, count(DISTINCT subject) AS subjects FROM feat GROUP BY label""")
def class_balance(spark, sf):
    from pulsegrid.operators.windows import attach_meta

    return rounded(quality.class_balance(attach_meta(X.features(spark, sf))))


# ---- scaling and diagnostics -------------------------------------------------------------------------------------


@query(f"WITH {FEAT} SELECT subject, t_start, (label = 2)::INTEGER AS y FROM feat")
def make_target(spark, sf):
    return scaling.make_target(X.features(spark, sf), "binary").select("subject", "t_start", "y")


@query(f"WITH {FEAT} SELECT subject, eda_scl_mean, eda_range, eda_scr_count, eda_scr_amp_sum, t_start FROM feat")
def feature_set_projection(spark, sf):
    df = X.features(spark, sf)
    return df.select("subject", *contract.resolve("eda_plus_time", df.columns))


def _iqr(c: str, where: str = "") -> str:
    return f"quantile_cont({c}, 0.75){where} - quantile_cont({c}, 0.25){where}"


def scaled_sql(limit: int | None) -> str:
    where = f" FILTER (k <= {limit})" if limit else ""
    ref = ", ".join(f"quantile_cont({c}, 0.5){where} AS {c}_c, {_iqr(c, where)} AS {c}_r, {_iqr(c)} AS {c}_s" for c in COLS)
    cohort = ", ".join(f"{_iqr(c)} AS {c}_k" for c in COLS)
    z = ", ".join(f"coalesce(CASE WHEN {c} IS NOT NULL THEN greatest(least(({c} - {c}_c) / CASE WHEN {c}_r > 0 THEN {c}_r WHEN {c}_s > 0 THEN {c}_s WHEN {c}_k > 0 THEN {c}_k ELSE 1.0 END, 20.0), -20.0) END, 0.0) AS {c}" for c in COLS)
    return f"""{FEAT}, ranked AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY t_start) AS k FROM feat),
        refs AS (SELECT subject, {ref} FROM ranked GROUP BY subject), cohort AS (SELECT {cohort} FROM feat),
        z AS (SELECT subject, label, t_start, {z} FROM feat JOIN refs USING (subject), cohort)"""


@query(f"WITH {scaled_sql(100)} SELECT subject, label, t_start, {', '.join(R(c) for c in COLS)} FROM z")
def robust_scale_baseline(spark, sf):
    return rounded(scaling.standardise(X.features(spark, sf), "baseline", COLS).select("subject", "label", (F.col("t_start") - 1e-8).alias("t_start"), *COLS))


@query(f"WITH {scaled_sql(None)} SELECT subject, label, t_start, {', '.join(R(c) for c in COLS)} FROM z")
def robust_scale_subject(spark, sf):
    return rounded(scaling.standardise(X.features(spark, sf), "subject", COLS).select("subject", "label", (F.col("t_start") - 1e-8).alias("t_start"), *COLS))


EXTREMES = ", cells AS (SELECT subject, abs(unnest([" + ", ".join(COLS) + "])) AS a FROM z), ex AS (SELECT subject, quantile_cont(a, 0.99) AS p99_abs, max(a) AS max_abs, avg((a > 10)::INT) AS frac_gt_10 FROM cells GROUP BY subject), med AS (SELECT quantile_cont(max_abs, 0.5) AS med FROM ex)"


@query(f"""WITH {scaled_sql(100)}{EXTREMES} SELECT subject, count(*) AS n_windows, {R('min(t_start)', 'first_t')}, {R('any_value(p99_abs)', 'p99_abs')}, {R('any_value(max_abs)', 'max_abs')},
    any_value(max_abs > 5 * med) AS outlier FROM feat JOIN ex USING (subject), med GROUP BY subject""")
def scale_report(spark, sf):
    raw = X.features(spark, sf)
    return rounded(scaling.scale_report(raw, scaling.standardise(raw, "baseline", COLS), COLS))


CONF = ["eda_scl_mean", "eda_range", "eda_scr_count", "z1", "z2", "z3", "gaps"]


@query(f"""WITH {FEAT}, l AS (""" + " UNION ALL ".join(f"SELECT subject, '{c}' AS feature, t_start, {c} AS v FROM feat WHERE {c} IS NOT NULL" for c in CONF) + f"""), r AS (
        SELECT subject, feature, CASE WHEN count(*) >= 10 AND min(v) < max(v) THEN covar_pop(v, t_start) / nullif(stddev_pop(v) * stddev_pop(t_start), 0) END AS r FROM l GROUP BY ALL),
    a AS (SELECT feature, avg(abs(r)) AS m, stddev_samp(abs(r)) AS s, avg(r) AS g FROM r GROUP BY feature)
    SELECT feature, {R('m', 'mean_abs_r')}, {R('s', 'sd_abs_r')}, {R('g', 'mean_signed_r')}, CASE WHEN m > 0.8 THEN 'strong' WHEN m > 0.5 THEN 'moderate' ELSE '' END AS flag FROM a""")
def time_confound(spark, sf):
    return rounded(diagnose.time_confound(X.features(spark, sf), CONF))


def _d(c: str) -> str:
    s, o = "FILTER (label = 2)", "FILTER (label <> 2)"
    pooled = f"sqrt(((count({c}) {s} - 1) * var_samp({c}) {s} + (count({c}) {o} - 1) * var_samp({c}) {o}) / (count({c}) {s} + count({c}) {o} - 2))"
    return f"CASE WHEN {pooled} = 0 THEN 0.0 ELSE (avg({c}) {s} - avg({c}) {o}) / {pooled} END AS d_{c}"


RESP = ", resp AS (SELECT subject, count(*) FILTER (label = 2) AS n_stress, count(*) FILTER (label <> 2) AS n_rest, " + ", ".join(_d(c) for c in diagnose.RESPONDER_FEATURES) + " FROM feat GROUP BY subject)"
RESP_VERDICT = "CASE WHEN abs(d_eda_scl_mean) < 0.2 THEN 'non-responder' WHEN abs(d_eda_scl_mean) < 0.5 THEN 'weak' ELSE 'responder' END"


@query(f"WITH {FEAT}{RESP} SELECT subject, n_stress, n_rest, {', '.join(R('d_' + c) for c in diagnose.RESPONDER_FEATURES)}, {RESP_VERDICT} AS verdict FROM resp")
def responder_check(spark, sf):
    return rounded(diagnose.responders(X.features(spark, sf)))


@query(f"""WITH {FEAT}, l AS (""" + " UNION ALL ".join(f"SELECT subject, '{c}' AS feature, {k} AS p, {c} AS v FROM feat WHERE t_start < 600" for k, c in enumerate(COLS)) + f"""), s AS (
        SELECT subject, feature, p, CASE WHEN min(v) = max(v) AND count(v) > 1 THEN 0.0 ELSE stddev_samp(v) END AS sd FROM l GROUP BY ALL),
    n AS (SELECT subject, count(*) AS n_ref FROM feat WHERE t_start < 600 GROUP BY subject)
    SELECT subject, any_value(n_ref) AS n_ref, {R('min(sd)', 'min_sd')}, count(*) FILTER (sd = 0) AS n_zero_sd, arg_min(feature, (sd, p)) AS worst_feature, any_value(n_ref) < 20 AS thin
    FROM s JOIN n USING (subject) GROUP BY subject""")
def baseline_ref_health(spark, sf):
    return rounded(diagnose.baseline_ref_health(X.features(spark, sf), COLS))


@query(f"WITH {scaled_sql(100)}{EXTREMES} SELECT subject, {R('p99_abs')}, {R('max_abs')}, {R('frac_gt_10')}, max_abs > 5 * med AS outlier FROM ex, med")
def blowup_check(spark, sf):
    return rounded(diagnose.blowup(scaling.standardise(X.features(spark, sf), "baseline", COLS), COLS))


@query(f"WITH {scaled_sql(100)}{EXTREMES}{RESP} SELECT subject, CASE WHEN max_abs > 5 * med THEN 'blow-up' WHEN abs(d_eda_scl_mean) < 0.2 THEN 'non-responder' ELSE 'neither' END AS cause FROM ex JOIN resp USING (subject), med")
def subject_verdict(spark, sf):
    df = X.features(spark, sf)
    return diagnose.verdict(diagnose.responders(df), diagnose.blowup(scaling.standardise(df, "baseline", COLS), COLS))


# ---- evaluation --------------------------------------------------------------------------------------------------


@query(f"""WITH {FEAT}, b AS (SELECT subject, (label = 2)::INT AS y FROM feat), s AS (SELECT DISTINCT subject FROM b)
    SELECT s.subject AS fold, count(*) FILTER (b.subject = s.subject) AS n_test, count(*) FILTER (b.subject <> s.subject) AS n_train,
           count(DISTINCT y) FILTER (b.subject <> s.subject) AS train_classes, count(DISTINCT y) FILTER (b.subject <> s.subject) >= 2 AS usable FROM s, b GROUP BY s.subject""")
def loso_folds(spark, sf):
    return loso.folds(scaling.make_target(X.features(spark, sf), "binary"))


@query(f"WITH {FEAT}, m AS (SELECT quantile_cont(gaps, 0.5) AS m FROM feat WHERE subject <> '0') SELECT subject, t_start, {R('coalesce(gaps, m)', 'gaps')} FROM feat, m")
def impute_train_median(spark, sf):
    df = X.features(spark, sf).select("subject", "t_start", "gaps")
    return rounded(loso.impute_train_median(df.where("subject <> '0'"), df, ["gaps"]).withColumn("t_start", F.col("t_start") - 1e-8))


@query(f"WITH {FEAT} SELECT label AS y, {R('sum(count(*)) OVER () / (count(*) OVER () * count(*))', 'weight')} FROM feat GROUP BY label")
def class_weights(spark, sf):
    return rounded(loso.class_weights(scaling.make_target(X.features(spark, sf), "3class")))


SCORES = """, c AS (SELECT subject, y, yhat, count(*) AS n FROM pred GROUP BY ALL), cls AS (SELECT DISTINCT subject, unnest([y, yhat]) AS k FROM c
), s AS (SELECT k.subject, k.k, coalesce(sum(n) FILTER (y = k.k), 0) AS support, coalesce(sum(n) FILTER (yhat = k.k), 0) AS predicted, coalesce(sum(n) FILTER (y = k.k AND yhat = k.k), 0) AS hit
    FROM cls k JOIN c USING (subject) GROUP BY ALL
), folds AS (SELECT subject, sum(support)::BIGINT AS n_test, sum(hit) / sum(support) AS accuracy, avg(hit / nullif(support, 0)) AS balanced_acc, avg(2 * hit / (support + predicted)) AS macro_f1 FROM s GROUP BY subject)"""


@query(f"WITH {PRED}{SCORES} SELECT subject, n_test, {R('accuracy')}, {R('balanced_acc')}, {R('macro_f1')} FROM folds")
def fold_metrics(spark, sf):
    return rounded(metrics.fold_metrics(X.predictions(spark, sf)))


@query(f"""WITH {PRED}{SCORES}, g AS (SELECT k, sum(support) AS s, sum(predicted) AS p, sum(hit) AS h FROM s GROUP BY k), pool AS (SELECT avg(2 * h / (s + p)) AS f FROM g)
    SELECT count(*) AS n_folds, {', '.join(R(f'avg({m})', m + '_mean') + ', ' + R(f'stddev_samp({m})', m + '_sd') for m in ('accuracy', 'balanced_acc', 'macro_f1'))},
           {R('min(macro_f1)', 'worst_fold_macro_f1')}, {R('max(macro_f1)', 'best_fold_macro_f1')}, {R('any_value(f)', 'pooled_macro_f1')} FROM folds, pool""")
def loso_summary(spark, sf):
    preds = X.predictions(spark, sf)
    return rounded(metrics.summary(metrics.fold_metrics(preds), preds))


@query(f"WITH {PRED} SELECT y, " + ", ".join(f"count(*) FILTER (yhat = {c}) AS p{c}" for c in (1, 2, 3)) + " FROM pred GROUP BY y")
def confusion_matrix(spark, sf):
    return metrics.confusion(X.predictions(spark, sf), [1, 2, 3])


@query(f"""WITH {PRED}{SCORES}, g AS (SELECT k::VARCHAR AS class, sum(support)::BIGINT AS support, sum(hit) / sum(predicted) AS p, sum(hit) / sum(support) AS r, 2 * sum(hit) / (sum(support) + sum(predicted)) AS f FROM s GROUP BY k),
    u AS (SELECT class, p, r, f, support FROM g UNION ALL SELECT 'macro', avg(p), avg(r), avg(f), sum(support)::BIGINT FROM g
          UNION ALL SELECT 'weighted', sum(p * support) / sum(support), sum(r * support) / sum(support), sum(f * support) / sum(support), sum(support)::BIGINT FROM g)
    SELECT class, {R('p', 'precision')}, {R('r', 'recall')}, {R('f', 'f1')}, support FROM u""")
def per_class_report(spark, sf):
    return rounded(metrics.per_class(X.predictions(spark, sf)))


IMP = "imp AS (SELECT CASE l_linenumber WHEN 1 THEN 'eda_range' WHEN 2 THEN 'hr_mean' WHEN 3 THEN 'acc_x_sd' WHEN 4 THEN 'temp_mean' ELSE 'eda_range_gated' END AS feature, l_discount AS importance FROM lineitem)"


def _imp(spark, sf):
    k = F.col("l_linenumber")
    name = F.when(k == 1, "eda_range").when(k == 2, "hr_mean").when(k == 3, "acc_x_sd").when(k == 4, "temp_mean").otherwise("eda_range_gated")
    return spark.read.parquet(f"{sf}/lineitem.parquet").select(name.alias("feature"), F.col("l_discount").alias("importance"))


@query(f"WITH {IMP} SELECT feature, {R('avg(importance)', 'importance_mean')}, {R('stddev_pop(importance)', 'importance_sd')} FROM imp GROUP BY feature")
def importance_summary(spark, sf):
    return rounded(metrics.importance(_imp(spark, sf)))


@query(f"""WITH {IMP}, m AS (SELECT feature, avg(importance) AS v FROM imp GROUP BY feature)
    SELECT CASE feature WHEN 'eda_range' THEN 'EDA' WHEN 'hr_mean' THEN 'HR' WHEN 'acc_x_sd' THEN 'IMU' ELSE 'TEMP' END AS block, {R('v / (SELECT sum(v) FROM m)', 'share')} FROM m WHERE feature <> 'eda_range_gated'""")
def block_share(spark, sf):
    return rounded(metrics.block_share(metrics.importance(_imp(spark, sf))))


@query(f"WITH {PRED}{SCORES} SELECT subject, n_test, {R('accuracy')}, {R('balanced_acc')}, {R('macro_f1')} FROM folds ORDER BY folds.macro_f1, subject LIMIT 3")
def weakest_folds(spark, sf):
    return rounded(metrics.weakest(metrics.fold_metrics(X.predictions(spark, sf))))


@query(f"WITH {PRED}{SCORES} SELECT count(*) FILTER (macro_f1 > 0.97) AS near_perfect, count(*) FILTER (balanced_acc < 0.55) AS near_chance FROM folds")
def fold_bimodality(spark, sf):
    return metrics.bimodality(metrics.fold_metrics(X.predictions(spark, sf)))


SWEEP = "sw AS (SELECT CASE WHEN l_linenumber < 5 THEN 'binary' ELSE '3class' END AS task, l_returnflag AS model, CASE l_linenumber % 3 WHEN 0 THEN 'all' WHEN 1 THEN 'clean' ELSE 'eda_only' END AS feature_set, avg(l_discount) AS balanced_acc_mean, avg(l_tax) AS accuracy_mean FROM lineitem WHERE NOT (l_returnflag = 'A' AND l_linenumber % 3 = 0) GROUP BY ALL)"


def _sweep(spark, sf):
    k, flag = F.col("l_linenumber"), F.col("l_returnflag")
    df = spark.read.parquet(f"{sf}/lineitem.parquet").where(~((flag == "A") & (k % 3 == 0)))
    keys = [F.when(k < 5, "binary").otherwise("3class").alias("task"), flag.alias("model"), F.when(k % 3 == 0, "all").when(k % 3 == 1, "clean").otherwise("eda_only").alias("feature_set")]
    return df.groupBy(*keys).agg(F.avg("l_discount").alias("balanced_acc_mean"), F.avg("l_tax").alias("accuracy_mean"))


@query(f"""WITH {SWEEP}, b AS (SELECT task, model, balanced_acc_mean AS base FROM sw WHERE feature_set = 'all')
    SELECT task, model, feature_set, {R('balanced_acc_mean')}, {R('accuracy_mean')}, {R('balanced_acc_mean - base', 'delta')} FROM sw JOIN b USING (task, model)""")
def sweep_delta(spark, sf):
    return rounded(metrics.sweep_delta(_sweep(spark, sf)))


@query(f"WITH {SWEEP} SELECT task, model, feature_set, {R('balanced_acc_mean')}, {R('accuracy_mean')}, {R('accuracy_mean - CASE task WHEN chr(98) || chr(105) || chr(110) || chr(97) || chr(114) || chr(121) THEN 0.88 ELSE 0.76 END', 'ceiling_delta')} FROM sw".replace("chr(98) || chr(105) || chr(110) || chr(97) || chr(114) || chr(121)", "'binary'"))
def ceiling_delta(spark, sf):
    return rounded(metrics.ceiling_delta(_sweep(spark, sf)))


#: The registered runs use the whole table, every fold, both tasks and all sets with smaller models than the defaults: README has
#: the measured times of whole ones.  Folds do not depend on the table's size: one per subject, or three of whole subjects.
TREES = loso.Trees(rf_trees=20, gbt_rounds=10, max_depth=6)
GROUP_FOLDS = 3


def _run(spark, sf, task, model, k=None, **kw):
    return loso.run(X.features(spark, sf), task, model, "eda_only", k=k, trees=TREES, **kw)


@query()
def loso_rf(spark, sf):
    return _run(spark, sf, "3class", "rf").summary


@query()
def loso_gbt(spark, sf):
    return _run(spark, sf, "binary", "gbt").summary


@query()
def permutation_importance(spark, sf):
    return _run(spark, sf, "binary", "rf", GROUP_FOLDS, permutation=True).permutation


@query()
def ablation_sweep(spark, sf):
    return loso.sweep(X.features(spark, sf), ["binary", "3class"], ["rf"], SWEEP_SETS, k=GROUP_FOLDS, trees=TREES)


# ---- export and scoring ------------------------------------------------------------------------------------------


@query(f"WITH {FEAT}, q AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {_iqr(c)} AS iqr FROM feat" for c in COLS) + f") SELECT feature, {R('iqr')} FROM q")
def cohort_iqr(spark, sf):
    return rounded(scaling.cohort_iqr(X.features(spark, sf), COLS))


REF_COLS = ["eda_scl_mean", "eda_range", "z1", "z2"]
READY = 590  # of wearer_reference, so that some wearers are not ready


def ref_sql(n: int) -> str:
    """wr: each wearer's reference of its first n rows."""
    return f"""{FEAT}, ranked AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY t_start) AS k FROM feat), cohort AS (SELECT {', '.join(f'{_iqr(c)} AS {c}_k' for c in REF_COLS)} FROM feat),
    refs AS (SELECT subject, count(*) FILTER (k <= {n}) AS n_ref, {', '.join(f'quantile_cont({c}, 0.5) FILTER (k <= {n}) AS {c}_c, {_iqr(c, f" FILTER (k <= {n})")} AS {c}_r' for c in REF_COLS)} FROM ranked GROUP BY subject),
    wr AS (SELECT subject, n_ref, n_ref >= {n} AS ready, {', '.join(f'{c}_c AS {c}_centre, CASE WHEN {c}_r > 0 THEN {c}_r WHEN {c}_k > 0 THEN {c}_k ELSE 1.0 END AS {c}_scale' for c in REF_COLS)} FROM refs, cohort)"""


def _refs(spark, sf):
    df = shared.written(X.features(spark, sf).select("subject", "t_start", *REF_COLS), "rows")  # read for the spreads, the references and the result
    return df, scoring.wearer_reference(df, REF_COLS, READY, scaling.cohort_spread(df, REF_COLS))


@query(f"WITH {ref_sql(READY)} SELECT subject, n_ref, ready, {', '.join(R(f'{c}_centre') + ', ' + R(f'{c}_scale') for c in REF_COLS)} FROM wr")
def wearer_reference(spark, sf):
    return rounded(_refs(spark, sf)[1])


@query(f"""WITH {ref_sql(Config().n_ref)} SELECT subject, r.t_start, {', '.join(R(f'greatest(least((r.{c} - {c}_centre) / {c}_scale, 20.0), -20.0)', c) for c in REF_COLS)}
    FROM ranked r JOIN wr USING (subject) WHERE ready AND k > {Config().n_ref}""")
def score_ready_rows(spark, sf):
    """All rows after a warm-up of as many rows as everywhere else."""
    df = X.features(spark, sf, "subject").select("subject", "t_start", *REF_COLS)
    return rounded(scoring.warmed_rows(df, REF_COLS, Config().n_ref).select("subject", (F.col("t_start") - 1e-8).alias("t_start"), *REF_COLS))


@query()
def fit_final(spark, sf):
    df = shared.written(X.features(spark, sf), "rows")
    model, sidecar = export.fit_final(df, "3class", "rf", "eda_only", trees=TREES)
    return scoring.score(df, None, model, sidecar).select("subject", "t_start", "state")


@query(f"""WITH {FEAT}, n AS (SELECT subject, count(*) AS n FROM feat GROUP BY subject)
    SELECT * FROM (SELECT unnest(['cold_start', 'warm_up', 'inference', 'broken_row', 'reset']) AS "check", unnest([0, count(*) FILTER (n >= 100), coalesce(sum(greatest(n - 100, 0)), 0)::BIGINT, 1,
        coalesce(sum(greatest(n - 200, 0)), 0)::BIGINT]) AS rows, true AS passed FROM n)""")
def verify_artefact(spark, sf):
    """The final model saved, loaded and used as a live host does, on every wearer."""
    df, path = shared.written(X.features(spark, sf), "rows"), shared.folder(spark, "artefact")
    model, sidecar = export.fit_final(df, "3class", "rf", "eda_only", trees=TREES)
    export.save(spark, model, sidecar, path)
    return export.verify(spark, path, df)


# ---- streaming ---------------------------------------------------------------------------------------------------

STREAM_START = 1_700_000_000 - 1_700_000_000 % 60

def _events(spark, sf):
    """The events table as a stream: wearer, stream, ts, v, reset."""
    raw = live.read_parquet(spark, f"{sf}/events.parquet")
    return raw.select(F.col("user_id").cast("string").alias("wearer"), F.lit("value").alias("stream"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("v"), (F.col("event_type") == "signup").alias("reset"))


def _drain(spark, stream, label):
    """Run until everything that is there is done; the sink's table."""
    path = shared.folder(spark, label)
    live.sink(stream, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


CLOSED = "(SELECT max(ts) - INTERVAL 10 SECOND FROM events)"


@query(f"""SELECT wearer, start, count(value) AS n, {R('avg(value)', 'mean')}, {R('stddev_pop(value)', 'sd')}, {R('min(value)', 'min')}, {R('max(value)', 'max')}
    FROM (SELECT user_id::VARCHAR AS wearer, value, date_trunc('day', ts)::TIMESTAMP AS start FROM events) WHERE start + INTERVAL 24 HOUR <= {CLOSED} GROUP BY wearer, start""")
def stream_short_windows(spark, sf):
    out = _drain(spark, live.short_windows(_events(spark, sf), "1 day"), "short")
    return rounded(out.drop("stream").withColumn("start", F.col("start").cast("timestamp_ntz")))


@query(f"""WITH e AS (SELECT user_id::VARCHAR AS wearer, value, ts, date_trunc('day', ts)::TIMESTAMP AS start, ts < (SELECT make_timestamp((epoch_us(min(ts)) + epoch_us(max(ts))) // 2) FROM events) AND event_id % 9 <> 4 AS early FROM events
    ) SELECT wearer, start, count(value) AS n, {R('avg(value)', 'mean')}, {R('stddev_pop(value)', 'sd')}, {R('min(value)', 'min')}, {R('max(value)', 'max')}
    FROM e WHERE (early OR start + INTERVAL 24 HOUR > (SELECT max(ts) - INTERVAL 10 SECOND FROM e WHERE early)) AND start + INTERVAL 24 HOUR <= {CLOSED} GROUP BY wearer, start""")
def stream_late_rows(spark, sf):
    """A ninth of the first half's events comes with the second half: those whose window had closed by then are dropped, the others count."""
    path = shared.folder(spark, "late")
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("user_id").cast("string").alias("wearer"), F.lit("value").alias("stream"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("v"))
    middle = F.timestamp_micros(F.lit(rows.select(F.floor((F.unix_micros(F.min("ts")) + F.unix_micros(F.max("ts"))) / 2)).first()[0]))
    early = (F.col("ts") < middle) & (F.col("event_id") % 9 != 4)
    for part in (early, ~early):
        rows.where(part).drop("event_id").write.mode("append").parquet(f"{path}/in")
        out = live.short_windows(live.read_parquet(spark, f"{path}/in"), "1 day")
        live.sink(out, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    got = spark.read.schema(out.schema).parquet(f"{path}/out")
    return rounded(got.drop("stream").withColumn("start", F.col("start").cast("timestamp_ntz")))


@query(f"""WITH k AS (SELECT user_id::VARCHAR AS wearer, value, ts, time_bucket(INTERVAL 6 HOUR, ts) - unnest(range(0, 4)) * INTERVAL 6 HOUR AS start FROM events)
    SELECT wearer, start, count(value) AS n, {R('avg(value)', 'mean')}, {R('stddev_pop(value)', 'sd')}, {R('min(value)', 'min')}, {R('max(value)', 'max')}
    FROM k GROUP BY ALL HAVING start + INTERVAL 24 HOUR <= {CLOSED} AND count(value) >= 1""")
def stream_long_windows(spark, sf):
    out = _drain(spark, live.long_windows(_events(spark, sf), "24 hours", "6 hours"), "long")
    return rounded(out.drop("stream").withColumn("start", F.col("start").cast("timestamp_ntz")))


@query(f"""SELECT vec_id::VARCHAR AS wearer, 'eda' AS stream, make_timestamp({STREAM_START}::BIGINT * 1000000 + (k - 1) * 250000) AS ts, embedding[k]::DOUBLE AS v
    FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings)""")
def demux_packets(spark, sf):
    """Every vector as a packet of four samples a second."""
    packets = X.recording_arrays(spark, sf).select(F.col("subject").alias("wearer"), "stream", F.timestamp_seconds(F.lit(STREAM_START)).alias("ts"), "values")
    return live.demux(packets, Config()).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _warm_up(reset: str) -> str:
    """Ten rows of a wearer after each reset are the reference; later ones are scaled by it."""
    return f"""WITH r AS (SELECT user_id::VARCHAR AS wearer, ts::TIMESTAMP AS ts, value AS v, {reset} AS reset FROM events
    ), s AS (SELECT *, count(*) FILTER (reset) OVER (PARTITION BY wearer ORDER BY ts) AS part FROM r
    ), k AS (SELECT *, row_number() OVER (PARTITION BY wearer, part ORDER BY ts) AS k FROM s WHERE NOT reset
    ), f AS (SELECT wearer, part, quantile_cont(v, 0.5) AS c, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS d FROM k WHERE k <= 10 GROUP BY wearer, part
    ) SELECT wearer, ts, {R('coalesce(greatest(least((v - c) / CASE WHEN d > 0 THEN d ELSE 1.0 END, 20.0), -20.0), 0.0)', 'v')} FROM k JOIN f USING (wearer, part) WHERE k > 10"""


def _plain_time(df):
    return rounded(df.withColumn("ts", F.col("ts").cast("timestamp_ntz")))


@query(_warm_up("false"))
def stream_scorer(spark, sf):
    rows = _events(spark, sf).withColumn("reset", F.lit(False))
    return _plain_time(_drain(spark, live.scaled_rows(rows, ["v"], 10, {"v": 1.0}), "scorer"))


@query(_warm_up("event_type = 'signup'"))
def stream_reset(spark, sf):
    return _plain_time(_drain(spark, live.scaled_rows(_events(spark, sf), ["v"], 10, {"v": 1.0}), "reset"))


ENDED = "SELECT subject, w, NULL::INTEGER AS label, subject || ':' || w AS key FROM grid WHERE w * 5 + 60 <= (SELECT max(i) FROM wide) - 10"
#: A wearer's means from the start to the end of each window, ten minutes at most.
RUNNING = """running AS (SELECT k.subject, k.w, avg(hr) FILTER (hr > 20 AND hr < 220) AS bh, avg(temp) AS bt FROM kept k JOIN wide x ON x.subject = k.subject AND x.i < least(k.w * 5 + 60, 600) GROUP BY ALL)"""
LIVE = {"hr_baseline_delta": "hr_mean - bh", "temp_baseline_delta": "temp_mean - bt", "hr_delta_x_still": "(hr_mean - bh) * (1 - motion_fraction)"}
WINDOW_TIME = f"make_timestamp((({STREAM_START} + w * 5) * 1000000)::BIGINT) AS start"


def _packets(spark, sf):
    """lineitem as a recording: wearer, stream, ts, v, a sample a second, and its number i."""
    return X.samples_1hz(spark, sf).select(F.col("subject").alias("wearer"), "stream", F.timestamp_seconds(F.col("sample_idx") + STREAM_START).alias("ts"), "v", F.col("sample_idx").alias("i"))


def _streamed(spark, rows):
    """Rows written to a folder and read as a file stream."""
    path = shared.folder(spark, "packets")
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


@query(f"""{table_sql(ENDED)}, {RUNNING} SELECT subject AS wearer, {WINDOW_TIME}, {', '.join(R(LIVE.get(c, c), c) for c in contract.FEATURE_NAMES)} FROM whole JOIN running USING (subject, w)""")
def stream_features(spark, sf):
    """The recording of lineitem as one file stream of samples, a second apart; whole windows that the watermark has passed, with the running reference of each."""
    out = _drain(spark, live.features(_streamed(spark, _packets(spark, sf).drop("i")), CFG, missing=0.0), "features")
    return rounded(out.withColumn("start", F.col("start").cast("timestamp_ntz")))


@query(f"""WITH {REC}, steps AS (SELECT subject, unnest(range(0, max(i) // 5 + 1)) AS w FROM wide GROUP BY subject
    ), kept AS (SELECT subject, w FROM steps WHERE w * 5 + 60 <= (SELECT max(i) FROM wide) - 10
    ), lossy AS (SELECT subject, i, CASE WHEN i % 41 <> 7 THEN eda END AS eda, CASE WHEN i % 90 NOT BETWEEN 30 AND 36 OR subject::BIGINT % 3 > 0 THEN temp END AS temp, hr FROM wide
    ), cells AS (SELECT k.subject, k.w, x.i, x.hr, x.temp, coalesce(eda, (lag(eda) OVER o + lead(eda) OVER o) / 2, lead(eda) OVER o, lag(eda) OVER o) AS eda, (eda IS NULL)::INTEGER AS e, (temp IS NULL)::INTEGER AS t
        FROM kept k JOIN lossy x ON x.subject = k.subject AND x.i >= k.w * 5 AND x.i < k.w * 5 + 60 WINDOW o AS (PARTITION BY k.subject, k.w ORDER BY x.i)
    ), stat AS (SELECT subject, w, (60 - count(*) + greatest(sum(e), sum(t))) / 60.0 AS missing, sum(t) > sum(e) AS warm, avg(hr) AS hr, avg(temp) AS temp, (sum(eda) + (60 - count(*)) * arg_max(eda, i)) / 60 AS eda FROM cells GROUP BY subject, w
    ), running AS (SELECT k.subject, k.w, avg(hr) FILTER (hr > 20 AND hr < 220) AS bh, avg(temp) AS bt FROM kept k JOIN lossy x ON x.subject = k.subject AND x.i < least(k.w * 5 + 60, 600) GROUP BY ALL)
    SELECT subject AS wearer, {WINDOW_TIME}, {R('missing')}, CASE WHEN missing > 0.05 THEN CASE WHEN warm THEN 'temp' ELSE 'eda' END END AS refused, {R('bh', 'baseline_hr')}, {R('bt', 'baseline_temp')},
        {', '.join(R(f'CASE WHEN missing <= 0.05 THEN {c} END', c) for c in ('hr', 'temp', 'eda'))} FROM stat JOIN running USING (subject, w)""")
def stream_slots(spark, sf):
    """The same recording as a worn radio link delivers it: each 41st sample of skin conductance lost, seven seconds of temperature in ninety lost of
    every third wearer, each tenth sample sent twice, all times up to 0.4 s off; closed windows, those refused among them."""
    rows = _packets(spark, sf)
    lost = ((F.col("stream") == "eda") & (F.col("i") % 41 == 7)) | ((F.col("stream") == "temp") & (F.col("i") % 90).between(30, 36) & (F.col("wearer").cast("long") % 3 == 0))
    rows = rows.where(~lost).withColumn("again", F.explode(F.when(F.col("i") % 10 == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("again")
    off = F.when((F.col("i") > 0) & (F.col("i") < F.max("i").over(Window.partitionBy("wearer"))), F.col("i") * 37 % 800 - 400).otherwise(0)
    rows = rows.withColumn("ts", F.timestamp_micros(F.unix_micros("ts") + off * 1000)).drop("i")
    means = [F.expr(f"aggregate(filter({c}, x -> x is not null), 0D, (s, x) -> s + x) / size(filter({c}, x -> x is not null))").alias(c) for c in ("hr", "temp", "eda")]
    closed = live.closed_windows(_streamed(spark, rows), CFG).select("wearer", "start", "missing", "refused", "baseline_hr", "baseline_temp", *means)  # the arrays are not written
    return rounded(_drain(spark, closed, "slots").withColumn("start", F.col("start").cast("timestamp_ntz")))


@query("""WITH r AS (SELECT user_id::VARCHAR AS wearer, ts::TIMESTAMP AS ts, value AS v, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, value) > 86400000000 AS apart FROM events WHERE ts <= (SELECT max(ts) - INTERVAL 10 SECOND FROM events)
    ), s AS (SELECT *, count(*) FILTER (apart) OVER (PARTITION BY wearer ORDER BY ts, v ROWS UNBOUNDED PRECEDING) AS part FROM r
    ), k AS (SELECT *, row_number() OVER (PARTITION BY wearer, part ORDER BY ts, v) AS k FROM s
    ), f AS (SELECT wearer, part, quantile_cont(v, 0.5) AS c, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS d FROM k WHERE k <= 5 GROUP BY wearer, part
    ) SELECT wearer, ts, """ + R("coalesce(greatest(least((v - c) / CASE WHEN d > 0 THEN d ELSE 1.0 END, 20.0), -20.0), 0.0)", "v") + " FROM k JOIN f USING (wearer, part) WHERE k > 5")
def stream_wear_gap(spark, sf):
    """More than a day without an event clears a wearer's reference of five; rows come out once the watermark has passed them."""
    rows = _events(spark, sf).withColumn("reset", F.lit(False))
    return _plain_time(_drain(spark, live.scaled_rows(rows, ["v"], 5, {"v": 1.0}, gap_s=86_400.0, delay="10 seconds"), "gap"))


@query()
def stream_states(spark, sf):
    """A model scores the feature table as a stream: states after each wearer's warm-up, beside a current value (the stand-in of the heart rate)."""
    df, path = shared.written(X.features(spark, sf), "rows"), shared.folder(spark, "states")
    model, sidecar = export.fit_final(df, "binary", "rf", "eda_only", trees=TREES)
    cols = sidecar["feature_names"]
    rows = df.select(F.col("subject").alias("wearer"), F.timestamp_seconds(F.col("t_start") + STREAM_START).alias("ts"), F.lit(False).alias("reset"), *cols, F.col("eda_range").alias("hr"))
    rows.write.parquet(f"{path}/in")
    scaled = live.scaled_rows(live.read_parquet(spark, f"{path}/in"), cols, sidecar["n_ref"], sidecar["cohort_iqr"], sidecar["clip"], keep=("hr",))
    live.score_to(scaled, model, sidecar, f"{path}/out", f"{path}/checkpoint", ("hr",)).awaitTermination()
    return spark.read.parquet(f"{path}/out").select("subject", F.col("t_start").cast("timestamp_ntz").alias("t_start"), "state", "hr")
