"""The registered queries of the wearable-signal library, with equivalent SQL where SQL can say it.

Doubles are rounded to six places after a shift of 1e-8, so that exact halves round alike everywhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid import contract
from pulsegrid.config import Config, one_hertz
from pulsegrid.functions import arrays as A
from pulsegrid.functions import signal
from pulsegrid.operators import features, timebase, windows
from pulsegrid.sources import fixtures as X
from pulsegrid.sources import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CFG = one_hertz()


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(c) + 1e-8, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def R(x: str, name: str | None = None) -> str:
    return f"round(({x})::DOUBLE + 1e-8, 6) AS {name or x}"


REC, FEAT, PRED, DEFECT = X.SQL_REC, X.SQL_FEAT, X.SQL_PRED, X.SQL_DEFECT

# ---- sources, time base ------------------------------------------------------------------------------------------


@query("""SELECT CAST(vec_id AS VARCHAR) AS subject, 'eda' AS stream, (k - 1)::BIGINT AS sample_idx, (k - 1) / 4.0::DOUBLE AS t, embedding[k]::DOUBLE AS v
          FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings)""")
def samples_explode(spark, sf):
    return timebase.with_time(ingest.samples(X.recording_arrays(spark, sf)), Config()).select("subject", "stream", "sample_idx", "t", "v")


@query("SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS subject FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12)")
def pending_subjects(spark, sf):
    done = spark.read.parquet(f"{sf}/supplier.parquet").where("s_nationkey < 12").select(F.col("s_suppkey").cast("string").alias("subject"))
    every = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_suppkey").cast("string").alias("subject"))
    return ingest.pending(every, done)


@query(f"WITH {FEAT} SELECT subject, label, t_start, eda_scl_mean FROM feat")
def combine_tables(spark, sf):
    df = X.features(spark, sf).select("subject", "label", "t_start", "eda_scl_mean")
    early = F.col("t_start") < 1000
    return ingest.combine(df.where(early), df.where(~early).select("eda_scl_mean", "t_start", "label", "subject"))


@query(f"WITH {REC} SELECT subject, duration::DOUBLE AS duration FROM dur")
def recording_duration(spark, sf):
    return timebase.durations(X.samples_1hz(spark, sf), X.labels_1hz(spark, sf), CFG)


HALF = Config(fs=CFG.fs | {"label": 0.5})


@query(f"""WITH {REC}, lab AS (SELECT subject, i // 2 AS i, label FROM wide WHERE i % 2 = 0), last AS (SELECT subject, max(i) AS last FROM lab GROUP BY subject)
        SELECT w.subject, w.i AS sample_idx, l.label FROM wide w JOIN last USING (subject)
        JOIN lab l ON l.subject = w.subject AND l.i = least(greatest(round_even(w.i * 0.5, 0)::BIGINT, 0), last)""")
def label_nearest(spark, sf):
    labels = X.half_rate(X.labels_1hz(spark, sf))
    return timebase.label_nearest(X.samples_1hz(spark, sf, ["eda"]), labels, HALF).select("subject", "sample_idx", "label")


@query(f"""WITH l AS (SELECT event_id, user_id::VARCHAR AS subject, ts::TIMESTAMP AS ts FROM events WHERE event_type <> 'view'
    ), r AS (SELECT user_id::VARCHAR AS subject, ts::TIMESTAMP AS ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL
    ), b AS (SELECT l.*, r.value AS bv, epoch_us(l.ts) - epoch_us(r.ts) AS back FROM l ASOF LEFT JOIN r ON l.subject = r.subject AND l.ts >= r.ts
    ), a AS (SELECT b.*, r.value AS av, epoch_us(r.ts) - epoch_us(b.ts) AS ahead FROM b ASOF LEFT JOIN r ON b.subject = r.subject AND b.ts <= r.ts
    ), n AS (SELECT *, coalesce(back <= ahead, ahead IS NULL) AS early FROM a
    ), o AS (SELECT *, CASE WHEN early THEN back ELSE ahead END AS off FROM n)
    SELECT event_id, subject, CASE WHEN off <= 21600000000 THEN CASE WHEN early THEN bv ELSE av END END AS value, {R('CASE WHEN off <= 21600000000 THEN off / 1000000.0 END', 'off_s')} FROM o""")
def nearest_in_time(spark, sf):
    """Each other event of a user with the value of the view nearest in time, at most six hours away."""
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("user_id").cast("string").alias("subject"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    out = timebase.nearest_in_time(e.where("event_type <> 'view'").select("event_id", "subject", "ts"), e.where("event_type = 'view'"), 6 * 3600.0, ["value"])
    return out.select("event_id", "subject", "value", F.round(F.col("off_s") + 1e-8, 6).alias("off_s"))


@query(f"""WITH {REC} SELECT g.subject, g.w, count(*) AS n, {R('sum(x.eda)', 'eda_sum')} FROM grid g
        JOIN wide x ON x.subject = g.subject AND x.i >= floor(g.w * 5) AND x.i < ceil(g.w * 5 + 60) GROUP BY ALL""")
def window_slice(spark, sf):
    eda = X.samples_1hz(spark, sf, ["eda"])
    rows = timebase.slice_windows(eda, windows.grid(timebase.durations(eda, None, CFG), CFG), CFG)
    return rounded(rows.groupBy("subject", "w").agg(F.count("*").alias("n"), F.sum("v").alias("eda_sum")))


@query(f"""WITH {REC} SELECT subject, 'hr' AS stream, (i // 10)::BIGINT AS sample_idx, {R('avg(hr)', 'v')} FROM wide
        GROUP BY subject, i // 10 HAVING count(*) = 10""")
def decimate_mean(spark, sf):
    return rounded(timebase.decimate_mean(X.samples_1hz(spark, sf, ["hr"]), 1.0, 0.1))


@query(f"""WITH {REC} SELECT subject, label, count(*) AS n, {R('count(*) / sum(count(*)) OVER (PARTITION BY subject)', 'share')}
        FROM wide WHERE label IN (1, 2, 3) GROUP BY subject, label""")
def label_distribution(spark, sf):
    return rounded(timebase.label_distribution(X.labels_1hz(spark, sf)))


@query()
def bvp_to_hr(spark, sf):
    return signal.bvp_to_hr(X.pulse_64hz(spark, sf))


# ---- windows -----------------------------------------------------------------------------------------------------


def _grid(spark, sf):
    return windows.grid(timebase.durations(X.samples_1hz(spark, sf, ["eda"]), None, CFG), CFG)


@query(f"WITH {REC} SELECT subject, w, (w * 5)::DOUBLE AS t_start FROM grid")
def sliding_windows(spark, sf):
    return _grid(spark, sf)


LABELLED = """, c AS (
    SELECT g.subject, g.w, x.label, count(*) AS n FROM grid g JOIN wide x ON x.subject = g.subject AND x.i >= g.w * 5 AND x.i < g.w * 5 + 60 GROUP BY ALL
), m AS (
    SELECT subject, w, sum(n)::BIGINT AS n, max(n) AS most, arg_min(label, -n * 10 + label) AS majority FROM c GROUP BY ALL
), labelled AS (
    SELECT subject, w, majority, most / n AS share, n,
           CASE WHEN most / n < 0.9 THEN 'impure' WHEN majority NOT IN (1, 2, 3) THEN 'out_of_scope' END AS reason FROM m
)"""


def _labelled(spark, sf):
    return windows.majority_label(X.labels_1hz(spark, sf), _grid(spark, sf), CFG)


@query(f"WITH {REC}{LABELLED} SELECT subject, w, majority, {R('share')}, n, reason, CASE WHEN reason IS NULL THEN majority END AS label FROM labelled")
def window_majority_label(spark, sf):
    return rounded(_labelled(spark, sf).select("subject", "w", "majority", "share", "n", "reason", "label"))


@query(f"""WITH {REC}{LABELLED} SELECT subject, 0::BIGINT AS empty, count(*) FILTER (reason = 'impure') AS impure, count(*) FILTER (reason = 'out_of_scope') AS out_of_scope,
        count(*) FILTER (reason IS NULL) AS accepted, 0::BIGINT AS no_hr FROM labelled GROUP BY subject""")
def reject_reasons(spark, sf):
    return windows.reject_counts(_labelled(spark, sf))


@query(f"WITH {REC} SELECT subject, w, unnest(range(0, 4))::INTEGER AS sub, (w * 5 + unnest(range(0, 4)) * 15)::DOUBLE AS sub_start FROM grid")
def sub_windows(spark, sf):
    return windows.sub_windows(_grid(spark, sf), CFG)


@query(f"WITH {FEAT} SELECT subject, t_start, eda_scl_mean FROM feat WHERE i < 20".replace("FROM feat WHERE i < 20", "FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY t_start) AS k FROM feat) WHERE k <= 20"))
def limit_per_subject(spark, sf):
    return windows.limit_accepted(X.features(spark, sf), 20).select("subject", "t_start", "eda_scl_mean")


@query(f"WITH {FEAT} SELECT subject, label, CASE label WHEN 1 THEN 'baseline' WHEN 2 THEN 'stress' WHEN 3 THEN 'amusement' END AS label_name, t_start FROM feat")
def label_dictionary_join(spark, sf):
    return windows.attach_meta(X.features(spark, sf)).select("subject", "label", "label_name", "t_start")


@query(f"WITH {REC} SELECT subject, {R('avg(hr) FILTER (i < 600 AND hr > 20 AND hr < 220)', 'baseline_hr')}, {R('avg(temp) FILTER (i < 600)', 'baseline_temp')} FROM wide GROUP BY subject")
def baseline_refs(spark, sf):
    return rounded(windows.baseline_refs(X.samples_1hz(spark, sf), CFG))


# ---- features ----------------------------------------------------------------------------------------------------


def _arrays(spark, sf, *streams):
    long = tuple(s for s in streams if s in ("eda", "temp"))
    short = tuple(s for s in streams if s not in long)
    cells = windows.panes(X.samples_1hz(spark, sf, list(streams)).repartition("subject"), CFG)
    return windows.window_arrays(cells, CFG, long, short)


def _complete(df, spark, sf):
    """Rows of complete windows, by a row a subject: the grid itself would be broadcast, as the planner does not see that it is long."""
    return windows.complete(df, timebase.durations(X.samples_1hz(spark, sf, ["eda"]), None, CFG), CFG)


@query(f"""WITH {REC} SELECT g.subject, g.w, {R('regr_slope(x.eda, x.i)', 'eda_slope')} FROM grid g
        JOIN wide x ON x.subject = g.subject AND x.i >= g.w * 5 AND x.i < g.w * 5 + 60 GROUP BY ALL""")
def ls_slope(spark, sf):
    return rounded(_complete(_arrays(spark, sf, "eda").select("subject", "w", A.ls_slope(F.col("eda"), 1.0).alias("eda_slope")), spark, sf))


BLOCK = """, b AS (
    SELECT g.subject, g.w, x.* EXCLUDE (subject) FROM (SELECT subject, unnest(range(0, (duration / 5)::BIGINT - 2)) AS w FROM dur) g
    JOIN wide x ON x.subject = g.subject AND x.i >= g.w * 5 AND x.i < g.w * 5 + 15 WHERE g.w * 5 + 15 <= (SELECT duration FROM dur WHERE dur.subject = g.subject)
)"""


def _blocks(df):
    """Complete 15 s blocks."""
    a = [c for c in df.columns if c not in ("subject", "w")][0]
    return df.where(F.size(a) == 15)


@query(f"WITH {REC}{BLOCK}, k AS (SELECT *, avg(acc_x) OVER (PARTITION BY subject, w) AS m FROM b) SELECT subject, w, {R('sum(abs(acc_x - m))', 'acc_x_absint')} FROM k GROUP BY ALL")
def abs_integral(spark, sf):
    return rounded(_blocks(_arrays(spark, sf, "acc_x")).select("subject", "w", A.abs_integral(F.col("acc_x"), 1.0).alias("acc_x_absint")))


@query("""WITH e AS (SELECT CAST(vec_id AS VARCHAR) AS subject, embedding::DOUBLE[] AS v FROM embeddings
), x AS (SELECT subject, len(v) AS n, unnest(range(0, len(v))) AS i, unnest(v) - list_avg(v) AS x FROM e
), bins AS (SELECT subject, k, k * 32.0 / any_value(n) AS f, pow(sum(x * cos(2 * pi() * k * i / n)), 2) + pow(sum(x * sin(2 * pi() * k * i / n)), 2) AS power, max(abs(x)) AS most
    FROM x, range(1, 33) AS b(k) WHERE k * 32.0 / n BETWEEN 0.3 AND 10 GROUP BY subject, k
) SELECT subject, CASE WHEN max(most) = 0 THEN 0.0 ELSE arg_max(f, power) END::DOUBLE AS acc_x_peakfreq FROM bins GROUP BY subject""")
def peak_frequency(spark, sf):
    rec = X.recording_arrays(spark, sf, "acc_x")
    return rec.select("subject", signal.peak_frequency(32.0)(F.col("values")).alias("acc_x_peakfreq"))


def _tonic(half: int) -> str:
    """From e (subject, v list): the running median of 2 * half + 1 samples with zeros beyond the ends."""
    zeros = f"repeat([0.0::DOUBLE], {half})"
    middle = f"list_sort(list_slice(z, k, k + {2 * half}))[{half + 1}]"
    return f"""p AS (SELECT subject, v, list_concat(list_concat({zeros}, v), {zeros}) AS z, unnest(range(1, len(v) + 1)) AS k FROM e
), t AS (SELECT subject, k, {middle} AS tonic, v[k] - {middle} AS phasic, v[k] AS raw FROM p)"""


TONIC = f"WITH e AS (SELECT CAST(vec_id AS VARCHAR) AS subject, embedding::DOUBLE[] AS v FROM embeddings), {_tonic(16)}"


@query(TONIC + f" SELECT subject, (k - 1)::INTEGER AS sample_idx, {R('tonic')}, {R('phasic')} FROM t")
def eda_decompose(spark, sf):
    df = X.recording_arrays(spark, sf).select("subject", signal.eda_decompose(4.0)("values").alias("p"))
    df = df.select("subject", F.posexplode(F.arrays_zip("p.tonic", "p.phasic")).alias("sample_idx", "z"))
    return rounded(df.select("subject", "sample_idx", "z.tonic", "z.phasic"))


def _events(fs: int) -> str:
    """From t of _tonic: runs of equal samples; peaks above both neighbouring runs; the stretch without higher ground around each; its lows
    on both sides; where it crosses half of its amplitude."""
    return f""", ph AS (SELECT subject, k - 1 AS i, phasic AS x FROM t
), steps AS (SELECT *, CASE WHEN x = lag(x) OVER (PARTITION BY subject ORDER BY i) THEN 0 ELSE 1 END AS new FROM ph
), numbered AS (SELECT *, sum(new) OVER (PARTITION BY subject ORDER BY i) AS run FROM steps
), runs AS (SELECT subject, run, (min(i) + max(i)) // 2 AS p, any_value(x) AS px FROM numbered GROUP BY subject, run
), beside AS (SELECT *, lag(px) OVER (PARTITION BY subject ORDER BY run) AS a, lead(px) OVER (PARTITION BY subject ORDER BY run) AS b FROM runs
), reach AS (SELECT subject, p, px, coalesce(max(i) FILTER (i < p AND x > px) + 1, 0) AS l, coalesce(min(i) FILTER (i > p AND x > px) - 1, max(i)) AS r
    FROM beside JOIN ph USING (subject) WHERE px > a AND px > b GROUP BY ALL
), lows AS (SELECT subject, p, px, l, r, min(x) FILTER (i BETWEEN l AND p) AS low_l, min(x) FILTER (i BETWEEN p AND r) AS low_r FROM reach JOIN ph USING (subject) GROUP BY ALL
), tall AS (SELECT *, px - greatest(low_l, low_r) AS amp, px - (px - greatest(low_l, low_r)) / 2 AS half FROM lows WHERE px - greatest(low_l, low_r) >= 0.01
), feet AS (SELECT subject, p, amp, half, max(i) FILTER (i BETWEEN l AND p AND x = low_l) AS bl, min(i) FILTER (i BETWEEN p AND r AND x = low_r) AS br
    FROM tall JOIN ph USING (subject) GROUP BY ALL
), ends AS (SELECT subject, p, amp, half, max(i) FILTER (i BETWEEN bl AND p AND (x <= half OR i = bl)) AS il, min(i) FILTER (i BETWEEN p AND br AND (x <= half OR i = br)) AS ir
    FROM feet JOIN ph USING (subject) GROUP BY ALL
), width AS (SELECT e.subject, p, amp, CASE WHEN b.x < half THEN ir - (half - b.x) / (b2.x - b.x) ELSE ir END - CASE WHEN a.x < half THEN il + (half - a.x) / (a2.x - a.x) ELSE il END AS w
    FROM ends e JOIN ph a ON a.subject = e.subject AND a.i = il JOIN ph a2 ON a2.subject = e.subject AND a2.i = il + 1
    JOIN ph b ON b.subject = e.subject AND b.i = ir JOIN ph b2 ON b2.subject = e.subject AND b2.i = ir - 1
), ev AS (SELECT subject, p::DOUBLE AS idx, amp, w / {fs} / 2 AS rise, w / {fs} AS dur FROM width WHERE w >= 1)"""


EVENTS = TONIC + _events(4)


@query(EVENTS + f" SELECT subject, {R('idx')}, {R('amp')}, {R('rise')}, {R('dur')} FROM ev")
def scr_events(spark, sf):
    df = X.recording_arrays(spark, sf).select("subject", signal.eda_decompose(4.0)("values").alias("p"))
    return rounded(df.select("subject", F.explode(signal.scr_events(4.0)("p.phasic")).alias("e")).select("subject", "e.*"))


@query(TONIC + f""", ph AS (SELECT subject, k - 1 AS i, phasic AS x FROM t
    ), numbered AS (SELECT *, count(*) FILTER (new) OVER (PARTITION BY subject ORDER BY i) AS run FROM (SELECT *, x IS DISTINCT FROM lag(x) OVER (PARTITION BY subject ORDER BY i) AS new FROM ph)
    ), runs AS (SELECT subject, run, min(i) AS lo, max(i) AS hi, any_value(x) AS px FROM numbered GROUP BY subject, run
    ), turns AS (SELECT *, px > lag(px) OVER w AND px > lead(px) OVER w AS top, px < lag(px) OVER w AND px < lead(px) OVER w AS low FROM runs WINDOW w AS (PARTITION BY subject ORDER BY run)
    ), feet AS (SELECT *, last_value(CASE WHEN low THEN hi END IGNORE NULLS) OVER (PARTITION BY subject ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS foot,
            last_value(CASE WHEN low THEN px END IGNORE NULLS) OVER (PARTITION BY subject ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base,
            coalesce(first_value(CASE WHEN low THEN lo END IGNORE NULLS) OVER (PARTITION BY subject ORDER BY run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), max(hi) OVER (PARTITION BY subject)) AS until FROM turns
    ), found AS (SELECT subject, (lo + hi) // 2 AS p, px, px - base AS amp, foot, until, max(px - base) OVER (PARTITION BY subject) AS tallest FROM feet WHERE top AND foot IS NOT NULL
    ), back AS (SELECT f.subject, f.p, min(ph.i) AS i FROM found f JOIN ph ON ph.subject = f.subject AND ph.i BETWEEN f.p AND f.until AND ph.x <= f.px - f.amp / 2 GROUP BY ALL)
    SELECT subject, p::DOUBLE AS idx, {R('amp')}, {R('(p - foot) / 4.0', 'rise')}, {R('(p - foot) / 4.0 + coalesce((i - p) / 4.0, 0)', 'dur')}, {R('(i - p) / 4.0', 'recovery')}
    FROM found LEFT JOIN back USING (subject, p) WHERE amp >= greatest(0.01, 0.1 * tallest)""")
def scr_onsets(spark, sf):
    """Responses by onset and half recovery, over the phasic part of every vector."""
    df = X.recording_arrays(spark, sf).select("subject", signal.eda_decompose(4.0)("values").alias("p"))
    return rounded(df.select("subject", F.explode(signal.scr_onsets(4.0)("p.phasic")).alias("e")).select("subject", "e.*"))


@query()
def eda_sparse(spark, sf):
    """Tonic and phasic part of every vector by sparse deconvolution, and by which method it was made."""
    df = X.recording_arrays(spark, sf).select("subject", signal.eda_sparse(4.0)("values").alias("p"))
    df = df.select("subject", "p.method", F.posexplode(F.arrays_zip("p.tonic", "p.phasic")).alias("sample_idx", "z"))
    return rounded(df.select("subject", "sample_idx", "z.tonic", "z.phasic", "method"))


@query()
def eda_method_rates(spark, sf):
    """How many windows of the recordings were not made by deconvolution and by onsets."""
    import dataclasses

    from pulsegrid.operators import quality

    df = features.eda(_arrays(spark, sf, "eda"), dataclasses.replace(CFG, eda_split="sparse", scr_find="onset"))
    return rounded(quality.method_rates(df, ["eda_method", "scr_method"], {"eda_method": "sparse", "scr_method": "onset"}))


def _eda(spark, sf):
    return features.eda(X.recording_arrays(spark, sf).withColumnRenamed("values", "eda"), Config())


@query(TONIC + f""" SELECT subject, {R('avg(tonic)', 'eda_scl_mean')}, {R('stddev_pop(tonic)', 'eda_scl_sd')}, {R('stddev_pop(phasic)', 'eda_scr_sd')},
        {R('max(raw) - min(raw)', 'eda_range')}, {R('regr_slope(raw, (k - 1) / 4.0)', 'eda_slope')} FROM t GROUP BY subject""")
def eda_level_features(spark, sf):
    return rounded(_eda(spark, sf).select("subject", "eda_scl_mean", "eda_scl_sd", "eda_scr_sd", "eda_range", "eda_slope"))


@query(EVENTS + f""" SELECT subject, {R('count(idx)', 'eda_scr_count')}, {R('coalesce(sum(amp), 0)', 'eda_scr_amp_sum')}, {R('coalesce(avg(amp), 0)', 'eda_scr_amp_mean')},
        {R('coalesce(avg(rise), 0)', 'eda_scr_risetime_mean')}, {R('coalesce(sum(dur), 0)', 'eda_scr_duration_sum')} FROM e LEFT JOIN ev USING (subject) GROUP BY subject""")
def scr_features(spark, sf):
    return rounded(_eda(spark, sf).select("subject", *contract.EDA[5:]))


def _hr_blocks(spark, sf):
    blocks = _blocks(_arrays(spark, sf, "hr")).join(windows.baseline_refs(X.samples_1hz(spark, sf), CFG), "subject")
    return features.hr(blocks, CFG).select("subject", "w", *contract.HR)


HR_SQL = BLOCK + """, refs AS (
    SELECT subject, avg(hr) FILTER (i < 600 AND hr > 20 AND hr < 220) AS baseline_hr, avg(temp) FILTER (i < 600) AS baseline_temp FROM wide GROUP BY subject
), ok AS (SELECT *, row_number() OVER (PARTITION BY subject, w ORDER BY i) - 1 AS k FROM b WHERE hr > 20 AND hr < 220
), hrb AS (
    SELECT x.subject, x.w, avg(hr) AS hr_mean, stddev_pop(hr) AS hr_sd, min(hr) AS hr_min, max(hr) AS hr_max, max(hr) - min(hr) AS hr_range,
           CASE WHEN count(hr) >= 2 THEN regr_slope(hr, k) END AS hr_slope, avg(hr) - any_value(baseline_hr) AS hr_baseline_delta
    FROM (SELECT DISTINCT subject, w FROM b) x LEFT JOIN ok USING (subject, w) LEFT JOIN refs USING (subject) GROUP BY ALL
)"""


@query(f"WITH {REC}{HR_SQL} SELECT subject, w, {', '.join(R(c) for c in contract.HR)} FROM hrb")
def hr_features(spark, sf):
    return rounded(_hr_blocks(spark, sf))


def _imu_blocks(spark, sf):
    return features.imu(_blocks(_arrays(spark, sf, "acc_x", "acc_y", "acc_z")), CFG).select("subject", "w", *contract.IMU)


IMU_SQL = BLOCK + ", k AS (SELECT *, sqrt(acc_x * acc_x + acc_y * acc_y + acc_z * acc_z) AS acc_mag FROM b), km AS (SELECT *, " + ", ".join(f"avg(acc_{c}) OVER (PARTITION BY subject, w) AS m_{c}" for c in ("x", "y", "z", "mag")) + " FROM k), imub AS (SELECT subject, w, " + ", ".join(f"avg(acc_{c}) AS acc_{c}_mean, stddev_pop(acc_{c}) AS acc_{c}_sd, sum(abs(acc_{c} - m_{c})) AS acc_{c}_absint" for c in ("x", "y", "z", "mag")) + ", CASE WHEN stddev_pop(acc_mag) > 0.05 THEN 1.0 ELSE 0.0 END::DOUBLE AS motion_flag FROM km GROUP BY ALL)"
IMU_COLS = [c for c in contract.IMU if not c.endswith("peakfreq") and c != "motion_fraction"]


@query(f"WITH {REC}{IMU_SQL} SELECT subject, w, {', '.join(R(c) for c in IMU_COLS)} FROM imub")
def imu_features(spark, sf):
    return rounded(_imu_blocks(spark, sf).select("subject", "w", *IMU_COLS))


GATE = ", gate AS (SELECT g.subject, g.w, avg(f.motion_flag) AS motion_fraction, CASE WHEN avg(f.motion_flag) > 0.5 THEN 1.0 ELSE 0.0 END::DOUBLE AS motion_flag FROM grid g JOIN imub f ON f.subject = g.subject AND f.w IN (g.w, g.w + 3, g.w + 6, g.w + 9) GROUP BY ALL)"


@query(f"WITH {REC}{IMU_SQL}{GATE} SELECT subject, w, {R('motion_fraction')}, motion_flag FROM gate")
def motion_gate(spark, sf):
    rolled = features.rollup(_imu_blocks(spark, sf).select("subject", "w", "motion_flag", "motion_fraction"), ["motion_flag", "motion_fraction"], CFG)
    return rounded(_complete(rolled, spark, sf).select("subject", "w", "motion_fraction", "motion_flag"))


@query(f"""WITH {REC}, refs AS (SELECT subject, avg(temp) FILTER (i < 600) AS baseline_temp FROM wide GROUP BY subject)
        SELECT g.subject, g.w, {R('avg(temp)', 'temp_mean')}, {R('min(temp)', 'temp_min')}, {R('max(temp)', 'temp_max')}, {R('max(temp) - min(temp)', 'temp_range')},
               {R('regr_slope(temp, i)', 'temp_slope')}, {R('avg(temp) - any_value(baseline_temp)', 'temp_baseline_delta')}
        FROM grid g JOIN wide x ON x.subject = g.subject AND x.i >= g.w * 5 AND x.i < g.w * 5 + 60 JOIN refs r ON r.subject = g.subject GROUP BY g.subject, g.w""")
def temp_features(spark, sf):
    df = _arrays(spark, sf, "temp").join(windows.baseline_refs(X.samples_1hz(spark, sf), CFG), "subject")
    return rounded(_complete(features.temp(df, CFG), spark, sf).select("subject", "w", *contract.TEMP))


ROLLED = ", rolled AS (SELECT g.subject, g.w, " + ", ".join(f"{'min' if c.endswith('_min') else 'max' if c.endswith('_max') else 'avg'}(h.{c}) AS {c}" for c in contract.HR) + " FROM grid g JOIN hrb h ON h.subject = g.subject AND h.w IN (g.w, g.w + 3, g.w + 6, g.w + 9) GROUP BY ALL)"


@query(f"WITH {REC}{HR_SQL}{ROLLED} SELECT subject, w, {', '.join(R(c) for c in contract.HR)} FROM rolled")
def rollup_short_windows(spark, sf):
    return rounded(_complete(features.rollup(_hr_blocks(spark, sf), contract.HR, CFG), spark, sf))


@query(f"""WITH {REC}{HR_SQL}{ROLLED}{IMU_SQL.replace(BLOCK, '')}{GATE}, er AS (
            SELECT g.subject, g.w, max(eda) - min(eda) AS eda_range FROM grid g JOIN wide x ON x.subject = g.subject AND x.i >= g.w * 5 AND x.i < g.w * 5 + 60 GROUP BY ALL)
        SELECT subject, w, {R('hr_baseline_delta * (1 - motion_fraction)', 'hr_delta_x_still')}, {R('eda_range * (1 - motion_fraction)', 'eda_range_gated')}
        FROM rolled JOIN gate USING (subject, w) JOIN er USING (subject, w)""")
def cross_features(spark, sf):
    hr = features.rollup(_hr_blocks(spark, sf), contract.HR, CFG).select("subject", "w", "hr_baseline_delta")
    gate = features.rollup(_imu_blocks(spark, sf).select("subject", "w", "motion_flag", "motion_fraction"), ["motion_flag", "motion_fraction"], CFG).select("subject", "w", "motion_fraction")
    eda = _arrays(spark, sf, "eda").select("subject", "w", A.span(F.col("eda")).alias("eda_range"))
    df = _complete(hr.join(gate, ["subject", "w"]).join(eda, ["subject", "w"]), spark, sf)
    return rounded(features.cross(df).select("subject", "w", *contract.CROSS))


ACCEPTED = "SELECT subject, w, majority AS label, subject || ':' || w AS key FROM labelled WHERE reason IS NULL"


def table_sql(kept: str = ACCEPTED) -> str:
    """whole: all 42 features, every part as in its own query, of the windows ``kept``."""
    axes, window = ("x", "y", "z"), "x.subject = g.subject AND x.i >= g.w * 5 AND x.i < g.w * 5 + 60"
    turn = "2 * pi() * q.k * (i - w * 5) / 15"
    bins = " UNION ALL ".join(f"SELECT subject, w, '{c}' AS axis, q.k / 15.0 AS f, pow(sum((acc_{c} - m_{c}) * cos({turn})), 2) + pow(sum((acc_{c} - m_{c}) * sin({turn})), 2) AS power FROM km, range(5, 8) AS q(k) GROUP BY subject, w, q.k" for c in axes)
    moved = [c for c in contract.IMU if not c.endswith("peakfreq") and not c.startswith("motion")]
    return f"""WITH {REC}{LABELLED}{HR_SQL}{ROLLED}{IMU_SQL.replace(BLOCK, '')}{GATE}
    , bins AS ({bins}), best AS (SELECT subject, w, axis, arg_max(f, power) AS f FROM bins GROUP BY ALL
    ), turned AS (SELECT subject, w, {', '.join(f"max(f) FILTER (axis = '{c}') AS acc_{c}_peakfreq" for c in axes)} FROM best GROUP BY subject, w
    ), motion AS (SELECT g.subject, g.w, {', '.join(f'avg({c}) AS {c}' for c in [*moved, *(f'acc_{c}_peakfreq' for c in axes)])}
        FROM grid g JOIN imub f ON f.subject = g.subject AND f.w IN (g.w, g.w + 3, g.w + 6, g.w + 9) JOIN turned u ON u.subject = f.subject AND u.w = f.w GROUP BY g.subject, g.w
    ), kept AS ({kept}
    ), warm AS (SELECT g.key, avg(temp) AS temp_mean, min(temp) AS temp_min, max(temp) AS temp_max, max(temp) - min(temp) AS temp_range, regr_slope(temp, i) AS temp_slope,
            avg(temp) - any_value(baseline_temp) AS temp_baseline_delta FROM kept g JOIN wide x ON {window} JOIN refs r ON r.subject = g.subject GROUP BY g.key
    ), e AS (SELECT g.key AS subject, list(x.eda ORDER BY x.i) AS v FROM kept g JOIN wide x ON {window} GROUP BY g.key), {_tonic(4)}{_events(1)}
    , skin AS (SELECT subject AS key, avg(tonic) AS eda_scl_mean, stddev_pop(tonic) AS eda_scl_sd, stddev_pop(phasic) AS eda_scr_sd, max(raw) - min(raw) AS eda_range, regr_slope(raw, k - 1) AS eda_slope FROM t GROUP BY subject
    ), answers AS (SELECT e.subject AS key, count(idx) AS eda_scr_count, coalesce(sum(amp), 0) AS eda_scr_amp_sum, coalesce(avg(amp), 0) AS eda_scr_amp_mean, coalesce(avg(rise), 0) AS eda_scr_risetime_mean,
            coalesce(sum(dur), 0) AS eda_scr_duration_sum FROM e LEFT JOIN ev USING (subject) GROUP BY e.subject
    ), whole AS (SELECT kept.subject, kept.w, kept.label, skin.* EXCLUDE (key), answers.* EXCLUDE (key), warm.* EXCLUDE (key), rolled.* EXCLUDE (subject, w), motion.* EXCLUDE (subject, w), gate.* EXCLUDE (subject, w),
            hr_baseline_delta * (1 - motion_fraction) AS hr_delta_x_still, eda_range * (1 - motion_fraction) AS eda_range_gated
        FROM kept JOIN skin USING (key) JOIN answers USING (key) JOIN warm USING (key)
        JOIN rolled ON rolled.subject = kept.subject AND rolled.w = kept.w JOIN motion ON motion.subject = kept.subject AND motion.w = kept.w JOIN gate ON gate.subject = kept.subject AND gate.w = kept.w)"""


LABEL_NAME = "CASE label WHEN 1 THEN 'baseline' WHEN 2 THEN 'stress' WHEN 3 THEN 'amusement' END AS label_name"


@query(f"{table_sql()} SELECT {', '.join(R(c) for c in contract.FEATURE_NAMES)}, subject, label, {LABEL_NAME}, {R('w * 5', 't_start')} FROM whole")
def feature_table(spark, sf):
    return rounded(features.build_table(X.samples_1hz(spark, sf), X.labels_1hz(spark, sf), CFG))


@query(f"WITH {FEAT} SELECT subject, t_start, [eda_scl_mean, eda_range, eda_scr_count, eda_scr_amp_sum] AS features FROM feat")
def to_vector(spark, sf):
    return features.to_vector(X.features(spark, sf), X.FEATS[:4]).select("subject", "t_start", "features")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from pulsegrid import queries_model  # noqa: F401

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLES)
