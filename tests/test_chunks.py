import dataclasses
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid import contract
from pulsegrid.config import one_hertz
from pulsegrid.operators import features, timebase, windows

CFG = one_hertz()


def recordings(spark):
    rng = np.random.default_rng(3)
    rows = [(s, stream, i, float(rng.normal(70 if stream == "hr" else 1, 2 if stream == "hr" else 0.2))) for s, n in (("a", 700), ("b", 130), ("c", 59)) for stream in ("eda", "temp", "hr", "acc_x", "acc_y", "acc_z") for i in range(n)]
    labels = [(s, i, 1 + (i // 90) % 3) for s, n in (("a", 700), ("b", 130), ("c", 59)) for i in range(n)]
    return spark.createDataFrame(rows, "subject string, stream string, sample_idx long, v double").repartition(3), spark.createDataFrame(labels, "subject string, sample_idx long, label int")


@pytest.mark.parametrize("chunk_s", [60.0, 85.0, 300.0])
def test_chunks_make_no_difference(spark, chunk_s):
    samples, labels = recordings(spark)
    table = lambda cfg: {(r["subject"], r["t_start"]): r.asDict() for r in features.build_table(samples, labels, cfg).collect()}
    whole, cut = table(CFG), table(dataclasses.replace(CFG, chunk_s=chunk_s))
    assert whole.keys() == cut.keys() and len(whole) > 30
    for k, r in whole.items():
        for c in contract.FEATURE_NAMES:
            assert cut[k][c] == pytest.approx(r[c], abs=1e-9), (k, c)


def test_one_recording_is_many_groups_and_only_halos_are_doubled(spark):
    samples, _ = recordings(spark)
    cfg = dataclasses.replace(CFG, chunk_s=300.0)
    rows = windows.dealt(samples.where("subject = 'a' and stream = 'eda'"), cfg)
    sizes = {r["chunk"]: r["count"] for r in rows.groupBy("chunk").count().collect()}
    assert sizes == {0: 300 + 55, 1: 300 + 55, 2: 100}
    with pytest.raises(ValueError):
        windows.chunks(F.col("pane"), dataclasses.replace(CFG, chunk_s=30.0))


def test_the_plan_exchanges_samples_once_and_has_no_window_of_a_whole_wearer(spark):
    plan = features.build_table(*recordings(spark), CFG)._jdf.queryExecution().executedPlan().toString()
    spans = [line for line in plan.splitlines() if " Window [" in line or "+- Window" in line]
    assert spans and all("chunk#" in line for line in spans)


@pytest.mark.parametrize("side", ["nearest", "before", "after"])
@pytest.mark.parametrize("chunk_s", [1.0, 40.0, 3600.0])
def test_nearest_in_time_equals_all_pairs(spark, side, chunk_s):
    rng = np.random.default_rng(5)
    at = lambda us: dt.datetime(1969, 12, 31, 23, 59, tzinfo=dt.timezone.utc) + dt.timedelta(microseconds=int(us))
    left = [(i, str(rng.integers(0, 3)), at(rng.integers(0, 60_000_000))) for i in range(150)] + [(900, "0", None), (901, None, at(5)), (902, "lone", at(7)), (0, "0", at(30_000_000)), (0, "0", at(30_000_000))]
    right = [(str(rng.integers(0, 3)), at(rng.integers(0, 120_000_000) // 500_000 * 500_000), int(v), "t") for v in rng.integers(0, 9, 60)] + [("0", None, 3, "t"), (None, at(5), 4, "t"), ("1", left[3][2], 8, "t")]
    lefts = spark.createDataFrame(left, "id int, subject string, ts timestamp")
    rights = spark.createDataFrame(right, "subject string, ts timestamp, label int, _row string")
    out = timebase.nearest_in_time(lefts, rights, 1.5, ["label"], side, chunk_s)
    assert out.columns == ["id", "subject", "ts", "label", "off_s"]
    want = []
    for i, s, t in left:
        found = [((b - t).total_seconds(), v) for r, b, v, _ in right if s is not None and t is not None and r == s and b is not None]
        found = [(abs(d), d > 0, -v) for d, v in found if abs(d) <= 1.5 and (side == "nearest" or (d <= 0 if side == "before" else d >= 0))]
        best = min(found, default=None)
        want.append((i, None if best is None else -best[2], None if best is None else round(best[0], 6)))
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted([(r["id"], r["label"], r["off_s"] if r["off_s"] is None else round(r["off_s"], 6)) for r in out.collect()], key=key) == sorted(want, key=key)
