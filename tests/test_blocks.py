"""Array helpers work in blocks: same rows, bounded memory, each once."""

import tracemalloc

import numpy as np

import __spark_entry__
from pulsegrid.functions import signal


def test_a_row_is_split_alike_beside_any_rows():
    y = np.random.default_rng(0).integers(1, 51, (1500, 60)) * 0.2
    y[7] = np.linspace(2, 3, 60)
    solver = signal.Deconvolution(60, 1.0)
    whole = solver.split(y)
    assert whole[3].all()
    for some in (slice(3, 4), slice(0, 40), slice(1100, 1500)):
        for a, b in zip(solver.split(y[some])[:3], whole[:3]):
            assert np.allclose(a, b[some], atol=1e-9)
    exact = signal.Deconvolution(60, 1.0, steps=20_000, tolerance=1e-9).split(y[:300])
    assert np.abs(whole[0][:300] - exact[0]).max() < 0.04 and np.median(np.abs(whole[0][:300] - exact[0]).max(axis=1)) < 0.005


def test_windows_are_deconvolved_once_for_the_rates(spark):
    plan = __spark_entry__.queries()["eda_method_rates"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_the_running_median_takes_a_bounded_copy():
    x = np.random.default_rng(1).normal(size=(10_000, 64))
    tracemalloc.start()
    got = signal.tonic_level(x, 4.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6  # the windows together are 170 MB
    assert (got[[0, 31, 9_999]] == np.concatenate([signal.tonic_level(x[[i]], 4.0) for i in (0, 31, 9_999)])).all()
