"""What the plan of the feature table sends after its blocks are made."""

import re

import __spark_entry__

SF = "/root/testdata/sf0.001"


def test_accepted_windows_meet_the_blocks_in_one_exchange_of_panes(spark):
    plan = __spark_entry__.queries()["feature_table"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", re.sub(r"#\d+L?", "", plan))
    assert not [k for k in keys if re.search(r"\bw\b", k)]  # whole windows were sent by (subject, chunk, w) to be joined
    assert "SortMergeJoin" not in plan
    lines = re.sub(r"#\d+L?", "", plan).split("\n")
    union = next(i for i, line in enumerate(lines) if "Union" in line)
    assert "Exchange hashpartitioning(subject, chunk," in lines[union - 1]
    assert lines[union + 1].count("flatten") == 0 and "eda" in lines[union + 1]  # the pane, not the window's array


def test_live_features_go_to_python_once(spark):
    """Skin conductance is split and its responses found in one call, beside the frequencies of motion."""
    from pulsegrid.queries import CFG
    from pulsegrid.streaming import live

    df = spark.createDataFrame([], "wearer string, start timestamp, baseline_hr double, baseline_temp double, refused string, " + ", ".join(f"{s} array<double>" for s in live.FUSED))
    plan = live.closed_features(df, CFG)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
