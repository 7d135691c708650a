"""What the acceptance checks send about: no sort of all samples for one median, no join of samples that cannot be off."""

import re

from pulsegrid.config import Config, one_hertz
from pulsegrid.operators import quality

HALF = Config(fs=one_hertz().fs | {"label": 0.5})


def test_the_median_is_taken_from_counts_of_values(spark):
    samples = spark.createDataFrame([("a", s, i, None if i == 3 else float(i % 3)) for s in ("temp", "eda") for i in range(8)], "subject string, stream string, sample_idx long, v double")
    per = quality.tracks(samples)
    aggregates = [line for line in per._jdf.queryExecution().executedPlan().toString().splitlines() if "Aggregate(" in line]
    assert not any("percentile" in line for line in aggregates[-2:])  # the two next to the samples
    assert sorted(map(tuple, per.collect())) == [("a", "eda", 8, 8, 1, 0.0, None), ("a", "temp", 8, 8, 1, 0.0, 1.0)]


def test_only_samples_beside_a_turn_of_labels_are_joined(spark):
    samples = spark.createDataFrame([("a", "eda", i, 1.0) for i in range(40)], "subject string, stream string, sample_idx long, v double")
    labels = spark.createDataFrame([("a", i, 1 + i // 6) for i in range(19) if i != 12], "subject string, sample_idx long, label int")
    found = quality.check_alignment(samples, labels, HALF)
    assert len(re.findall(r"\bJoin\b", found._jdf.queryExecution().optimizedPlan().toString())) == 1
    assert [tuple(r) for r in found.collect()] == [("a", "alignment", "2")]  # at labels 6 and 18; 12 is missing
