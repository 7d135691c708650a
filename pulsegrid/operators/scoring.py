"""Scoring of wearers after a warm-up."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid import contract
from pulsegrid.functions.arrays import finite
from pulsegrid.operators import scaling
from pulsegrid.sources import shared


def wearer_reference(df: DataFrame, cols: list[str], n_ref: int, cohort: dict[str, float], wider: str = "reference") -> DataFrame:
    """(subject, n_ref, ready, <col>_centre, <col>_scale) from each wearer's first rows; not ready with fewer than n_ref."""
    refs = scaling.centre_scale(df, cols, n_ref, cohort, wider)
    return refs.withColumn("ready", F.col("n_ref") >= n_ref)


def ready_rows(df: DataFrame, refs: DataFrame, cols: list[str], n_ref: int, clip: float = 20.0) -> DataFrame:
    """Scaled rows after the warm-up of ready wearers."""
    rows = scaling.ranked(contract.check_row_schema(df, cols)).where(F.col("_rank") > n_ref).drop("_rank")
    return scaling.zscores(rows.join(refs.where("ready").drop("ready"), "subject"), cols, clip)


def warmed_rows(df: DataFrame, cols: list[str], n_ref: int, cohort: dict[str, float] | None = None, clip: float = 20.0) -> DataFrame:
    """``ready_rows`` by the ``wearer_reference`` of the same rows, without a join: a row after the warm-up is one of a ready wearer.

    Without ``cohort`` the spreads over all rows are taken from ``df``, of the columns in which some wearer's reference has none: the
    others need no cohort.  ``df`` is then read once more.
    """
    rows = scaling.beside_reference(contract.check_row_schema(df, cols), cols, n_ref)
    flat = {c: ~F.coalesce(F.col(f"{c}_spread") > 0, F.lit(False)) for c in cols}
    centred = {c: finite(F.col(c)) - F.col(f"{c}_centre") for c in cols}
    rows = rows.select(
        *[c for c in df.columns if c not in cols], *[F.when(flat[c], centred[c]).otherwise(centred[c] / F.col(f"{c}_spread")).alias(c) for c in cols],
        *[flat[c].alias(f"{c}_flat") for c in cols],
    )
    if cohort is None:
        rows = shared.written(rows, "warmed")  # read for the columns that need the cohort and for the result
        some = rows.agg(*[F.max(f"{c}_flat").alias(c) for c in cols]).first()
        need = [c for c in cols if some[c]]
        cohort = scaling.cohort_spread(shared.written(df.select(*need), "values"), need) if need else {}
    whole = {c: scaling.divisor(F.lit(cohort.get(c)).cast("double")) for c in cols}
    scaled = {c: scaling.clipped(F.when(F.col(f"{c}_flat"), F.col(c) / whole[c]).otherwise(F.col(c)), clip) for c in cols}
    return rows.withColumns(scaled).drop(*[f"{c}_flat" for c in cols])


def score(df: DataFrame, refs: DataFrame | None, model: PipelineModel, sidecar: dict) -> DataFrame:
    """(subject, t_start, state, probabilities by class name), names looked up by class code; without ``refs`` each wearer's own first rows are the reference."""
    cols, n_ref, clip = sidecar["feature_names"], sidecar["n_ref"], sidecar["clip"]
    contract.guard(cols, sidecar["feature_set"])
    rows = warmed_rows(df, cols, n_ref, sidecar["cohort_iqr"], clip) if refs is None else ready_rows(df, refs, cols, n_ref, clip)
    return named_predictions(model.transform(rows), sidecar)


def named_predictions(predicted: DataFrame, sidecar: dict, keep: tuple[str, ...] = ()) -> DataFrame:
    names = {int(k): v for k, v in sidecar["class_names"].items()}
    lookup = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    out = predicted.withColumn("state", lookup[F.col("prediction").cast("int")])
    if "probability" not in predicted.columns:
        return out.select("subject", "t_start", "state", *keep)
    p = vector_to_array("probability")
    return out.select("subject", "t_start", "state", *keep, F.create_map(*[x for k, v in names.items() for x in (F.lit(v), p[k])]).alias("probabilities"))
