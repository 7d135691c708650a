"""Fit the final model, save it with its contract, load and check it."""

from __future__ import annotations

import json
from datetime import datetime, timezone

import pyspark
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid import contract
from pulsegrid.config import Config
from pulsegrid.operators import scaling, scoring
from pulsegrid.plans import loso
from pulsegrid.sources import shared

CLASS_NAMES = {"binary": {0: "non-stress", 1: "stress"}, "3class": {1: "baseline", 2: "stress", 3: "amusement"}}


def fit_final(df: DataFrame, task: str, model: str, feature_set: str, seed: int = 0, cfg: Config = Config(), trees: loso.Trees = loso.Trees()) -> tuple[PipelineModel, dict]:
    """(model over all subjects, contract): column order, cohort spread, class names, counts."""
    cols = contract.resolve(feature_set, df.columns)
    contract.guard(cols, feature_set)
    scaled = scaling.make_target(scaling.standardise(df, "baseline", cols, cfg.n_ref, cfg.clip, cfg.min_ref), task)
    scaled = shared.written(scaled.select("subject", "t_start", "y", *[c for c in cols if c != "t_start"]), "scaled")  # read for the weights, the bins and the fit
    estimator = loso.make_estimator(model, task, seed, trees)
    if scaled.count() > loso.WHOLE:  # by cells, as the folds are
        binner, bins = loso.bucketizer(scaled, cols), [f"{c}_bin" for c in cols]
        into = VectorAssembler(inputCols=bins, outputCol="x")
        train = into.transform(loso.weighted(loso.cells(binner.transform(scaled), bins), bins))
        fitted = PipelineModel([binner, into, estimator.fit(train)])
    else:
        train = scaled.join(F.broadcast(loso.class_weights(scaled)), "y")
        fitted = Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="x"), estimator]).fit(train)
    balance = {str(r["y"]): r["n"] for r in scaled.groupBy("y").agg(F.count("*").alias("n")).collect()}
    sidecar = {
        "task": task, "model": model, "feature_set": feature_set, "feature_names": cols, "seed": seed, "n_ref": cfg.n_ref, "clip": cfg.clip,
        "cohort_iqr": {r["feature"]: r["iqr"] for r in scaling.cohort_iqr(df, cols).collect()}, "class_balance": balance,
        "class_names": {str(k): v for k, v in CLASS_NAMES[task].items()}, "n_train_windows": sum(balance.values()),
        "n_train_subjects": df.select("subject").distinct().count(), "spark_version": pyspark.__version__, "exported_utc": datetime.now(timezone.utc).isoformat(timespec="seconds"),
    }
    return fitted, sidecar


def save(spark: SparkSession, model: PipelineModel, sidecar: dict, path: str) -> None:
    contract.guard(sidecar["feature_names"], sidecar["feature_set"])
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(sidecar),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/contract")


def load(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    """Refuses another Spark version, time as a feature, or a model that cannot predict a row of zeros."""
    sidecar = json.loads(spark.read.text(f"{path}/contract").first()["value"])
    if sidecar["spark_version"] != pyspark.__version__:
        raise contract.ContractError(f"made by Spark {sidecar['spark_version']}")
    cols = sidecar["feature_names"]
    contract.guard(cols, sidecar["feature_set"])
    model = PipelineModel.load(f"{path}/model")
    zero = spark.createDataFrame([tuple(0.0 for _ in cols)], T.StructType([T.StructField(c, T.DoubleType()) for c in cols]))
    if model.transform(zero).select("prediction").first()[0] is None:
        raise contract.ContractError("the model does not predict")
    return model, sidecar


def verify(spark: SparkSession, path: str, df: DataFrame) -> DataFrame:
    """(check, rows, passed): the saved model used as a live host does, on all wearers of a feature table.

    cold_start: with one reference row too few nothing is scored.  warm_up: wearers that are ready.  inference: every row after a
    warm-up has a state.  broken_row: rows without a feature are refused (1).  reset: a warm-up begins anew after the first.
    """
    model, sidecar = load(spark, path)
    cols, n_ref = sidecar["feature_names"], sidecar["n_ref"]
    df = shared.written(df, "verified")  # read for every check
    order = scaling.ranked(df)

    def scored(rows: DataFrame, reference: DataFrame | None = None) -> int:
        refs = None if reference is None else scoring.wearer_reference(reference, cols, n_ref, sidecar["cohort_iqr"])
        return scoring.score(rows, refs, model, sidecar).where("state is not null").count()

    sizes = df.groupBy("subject").agg(F.count("*").alias("n"))
    beyond = lambda k: F.coalesce(F.sum(F.greatest(F.col("n") - k, F.lit(0))), F.lit(0))
    want = sizes.agg(F.count_if(F.col("n") >= n_ref).alias("ready"), beyond(n_ref).alias("first"), beyond(2 * n_ref).alias("second")).first()
    ready = scoring.wearer_reference(df, cols, n_ref, sidecar["cohort_iqr"]).where("ready").count()
    try:
        scored(df.drop(cols[0]))
        refused = 0
    except contract.ContractError:
        refused = 1
    later = order.where(F.col("_rank") > n_ref).drop("_rank")
    found = [
        ("cold_start", scored(df, order.where(F.col("_rank") < n_ref).drop("_rank")), 0), ("warm_up", ready, want["ready"]),
        ("inference", scored(df), want["first"]), ("broken_row", refused, 1), ("reset", scored(later), want["second"]),
    ]
    return spark.createDataFrame([(c, n, n == w) for c, n, w in found], "check string, rows long, passed boolean")
