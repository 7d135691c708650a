"""Bounded samples of labelled rows, and training on them in shards."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .tables import small_batches


def labelled(docs: DataFrame, labels: DataFrame, target: Column, eligible: Column, max_rows: int, id_col: str, text_col: str) -> DataFrame:
    """(text, y, pick) of at most ``max_rows`` labelled documents, those of least hash of the id, written once.

    The limit bounds the label side, so its broadcast has at most ``max_rows`` rows of three numbers at any size
    of input and only those rows' texts are shuffled.  Rows whose id or target is null are left out, and so are ids with
    labels that differ.  An id that several documents share teaches by the least of their texts, a null text as an empty one.
    """
    pick = F.xxhash64(F.lit(17), F.col(id_col))
    few = labels.select(F.col(id_col).alias("_id"), target.alias("y"), pick.alias("pick"), eligible.alias("_ok")).where("_ok and _id is not null and y is not null")
    few = few.groupBy("_id", "pick").agg(F.min("y").alias("y"), F.max("y").alias("_most")).where("y = _most").drop("_most").orderBy("pick", "_id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(few), "_id")
    texts = texts.groupBy("_id", "pick", "y").agg(F.min("text").alias("text")).select("text", "y", "pick")
    return Scratch(docs.sparkSession, "sample").save(texts, "labelled")


def fit_in_shards(train: DataFrame, shards: int, rounds: int, start: np.ndarray, step: Callable[[list[str], np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Iterative parameter mixing: every round fits each shard from the shared state and averages the results.

    ``step(texts, targets, state)`` returns a state of the same shape.  A round sends one compressed state per
    shard to the driver, bounded by the shape alone.
    """
    small_batches(train.sparkSession)
    dealt = train.withColumn("shard", F.pmod(F.col("pick"), F.lit(shards)).cast("int")).repartitionByRange(shards, "shard")  # a shard is a task
    state = start

    shape = start.shape

    def pack(x: np.ndarray) -> bytes:
        return zlib.compress(x.astype(np.float32, copy=False).tobytes(), 1)

    def unpack(raw: bytes) -> np.ndarray:
        return np.frombuffer(zlib.decompress(raw), np.float32).reshape(shape)

    def fit_from(now: bytes):
        def run(frame):
            import pandas as pd

            frame = frame.sort_values("pick", kind="stable")
            done = step(list(frame["text"].fillna("")), frame["y"].to_numpy(dtype=np.float64), unpack(now).copy())
            return pd.DataFrame({"n": [len(frame)], "state": [pack(done)]})

        return run

    for _ in range(rounds):
        parts = dealt.groupBy("shard").applyInPandas(fit_from(pack(state)), "n long, state binary").collect()
        if not parts:
            return state
        total = sum(p["n"] for p in parts)
        state = np.zeros(shape, dtype=np.float32)
        for p in parts:  # one state at a time, in single precision
            state += np.float32(p["n"] / total) * unpack(p["state"])
    return state
