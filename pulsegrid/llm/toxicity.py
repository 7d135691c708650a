"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, word pairs and pairs with one word between, hashed to 2**21 coordinates.
FTRL-proximal keeps z and n per coordinate: the rate falls with the root of n, and a coordinate with |z| <= L1
has weight 0.  Shards of a bounded labelled sample are fitted apart and z and n averaged, twice; a shard leaves
out coordinates with |z| under a quarter of L1, so what it sends is small.  The non-zero weights are what every scoring
task gets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sample, textvec
from .tables import small_batches


@dataclass(frozen=True)
class Params:
    bits: int = 21
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 2.5
    l2: float = 0.0
    max_rows: int = 32_000
    shards: int = 4
    rounds: int = 2
    passes: int = 2


def features(buf: np.ndarray, offs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, coordinate) of words, pairs and skip pairs, sorted by row."""
    row, h, _, _ = textvec.words(buf, offs)
    rows, vals = [row], [textvec.mix(h, 1)]
    for gap, salt in ((1, 2), (2, 3)):
        if len(h) > gap:
            same = row[gap:] == row[:-gap]
            rows.append(row[gap:][same])
            vals.append(textvec.mix(h[:-gap][same] * np.uint64(0x9E3779B97F4A7C15 | 1) + h[gap:][same], salt))
    r, v, _ = textvec.distinct(np.concatenate(rows), np.concatenate(vals) >> np.uint64(64 - bits), bits)
    return r, v.astype(np.int64)


def weights_of(state: np.ndarray, p: Params, at=slice(None)) -> np.ndarray:
    z, n = state[0, at], state[1, at]
    return np.where(np.abs(z) <= p.l1, 0.0, -(z - np.sign(z) * p.l1) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2))


def _step(p: Params):
    bias = 1 << p.bits

    def step(texts: list[str], y: np.ndarray, state: np.ndarray) -> np.ndarray:
        rows = []
        for lo, hi, buf, offs in textvec.blocks(pa.array(texts, pa.large_string())):
            r, v = features(buf, offs, p.bits)
            rows += [x.astype(np.int32) for x in np.split(v, np.searchsorted(r, np.arange(1, hi - lo)))]
        for k in range(p.passes):
            for i in np.random.default_rng(k).permutation(len(rows)):
                at = np.append(rows[i], bias)
                w = weights_of(state, p, at)
                w[-1] = -state[0, bias] / ((p.beta + np.sqrt(state[1, bias])) / p.alpha + p.l2)  # no L1 on the bias
                g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y[i]
                root = np.sqrt(state[1, at])
                state[0, at] += g - (np.sqrt(state[1, at] + g * g) - root) / p.alpha * w
                state[1, at] += g * g
        faint = np.abs(state[0]) < p.l1 / 4  # no mean of shards passes L1 by such as these
        faint[bias] = False
        state[:, faint] = 0
        return state

    return step


@dataclass(frozen=True)
class Model:
    """Non-zero coordinates only; ``bias`` alone if nothing was labelled."""

    params: Params
    at: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        table = self.__dict__.get("_table")
        if table is None:  # once per worker
            table = self.__dict__["_table"] = np.zeros(1 << self.params.bits, np.float32)
            table[self.at] = self.weight
        out = np.zeros(len(texts))
        for lo, hi, buf, offs in textvec.blocks(texts):
            r, v = features(buf, offs, self.params.bits)
            w = table[v]
            keep = w != 0
            out[lo:hi] = textvec.row_sums(r[keep], w[keep], hi - lo)
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, eligible: Column, target: str = "toxic", params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``params.max_rows`` labelled rows for which ``eligible`` (over the id) holds.

    Labels other than 0 and 1 and null ones are ignored; without any usable row the score is 0.018 everywhere.
    """
    y = F.when(F.col(target).isin(0, 1), F.col(target).cast("double"))
    train = sample.labelled(docs, labels, y, eligible, params.max_rows, id_col, text_col)
    state = sample.fit_in_shards(train, params.shards, params.rounds, np.zeros((2, (1 << params.bits) + 1), np.float32), _step(params))
    b = 1 << params.bits
    bias = -state[0, b] / ((params.beta + np.sqrt(state[1, b])) / params.alpha + params.l2) if state[1, b] else -4.0
    at = np.flatnonzero((state[0, :-1] > params.l1) | (state[0, :-1] < -params.l1))
    return Model(params, at, weights_of(state[:, at].astype(np.float64), params), float(bias))


def scored(docs: DataFrame, score, text_col: str = "text", names: tuple[str, ...] = ("score",)) -> DataFrame:
    """``docs`` with what ``score(texts)`` returns for each text as double columns of the given names."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(name, T.DoubleType()) for name in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = score(batch.column(at))
            cols = [pa.array(c, pa.float64()) for c in (got if isinstance(got, (tuple, list)) else [got])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=schema.names)

    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, score in 0..1, predicted.

    Null and empty texts get the score of the bias alone; ids may be null or repeated; an empty table gives no
    rows; other columns are ignored.  One scan, no shuffle.
    """
    out = scored(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model.score)
    return out.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
