"""Quality by ordinal cumulative-link regression on graded ratings over hashed text.

P(grade >= k) = sigmoid(s - t[k]) with one score s = sum of weights for all grades and ordered thresholds
t[1] < t[2] < ...  (kept ordered as t[1] plus exponentials).  The features of a text are the shares, of its
tokens, of hashed words, of hashed token shapes (letter case, digits and marks) and of tokens equal to the one
before, so length does not matter.
The expected grade is the sum of the tail probabilities; a tail probability selects documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sample, textvec
from .toxicity import scored


@dataclass(frozen=True)
class Params:
    bits: int = 16
    grades: int = 3
    rate: float = 0.4
    l2: float = 1e-5
    max_rows: int = 12_000
    shards: int = 4
    rounds: int = 2
    passes: int = 3


def features(buf: np.ndarray, offs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, coordinate, root of the share) of hashed words and shapes, sorted by row."""
    row, h, s, e = textvec.words(buf, offs, textvec.TOKEN)
    shape = textvec.shapes(buf, offs, s, e)
    half = np.uint64(1 << (bits - 1))
    value = np.concatenate([textvec.mix(h, 5) >> np.uint64(65 - bits), (textvec.mix(shape, 6) >> np.uint64(65 - bits)) | half])
    again = np.flatnonzero((h[1:] == h[:-1]) & (row[1:] == row[:-1])) + 1
    value = np.concatenate([value, np.full(len(again), 3, np.uint64)])
    r, v, count = textvec.distinct(np.concatenate([row, row, row[again]]), value, bits)
    total = np.bincount(row, minlength=len(offs) - 1)
    return r, v.astype(np.int64), np.sqrt(count / np.maximum(total[r], 1))


def thresholds(raw: np.ndarray) -> np.ndarray:
    return np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _step(p: Params):
    """AdaGrad on the likelihood; the state has weights, then raw thresholds, in row 0, squared gradients in row 1."""
    m, k = 1 << p.bits, p.grades - 1

    def step(texts: list[str], y: np.ndarray, state: np.ndarray) -> np.ndarray:
        rows = []
        for lo, hi, buf, offs in textvec.blocks(pa.array(texts, pa.large_string())):
            r, v, x = features(buf, offs, p.bits)
            cut = np.searchsorted(r, np.arange(1, hi - lo))
            rows += zip(np.split(v, cut), np.split(x, cut))
        w, g2 = state
        for pas in range(p.passes):
            for i in np.random.default_rng(pas).permutation(len(rows)):
                at, x = rows[i]
                grade = int(y[i])
                above = _sigmoid((w[at] * x).sum() - thresholds(w[m:]))
                up = above[grade - 1] if grade else 1.0  # P(>= grade) and P(> grade)
                down = above[grade] if grade < k else 0.0
                # d log(up - down): with sigmoid slopes this is 1 - up - down in s, as a telescoped form
                ds = 1.0 - up - down
                dt = np.zeros(k)
                gap = max(up - down, 1e-9)
                if grade:
                    dt[grade - 1] -= up * (1 - up) / gap
                if grade < k:
                    dt[grade] += down * (1 - down) / gap
                tail = np.cumsum(dt[::-1])[::-1]  # raw[j] moves every threshold from j on
                raw = tail * np.concatenate([[1.0], np.exp(w[m + 1 :])])
                g = np.clip(ds, -1, 1) * x - p.l2 * w[at]
                g2[at] += g * g
                w[at] += p.rate * g / np.sqrt(g2[at] + 1e-8)
                raw = np.clip(raw, -1, 1)
                g2[m:] += raw * raw
                w[m:] += p.rate * raw / np.sqrt(g2[m:] + 1e-8)
        return state

    return step


@dataclass(frozen=True)
class Model:
    params: Params
    weight: np.ndarray
    thresholds: np.ndarray

    def score(self, texts: pa.Array) -> list[np.ndarray]:
        """[expected grade, P(grade >= 1), P(grade >= 2), ...] of each text."""
        s = np.zeros(len(texts))
        for lo, hi, buf, offs in textvec.blocks(texts):
            r, v, x = features(buf, offs, self.params.bits)
            s[lo:hi] = textvec.row_sums(r, self.weight[v] * x, hi - lo)
        tails = [_sigmoid(s - t) for t in self.thresholds]
        return [sum(tails), *tails]


def fit(docs: DataFrame, labels: DataFrame, eligible: Column, grade: Column, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``params.max_rows`` rated rows; ``grade`` runs from 0 to grades - 1, other values are ignored.

    Without any usable row the weights are 0 and the thresholds below 0, so every text counts as good.
    """
    y = F.when(grade.between(0, params.grades - 1), grade.cast("double"))
    train = sample.labelled(docs, labels, y, eligible, params.max_rows, id_col, text_col)
    start = np.zeros((2, (1 << params.bits) + params.grades - 1))
    start[0, 1 << params.bits] = -2.0
    state = sample.fit_in_shards(train, params.shards, params.rounds, start, _step(params))
    m = 1 << params.bits
    return Model(params, state[0, :m].astype(np.float32), thresholds(state[0, m:].astype(np.float64)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, expected_grade, p_ge_1 ... and keep = P(grade >= 1) >= 0.5.

    Null, empty and blank texts have no features and are judged by the thresholds alone; ids may be null or
    repeated; an empty table gives no rows; other columns are ignored.  One scan, no shuffle.
    """
    names = ("expected_grade", *(f"p_ge_{k}" for k in range(1, model.params.grades)))
    out = scored(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model.score, names=names)
    return out.select("doc_id", *names, (F.col("p_ge_1") >= 0.5).alias("keep"))


def editorial_grade(quality: str = "quality", toxic: str = "toxic") -> Column:
    """0 poor, 1 sound but toxic, 2 sound and clean; null if a rating is missing or not 0 or 1."""
    ok = F.col(quality).isin(0, 1) & F.col(toxic).isin(0, 1)
    return F.when(ok, F.when(F.col(quality) == 0, 0).when(F.col(toxic) == 1, 1).otherwise(2))
