"""Quality classifier: n-gram indicators scaled by log-count ratios, a linear hinge loss by dual coordinate descent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchspark.llm.common import append_arrow, crc_of_id, hash_sample, mix, table, text_chunks, word_hashes, word_spans

#: Indicators are hashed into so many cells.
DIMS = 1 << 17
#: Labelled rows that the model is fitted on: what a driver can hold of their indicators.
TRAIN_ROWS = 6000

_SEP = np.zeros(256, bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
#: Byte classes: 0 other sign, 1 lower-case letter or byte of a non-ASCII one, 2 upper-case letter, 3 digit, 4 sentence sign.
_CLASS = np.zeros(256, np.uint64)
_CLASS[97:123], _CLASS[128:], _CLASS[65:91], _CLASS[48:58] = 1, 1, 2, 3
_CLASS[[33, 44, 46, 58, 59, 63]] = 4


def indicator_cells(column: pa.Array) -> Iterator[np.ndarray]:
    """One text after the other, its distinct cells: word 1- and 2-grams and 1- to 3-grams of word shapes (first, last and widest byte class,
    length, whether the word repeats the one before it)."""
    for _, data, offsets in text_chunks(column):
        starts, ends, doc = word_spans(_SEP[data], offsets)
        rows = len(offsets) - 1
        if not len(starts):
            yield from [np.zeros(0, np.int64)] * rows
            continue
        h = word_hashes(data, starts, ends)
        kinds = _CLASS[data]
        seen = np.bitwise_or.reduceat(np.left_shift(np.uint64(1), kinds), starts) & np.uint64(31)  # separators add a harmless 0-class bit
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        length = np.minimum(np.log2(ends - starts), 7).astype(np.uint64)
        last2 = kinds[np.maximum(ends - 2, starts)]
        shape = (((((kinds[starts] * np.uint64(5) + kinds[ends - 1]) * np.uint64(5) + last2) * np.uint64(32) + seen) * np.uint64(8) + length) * np.uint64(2)) + same.astype(np.uint64)
        s = mix(shape + np.uint64(1000))
        two, three = doc[1:] == doc[:-1], doc[2:] == doc[:-2]
        k = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
        grams = [h, (h[:-1] * k[0] + h[1:])[two], s, (s[:-1] * k[1] + s[1:])[two], (s[:-2] * k[1] + s[1:-1] * k[2] + s[2:])[three]]
        owner = [doc, doc[:-1][two], doc, doc[:-1][two], doc[:-2][three]]
        cells = (mix(np.concatenate(grams)) >> np.uint64(47)).astype(np.int64)
        joint = np.unique(np.concatenate(owner) * DIMS + cells)
        cut = np.searchsorted(joint, np.arange(rows + 1) * DIMS)
        yield from (joint[a:b] % DIMS for a, b in zip(cut[:-1], cut[1:]))


class SupportVectors:
    """Score = logistic of ``slope`` * margin + ``shift``; the margin of a text is the mean weight of its cells, root-scaled."""

    def __init__(self, weight: np.ndarray, bias: float, slope: float, shift: float):
        self.weight, self.bias, self.slope, self.shift = weight, bias, slope, shift

    def margin(self, cells: np.ndarray, norm: np.ndarray) -> float:
        scale = np.sqrt(norm[cells].sum()) if len(cells) else 0.0
        return float(self.weight[cells].sum() / scale + self.bias) if scale > 0 else self.bias


class QualityModel:
    def __init__(self, ratio: np.ndarray, machine: SupportVectors | None, prior: float):
        self.norm, self.machine, self.prior = ratio**2, machine, prior

    def score(self, cells: np.ndarray) -> float:
        if self.machine is None:
            return self.prior
        z = self.machine.slope * self.machine.margin(cells, self.norm) + self.machine.shift
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: np.ndarray, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """The hinge-loss weights over ratio-scaled, unit-length indicators: each step solves one dual variable within [0, cost].

    A row's values are taken from ``ratio`` when it is met: held for all rows they would be the largest thing in the driver."""
    w, bias = np.zeros(len(ratio)), 0.0
    norm = np.array([max(np.linalg.norm(ratio[r]), 1e-12) for r in rows])
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            values = ratio[rows[i]] / norm[i]
            grad = y[i] * (float(w[rows[i]] @ values) + bias) - 1
            new = min(max(alpha[i] - grad / (float(values @ values) + 1.0), 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * values
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def fit_quality(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", train_rows: int = TRAIN_ROWS) -> QualityModel:
    """Fitted on about ``train_rows`` labelled rows (a documented bound; chosen by a hash of the id), which are broadcast to
    the documents, so that no text is shuffled. Without rows of both classes every score is the share of label 1."""
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("__y"))
    chosen = hash_sample(known, train_rows, "__id", known.count())
    train = docs.select(F.col(doc_id).alias("__id"), text).join(F.broadcast(chosen), "__id")

    def cells(column):
        return (pa.array([c.astype(np.int32) for c in indicator_cells(column)], pa.list_(pa.int32())),)

    got = append_arrow(train, [text], {"cells": "array<int>"}, cells, keep=["__id", "__y"]).orderBy("__id", "__y").toArrow()
    y01 = got.column("__y").to_numpy()
    if len(y01) == 0 or y01.min() == y01.max():
        return QualityModel(np.ones(DIMS), None, float(y01.mean()) if len(y01) else 0.5)
    rows = [np.asarray(r.values) for r in got.column("cells")]
    p, q = np.ones(DIMS), np.ones(DIMS)
    for r, y in zip(rows, y01):
        (p if y else q)[r] += 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    ratio[(p == 1) & (q == 1)] = 0  # never seen in training
    y = np.where(y01 == 1, 1.0, -1.0)
    cost = np.where(y01 == 1, 1.0, max(1.0, (y01 == 1).sum() / max(1, (y01 == 0).sum()) / 2))
    fold = np.arange(len(rows)) % 3
    margins = np.zeros(len(rows))
    for f in range(3):  # margins of rows not fitted on set the scale of the score
        some = np.flatnonzero(fold != f)
        if len(set(y[some])) < 2:
            some = np.arange(len(rows))
        w, b = dual_coordinate_descent([rows[i] for i in some], y[some], ratio, cost[some], epochs=5)
        machine = SupportVectors(w * ratio, b, 1, 0)
        for i in np.flatnonzero(fold == f):
            margins[i] = machine.margin(rows[i], ratio**2)
    slope, shift = _logistic(margins, y01)
    w, b = dual_coordinate_descent(rows, y, ratio, cost)
    return QualityModel(ratio, SupportVectors(w * ratio, b, slope, shift), 0.5)


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of a ridge logistic regression of y on x, by Newton steps."""
    beta = np.array([1.0, 0.0])
    xs = np.stack([x, np.ones(len(x))], 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(xs @ beta, -30, 30)))
        g = xs.T @ (p - y) + 1e-2 * (beta - [1.0, 0.0])
        hess = (xs * (p * (1 - p))[:, None]).T @ xs + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, g)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(beta[0], 1e-3)), float(beta[1])


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``quality_score`` in [0, 1].

    Defined results: NULL or empty text has no indicators and gets the score of the bias alone; equal texts get equal scores;
    other columns are carried on, one of the name ``quality_score`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMS floats, whatever the input

    def score(column):
        return (pa.array([shared.value.score(c) for c in indicator_cells(column)], pa.float64()),)

    return append_arrow(docs, [text], {"quality_score": "double"}, score, keep)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, learned from two thirds of the labels."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = crc_of_id() % 3 == 1
    model = fit_quality(docs, labels.filter(~held))
    return score_quality(docs, model, keep=["doc_id"]).select("doc_id", held.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))
