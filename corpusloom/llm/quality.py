"""Naive Bayes support vectors for document quality.

Indicators of n-grams are scaled by their class log-count ratios, a linear hinge-loss model is fitted on them by
dual coordinate descent, and its margin is turned into a probability on rows that it was not fitted on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import linear
from corpusloom.llm.arrow_text import column, pieces

#: Passes over the fitting rows, cost of a violated margin, parts for the calibration, and the score from which quality is 1.
EPOCHS = 12
COST = 0.1
FOLDS = 3
THRESHOLD = 0.3


def held_out(key: Column, parts: int = 5) -> Column:
    """True for the rows whose crc32 of the id as text is divisible by ``parts``; a null id is never held out."""
    return F.coalesce(F.crc32(key.cast("string")) % parts == 0, F.lit(False))


def dual_coordinate_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = 7) -> np.ndarray:
    """Weights (features, then bias) of the L1-loss linear SVM on unit-length rows of scaled indicators.

    Each step solves one example's dual variable exactly and updates the weights. The rarer class costs more, in
    proportion."""
    n = len(rows)
    w, bias = np.zeros(len(scale)), 0.0
    norm = np.array([np.sqrt((scale[r] ** 2).sum() + 1e-12) for r in rows])
    share = max(y.mean(), 1e-6), max(1 - y.mean(), 1e-6)
    bound = np.where(y > 0, cost / (2 * share[0]), cost / (2 * share[1]))
    sign = np.where(y > 0, 1.0, -1.0)
    alpha = np.zeros(n)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(n):
            r = rows[i]
            x = scale[r] / norm[i]
            g = sign[i] * (w[r] @ x + bias) - 1
            new = min(max(alpha[i] - g / 2.0, 0.0), bound[i])  # |x|^2 + 1 for the bias is 2
            step = (new - alpha[i]) * sign[i]
            if step:
                w[r] += step * x
                bias += step
                alpha[i] = new
    return np.append(w, bias)


def _margin(rows: list[np.ndarray], scale: np.ndarray, w: np.ndarray) -> np.ndarray:
    flat, bounds = linear.gathered(rows)
    return linear.margins(flat, bounds, w[:-1] * scale) / np.sqrt(linear.margins(flat, bounds, scale**2) + 1e-12) + w[-1]


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve (Newton steps with a small ridge)."""
    x = np.stack([margin, np.ones(len(margin))], 1)
    t = np.array([1.0, np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))])
    for _ in range(50):
        p = linear.sigmoid(x @ t)
        h = x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - y) + 1e-3 * t)
        t -= step
        if abs(step).max() < 1e-9:
            break
    return max(float(t[0]), 1e-3), float(t[1])


def train(docs: DataFrame, labels: DataFrame, most: int = linear.FIT_ROWS) -> tuple[linear.Space, np.ndarray, np.ndarray]:
    """(features, scale, parameters) from the labelled rows that aren't held out. The log-count ratios are counts over
    all of these rows; the hinge-loss model sees at most ``most`` of them."""
    rows = linear.labelled(docs.where(~held_out(F.col("doc_id"))), labels, ["quality"])
    chosen = linear.pick(linear.class_counts(rows, ["quality"]), ["quality"]).sort_values("h", key=lambda s: s.to_numpy().view(np.uint64), ignore_index=True)
    space = linear.Space(chosen["h"].to_numpy(np.int64))
    scale = chosen["r_quality"].to_numpy(float)

    def fit(items: list[np.ndarray], marks: pd.DataFrame) -> pd.DataFrame:
        y = marks["quality"].to_numpy(float)
        fold = np.arange(len(y)) % FOLDS
        margin = np.zeros(len(y))
        for k in range(FOLDS):
            part = [items[i] for i in np.flatnonzero(fold != k)]
            margin[fold == k] = _margin([items[i] for i in np.flatnonzero(fold == k)], scale, dual_coordinate_descent(part, scale, y[fold != k]))
        w = dual_coordinate_descent(items, scale, y)
        return pd.DataFrame({"at": np.arange(len(w) + 2), "w": np.append(w, calibrate(margin, y))})

    if not len(chosen):
        return space, scale, np.array([0.0, 1.0, 0.0])
    fitted = linear.fit_in_task(rows, ["quality"], space, fit, "at long, w double", most)
    return space, scale, fitted.sort_values("at")["w"].to_numpy()


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = linear.FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    score (0 to 1) is the probability of quality 1 from the text alone; a null or blank text gets the model's score
    of a text without features. Without any labelled row every score is 0.5. Repeated rows stay repeated; other
    columns are not read.
    """
    space, scale, fitted = train(docs, labels, most)
    w, slope, offset = fitted[:-2], fitted[-2], fitted[-1]
    shared = docs.sparkSession.sparkContext.broadcast((space, scale, w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, scale, w = shared.value
        for batch in batches:
            for a, b, offsets, data in pieces(column(batch, "text")):
                row, at = space.rows(data, offsets)
                n = b - a
                own = np.bincount(row, w[:-1][at] * scale[at], n)
                margin = own / np.sqrt(np.bincount(row, scale[at] ** 2, n) + 1e-12) + w[-1]
                p = linear.sigmoid(slope * margin + offset)
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id").slice(a, n), pa.array(p)], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id"), F.col("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
