"""Toxicity by a classifier chain.

Categories are predicted one after the other: a later linear model sees the probabilities of all earlier categories
besides the n-gram indicators. It is trained with out-of-fold probabilities, so that it meets in training what it
meets in use.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import linear
from corpusloom.llm.arrow_text import column, pieces

#: Chain over the marks of the label table, in this order; the last one decides.
CATEGORIES = ("low_quality", "toxic")
THRESHOLD = 0.5
FOLDS = 4
STEPS = 60
RIDGE = 1e-3
FEATURES, LEAST_DOCUMENTS = 2_000, 8


def logistic(flat: np.ndarray, bounds: np.ndarray, earlier: np.ndarray, y: np.ndarray, n_features: int) -> np.ndarray:
    """Weights of a ridge logistic model on indicators and the earlier categories' log-odds; the bias is the last.
    Full-batch steps with per-weight step sizes; the classes weigh alike up to a factor of four."""
    row = np.repeat(np.arange(len(y)), np.diff(bounds))
    k = earlier.shape[1]
    w = np.zeros(n_features + k + 1)
    rate = max(y.mean(), 1e-6)
    weight = np.where(y > 0, min(4.0, (1 - rate) / rate), 1.0)
    weight /= weight.sum()
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, STEPS + 1):
        z = np.bincount(row, w[flat], len(y)) + earlier @ w[n_features : n_features + k] + w[-1]
        e = (linear.sigmoid(z) - y) * weight
        g = np.concatenate([np.bincount(flat, e[row], n_features), earlier.T @ e, [e.sum()]]) + RIDGE * np.append(w[:-1], 0)
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        w -= 0.25 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w


def _odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p)) / 4


def _apply(flat: np.ndarray, bounds: np.ndarray, earlier: np.ndarray, w: np.ndarray) -> np.ndarray:
    n = len(w) - 1 - earlier.shape[1]
    return linear.sigmoid(linear.margins(flat, bounds, w[:n]) + earlier @ w[n:-1] + w[-1])


def fit_chain(items: list[np.ndarray], marks: pd.DataFrame, n_features: int) -> list[np.ndarray]:
    """One weight vector a category, each fitted with out-of-fold probabilities of the categories before it."""
    flat, bounds = linear.gathered(items)
    fold = np.arange(len(items)) % FOLDS
    earlier, out = np.zeros((len(items), 0)), []
    for c in marks.columns:
        y = marks[c].to_numpy(float)
        outside = np.zeros(len(y))
        for k in range(FOLDS):
            inn, off = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            w = logistic(*linear.gathered([items[i] for i in inn]), earlier[inn], y[inn], n_features)
            outside[off] = _apply(*linear.gathered([items[i] for i in off]), earlier[off], w)
        out.append(logistic(flat, bounds, earlier, y, n_features))
        earlier = np.column_stack([earlier, _odds(outside)])
    return out


class Chain:
    """A fitted chain: features and one weight vector a category."""

    def __init__(self, space: linear.Space, weights: list[np.ndarray]):
        self.space, self.weights = space, weights

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(rows, categories)."""
        n = len(offsets) - 1
        row, at = self.space.rows(data, offsets)
        bounds = np.searchsorted(row, np.arange(n + 1))
        earlier, out = np.zeros((n, 0)), []
        for w in self.weights:
            p = np.where(np.diff(bounds) > 0, _apply(at, bounds, earlier, w), 0.0)
            out.append(p)
            earlier = np.column_stack([earlier, _odds(p)])
        return np.column_stack(out)


def train(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES, most: int = linear.FIT_ROWS) -> Chain:
    """Class counts come from all labelled rows; the linear models are fitted on at most ``most`` of them. Without
    labelled rows there are no features, so every probability is 0."""
    marks = list(categories)
    if "low_quality" in marks and "low_quality" not in labels.columns:
        labels = labels.withColumn("low_quality", 1 - F.col("quality"))
    rows = linear.labelled(docs, labels, marks)
    chosen = linear.pick(linear.class_counts(rows, marks), marks, FEATURES, LEAST_DOCUMENTS)
    space = linear.Space(chosen["h"].to_numpy(np.int64))
    n = len(space.h)
    if not n:
        return Chain(space, [np.zeros(i + 1) for i in range(len(marks))])

    def fit(items: list[np.ndarray], frame: pd.DataFrame) -> pd.DataFrame:
        weights = fit_chain(items, frame, n)
        return pd.DataFrame({"category": np.repeat(np.arange(len(weights)), [len(w) for w in weights]), "at": np.concatenate([np.arange(len(w)) for w in weights]), "w": np.concatenate(weights)})

    fitted = linear.fit_in_task(rows, marks, space, fit, "category long, at long, w double", most).sort_values(["category", "at"])
    return Chain(space, [fitted["w"][fitted["category"] == i].to_numpy() for i in range(len(marks))])


def score(docs: DataFrame, chain: Chain, categories: tuple[str, ...] = CATEGORIES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, p_<category>..., is_toxic) for every row of ``docs``; is_toxic by the last category's probability.

    A text without any known feature (a null or blank one too) has probability 0 in all categories. Repeated rows stay repeated;
    other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, offsets, data in pieces(column(batch, "text")):
                p = shared.value.probabilities(data, offsets)
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id").slice(a, b - a), *(pa.array(p[:, i]) for i in range(len(names)))], names=["doc_id", *names])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} double" for n in names))
    return out.withColumn("is_toxic", F.col(names[-1]) >= threshold)


def drop_toxic(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that the chain finds toxic; all columns and other rows stay."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    @F.arrow_udf("boolean")
    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in texts:
            found = [shared.value.probabilities(data, offsets)[:, -1] < threshold for _, _, offsets, data in pieces(values)]
            yield pa.array(np.concatenate(found) if found else np.zeros(0, bool))

    return docs.where(clean(F.col("text")))
