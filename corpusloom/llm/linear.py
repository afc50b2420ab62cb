"""N-gram indicators and linear models over documents, shared by the quality and the toxicity classifier.

Texts become 64-bit hashes of word n-grams and of *shape* n-grams (the sequence of letter case, digit and
punctuation classes), computed over whole texts from the bytes. Class counts of all labelled texts are a Spark
aggregation; it picks a bounded set of features. A model is fitted on a bounded sample of labelled rows in one
task, and scoring is one pass over the documents without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrow_text import LOWER, NOT_WORD, U64, column, combine, pieces, prefix_sums, span_hash, words
from corpusloom.llm.shared import written

#: Features of a model at most, and the labelled documents that a feature must occur in at least.
FEATURES = 60_000
LEAST_DOCUMENTS = 4
#: Labelled rows that a model is fitted on at most (those with the smallest hash of doc_id).
FIT_ROWS = 8_000
#: Rows of a label table up to which it is broadcast (16 bytes each); a larger one is joined by shuffling.
BROADCAST_ROWS = 2_000_000
#: Feature counts that a task holds before it sums and sends them.
MERGED = 1 << 19

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58], _SHAPE[128:] = ord("A"), ord("a"), ord("9"), ord("a")


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of all n-gram occurrences: words, word pairs, word shapes and shape triples."""
    starts, ends, row = words(LOWER[data], offsets, NOT_WORD)
    word = span_hash(prefix_sums(LOWER[data]), starts, ends)
    pair = combine(word[:-1], word[1:]) if len(word) > 1 else word[:0]
    inside = row[:-1] == row[1:]
    # shapes: runs of one class count once; white space separates
    shape = _SHAPE[data]
    starts2, ends2, row2 = words(data, offsets)
    change = np.ones(len(data), bool)
    change[1:] = shape[1:] != shape[:-1]
    change[starts2] = True
    kept = np.concatenate([[0], np.cumsum(change)])
    form = span_hash(prefix_sums(shape[change]), kept[starts2], kept[ends2]) ^ U64(0x5EED)
    triple = combine(form[:-2], form[1:-1], form[2:]) if len(form) > 2 else form[:0]
    inside2 = row2[:-2] == row2[2:]
    return np.concatenate([word, pair[inside], form, triple[inside2]]), np.concatenate([row, row[:-1][inside], row2, row2[:-2][inside2]])


def labelled(docs: DataFrame, labels: DataFrame, columns: list[str]) -> DataFrame:
    """(doc_id, text, *columns) of the documents that have all of these labels as 0 or 1, whatever else they hold.

    A document with several rows of labels takes the largest of each."""
    ok = [F.col(c).isin(0, 1) for c in columns]
    known = labels.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("int").alias(c) for c in columns]).groupBy("doc_id").agg(*[F.max(c).alias(c) for c in columns])
    for x in ok:
        known = known.where(x)
    if labels.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(known, "doc_id")


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One (keys, sums) of several, equal keys added up."""
    key, sums = np.concatenate([k for k, _ in held]), np.concatenate([s for _, s in held], axis=1)
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[starts], np.add.reduceat(sums[:, order], starts, axis=1)


def class_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(h, n, n_<column>...): documents that hold each feature, all and those labelled 1, plus one row with h = 0 that
    counts the documents themselves. Counts of a few megabytes of text are summed before they are shuffled."""
    schema = "h long, n long, " + ", ".join(f"n_{c} long" for c in columns)
    names = ["h", "n", *(f"n_{c}" for c in columns)]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            marks = [column(batch, c).to_numpy() for c in columns]
            for a, b, offsets, data in pieces(column(batch, "text")):
                h, row = features(data, offsets)
                order = np.lexsort((row, h))
                h, row = h[order], row[order]
                first = np.ones(len(h), bool)
                first[1:] = h[1:] != h[:-1]
                new = first.copy()
                new[1:] |= row[1:] != row[:-1]
                at = np.cumsum(first)[new] - 1
                key, row = h[first], row[new]
                sums = [np.bincount(at, minlength=len(key)), *(np.bincount(at, weights=m[a:b][row], minlength=len(key)) for m in marks)]
                head = [b - a, *(m[a:b].sum() for m in marks)]
                yield np.concatenate([[0], key.view(np.int64)]), np.stack([np.concatenate([[x], s]) for x, s in zip(head, sums, strict=True)]).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in counted(batches):
            held.append(part)
            size += len(part[0])
            if size >= MERGED:
                key, sums = _merged(held)
                held, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(key), *map(pa.array, sums.astype(np.int64))], names=names)
        if held:
            key, sums = _merged(held)
            yield pa.RecordBatch.from_arrays([pa.array(key), *map(pa.array, sums.astype(np.int64))], names=names)

    summed = rows.select("text", *columns).mapInArrow(run, schema)
    return summed.groupBy("h").agg(F.sum("n").alias("n"), *[F.sum(f"n_{c}").alias(f"n_{c}") for c in columns])


def _cut(counts: list[tuple[int, int]], most: int) -> tuple[int | None, int]:
    """(key, room): of (key, count) pairs in order of preference, the key at which ``most`` are reached and how many of
    its own still fit; None if all fit."""
    for key, n in counts:
        if n >= most:
            return key, most
        most -= n
    return None, most


def pick(counts: DataFrame, columns: list[str], most: int = FEATURES, least: int = LEAST_DOCUMENTS) -> pd.DataFrame:
    """The ``most`` features that tell most about the labels: h, and each column's log-count ratio r_<column>.

    Worth is compared in steps of 1/1024, equal steps by h. Two histograms (of worth, and of h in the step that is
    cut) find the limit, so no more rows than wanted, and one bin, reach the driver.
    """
    counts = written(counts.where((F.col("h") == 0) | (F.col("n") >= least)), "feature-counts")
    total = counts.where("h = 0").first()
    if total is None:
        return pd.DataFrame({"h": np.zeros(0, np.int64), **{f"r_{c}": np.zeros(0) for c in columns}})
    worth, ratios = [], []
    for c in columns:
        p, q = float(total[f"n_{c}"] + 1), float(total["n"] - total[f"n_{c}"] + 1)
        pos, neg = F.col(f"n_{c}") + 1.0, F.col("n") - F.col(f"n_{c}") + 1.0
        ratio = F.log(pos / p) - F.log(neg / q)
        ratios.append(ratio.alias(f"r_{c}"))
        worth.append(F.abs(ratio) * F.sqrt(F.least(pos / p, F.lit(1.0)) + F.least(neg / q, F.lit(1.0))))
    best = F.greatest(*worth) if len(worth) > 1 else worth[0]
    rated = counts.where((F.col("h") != 0) & (F.col("n") >= least)).select("h", *ratios, F.floor(best * 1024).alias("step"), F.shiftrightunsigned("h", 52).alias("bin"))
    step, room = _cut(sorted(((r[0], r[1]) for r in rated.groupBy("step").count().collect()), reverse=True), most)
    if step is not None:
        last, _ = _cut(sorted((r[0], r[1]) for r in rated.where(F.col("step") == step).groupBy("bin").count().collect()), room)
        rated = rated.where((F.col("step") > step) | ((F.col("step") == step) & (F.col("bin") <= last)))
    found = rated.drop("bin").toPandas()
    order = np.lexsort((found["h"].to_numpy(np.int64).view(np.uint64), -found["step"].to_numpy(np.int64)))[:most]
    return found.iloc[order].drop(columns="step").reset_index(drop=True)


class Space:
    """The chosen features, with a bit table in front of the exact look-up."""

    def __init__(self, h: np.ndarray):
        self.h = np.sort(h.view(np.uint64))
        self.bit = np.zeros(1 << 20, bool)
        self.bit[(self.h >> U64(44)).astype(np.int64)] = True

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, feature) of the features each row holds, once each, ordered by row."""
        h, row = features(data, offsets)
        near = self.bit[(h >> U64(44)).astype(np.int64)]
        h, row = h[near], row[near]
        at = np.minimum(np.searchsorted(self.h, h), max(len(self.h) - 1, 0))
        hit = self.h[at] == h if len(self.h) else np.zeros(len(h), bool)
        key = np.unique(row[hit] * max(len(self.h), 1) + at[hit])
        return key // max(len(self.h), 1), key % max(len(self.h), 1)


def fit_in_task(rows: DataFrame, columns: list[str], space: Space, fit: Callable[[list[np.ndarray], pd.DataFrame], pd.DataFrame], schema: str, most: int = FIT_ROWS) -> pd.DataFrame:
    """Runs ``fit(feature index arrays, labels)`` in one task over at most ``most`` labelled rows and returns its small
    table. The sample is fixed: the rows with the smallest hash of doc_id."""
    shared = rows.sparkSession.sparkContext.broadcast(space)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, offsets, data in pieces(column(batch, "text")):
                row, at = shared.value.rows(data, offsets)
                bounds = np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([column(batch, "order").slice(a, b - a), pa.ListArray.from_arrays(pa.array(bounds), pa.array(at.astype(np.int32))), *(column(batch, c).slice(a, b - a) for c in columns)], names=["order", "at", *columns])

    marks = ", ".join(f"{c} int" for c in columns)
    hashed = rows.withColumn("order", F.xxhash64("doc_id"))
    if (n := rows.count()) > most:  # only about as many rows as are wanted go on to the exact cut
        hashed = hashed.where(F.col("order") <= min(2**63 - 1, int(-(2**63) + 2**64 * (1.1 * most / n + 300 / n))))
    indexed = hashed.select("order", "text", *columns).mapInArrow(index, f"order long, at array<int>, {marks}")

    def one(group: pa.Table) -> pa.Table:
        frame = group.to_pandas().sort_values("order", kind="stable")
        return pa.Table.from_pandas(fit(list(frame["at"]), frame[columns]), preserve_index=False)

    return indexed.sort("order").limit(most).withColumn("all", F.lit(0)).groupBy("all").applyInArrow(one, schema).toPandas()


def gathered(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sparse rows as (flat feature indices, bounds)."""
    return (np.concatenate(rows) if rows else np.zeros(0, np.int64)).astype(np.int64), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)


def margins(flat: np.ndarray, bounds: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sum of weights of each sparse row."""
    sums = np.concatenate([[0.0], np.cumsum(w[flat])])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))
