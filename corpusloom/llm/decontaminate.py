"""Benchmark decontamination by spaced seeds.

A seed mask looks at some of the tokens of a window and ignores the others, so a window whose ignored tokens were
replaced still hashes alike. All windows of the benchmark are hashed under all masks; a document's windows are
looked up in these hashes; a hit fixes a diagonal (document position minus benchmark position), and the whole
diagonal is then compared token by token, counting replaced tokens. Items shorter than every mask can't be missed by a
replaced token, since all their tokens must be equal: they are looked up whole.

The benchmark side is taken in blocks of a bounded number of tokens. Each block is one broadcast whose size doesn't
depend on the documents, and one pass over the documents, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrow_text import LOWER, NOT_WORD, U64, column, combine, pieces, prefix_sums, span_hash, words

#: Fixed masks: 1 is compared, 0 ignored.
MASKS = ("11111", "110111", "1101011", "11001011", "101001011", "1100010101")
#: Benchmark tokens in one block; a block's index has about 16 bytes for each token and mask.
BLOCK_TOKENS = 400_000
#: A leak has this many equal tokens (or all of a shorter passage) at this share of its length.
LEAST_TOKENS = 10
LEAST_SHARE = 0.8
#: Items of fewer tokens than the shortest mask.
SHORT = range(1, min(map(len, MASKS)))
_BITS = 22
_WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the lower-cased runs of letters and digits."""
    data = LOWER[data]
    starts, ends, row = words(data, offsets, NOT_WORD)
    return span_hash(prefix_sums(data), starts, ends), row


def seeds(tokens: np.ndarray, owner: np.ndarray, mask: str, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(window start, hash) of all windows under ``mask`` that lie within one text."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    out = combine(np.full(n, salt + 1, U64), *(tokens[i : i + n] for i, c in enumerate(mask) if c == "1"))
    start = np.flatnonzero(owner[:n] == owner[len(mask) - 1 :])
    return start, out[start]


class Index:
    """Spaced-seed index of one block of benchmark texts."""

    def __init__(self, ids: list[int | None], texts: list[str]):
        values = pa.array(texts, pa.string())
        parts = [(token_hashes(data, offsets), a) for a, _, offsets, data in pieces(values)]
        self.ids = pa.array(ids, pa.int64())
        self.tokens = np.concatenate([h for (h, _), _ in parts]) if parts else np.zeros(0, U64)
        self.owner = np.concatenate([r + a for (_, r), a in parts]) if parts else np.zeros(0, np.int64)
        self.bounds = np.searchsorted(self.owner, np.arange(len(ids) + 1))
        found = [seeds(self.tokens, self.owner, m, k) for k, m in enumerate(MASKS)]
        at, key = np.concatenate([s for s, _ in found]), np.concatenate([h for _, h in found])
        order = np.lexsort((at, key))
        self.key, self.at = key[order], at[order]
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(self.key >> U64(64 - _BITS)).astype(np.int64)] = True
        self.short = {}
        for n in SHORT:
            items = np.flatnonzero(np.diff(self.bounds) == n)
            if len(items):
                first = self.bounds[items]
                key = combine(np.full(len(items), len(MASKS) + n, U64), *(self.tokens[first + i] for i in range(n)))
                order = np.argsort(key, kind="stable")
                self.short[n] = key[order], items[order]

    def whole(self, tokens: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(token position, item) of the first place in each row of every item of ``n`` tokens, ``n`` in SHORT."""
        key, items = self.short[n]
        start, seen = seeds(tokens, row, "1" * n, len(MASKS) + n - 1)
        lo, hi = np.searchsorted(key, seen, "left"), np.searchsorted(key, seen, "right")
        size = hi - lo
        hit = np.repeat(np.arange(len(seen)), size)
        item = items[lo[hit] + np.arange(len(hit)) - np.repeat(np.cumsum(size) - size, size)]
        at = start[hit]
        same = np.ones(len(at), bool)
        for i in range(n):
            same &= tokens[at + i] == self.tokens[self.bounds[item] + i]
        at, item = at[same], item[same]
        _, one = np.unique(row[at] * len(self.ids) + item, return_index=True)
        return at[one], item[one]

    def leaks(self, tokens: np.ndarray, row: np.ndarray, n_rows: int) -> list[tuple[int, int, int, int, int]]:
        """(row, item, first token, length, equal tokens): the best verified overlap of each row and item."""
        lookup: list[np.ndarray] = []
        for k, mask in enumerate(MASKS):
            start, key = seeds(tokens, row, mask, k)
            near = np.flatnonzero(self.seen[(key >> U64(64 - _BITS)).astype(np.int64)])
            start, key = start[near], key[near]
            lo, hi = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
            size = hi - lo
            hit = np.repeat(np.arange(len(key)), size)
            if len(hit):
                pos = self.at[lo[hit] + np.arange(len(hit)) - np.repeat(np.cumsum(size) - size, size)]
                lookup.append(np.stack([row[start[hit]], self.owner[pos], start[hit] - pos], axis=1))
        bounds = np.searchsorted(row, np.arange(n_rows + 1))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for n in self.short:
            at, item = self.whole(tokens, row, n)
            best |= {(r, i): (n, b - a, n) for r, i, a, b in zip(row[at].tolist(), item.tolist(), at.tolist(), bounds[row[at]].tolist(), strict=True)}
        for r, item, diagonal in np.unique(np.concatenate(lookup), axis=0).tolist() if lookup else ():
            a, b = self.bounds[item], self.bounds[item + 1]
            lo, hi = max(a, bounds[r] - diagonal), min(b, bounds[r + 1] - diagonal)
            same = tokens[lo + diagonal : hi + diagonal] == self.tokens[lo:hi]
            first, last, equal = best_segment(same)
            length = last - first
            if equal >= min(LEAST_TOKENS, b - a) and equal >= LEAST_SHARE * length:
                found = (equal, -(lo + diagonal + first - bounds[r]), length)
                best[r, item] = max(best.get((r, item), found), found)
        return [(r, item, -start, length, equal) for (r, item), (equal, start, length) in best.items()]


def best_segment(same: np.ndarray) -> tuple[int, int, int]:
    """(first, end, equal) of the segment with most equal tokens among all whose equal share is 0.8 or more.

    Scores are 1 for an equal token and -4 for a replaced one, so a segment has the share if its sum isn't negative.
    The longest such segment from each new minimum of the prefix sums holds all others. Ends are equal tokens.
    """
    sums = np.concatenate([[0], np.cumsum(np.where(same, 1, -4))])
    low = np.minimum.accumulate(sums)
    starts = np.flatnonzero(np.concatenate([[True], low[1:] < low[:-1]]))
    # the greatest sum from here on falls, so the last place that reaches a start's sum is found by bisection
    high = np.maximum.accumulate(sums[::-1])
    ends = len(sums) - 1 - np.searchsorted(high, sums[starts], "left")
    count = np.concatenate([[0], np.cumsum(same)])
    k = int(np.argmax(count[ends] - count[starts]))
    at = np.flatnonzero(same[starts[k] : ends[k]]) + starts[k]
    return (int(at[0]), int(at[-1]) + 1, len(at)) if len(at) else (0, 0, 0)


def blocks(benchmark: DataFrame, most: int = BLOCK_TOKENS, key: str = "item_id", text: str = "text") -> Iterator[Index]:
    """The benchmark, block by block: at most ``most`` tokens (or one text) are held at a time."""
    ids: list[int | None] = []
    texts: list[str] = []
    size = 0
    for r in benchmark.select(F.col(key).cast("long"), F.col(text)).where(F.col(text).isNotNull()).distinct().sort(key).toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        size += sum(1 for _ in _WORD.finditer(r[1]))
        if size >= most:
            yield Index(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Index(ids, texts)


def find_leaks(docs: DataFrame, benchmark: DataFrame, most: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, item_id, token_start, n_tokens, n_equal): documents that hold a benchmark passage.

    One row for each document row and item, with its best overlap: at least LEAST_TOKENS equal tokens (all of them
    for a shorter item) at a share of LEAST_SHARE or more. Words are lower-cased runs of letters and digits. Null and
    blank texts leak nothing, nor do items without a word; an item of fewer than five words is found where all its words
    follow each other. An item without an id is looked for, its item_id is null. Repeated document rows repeat their
    result. Other columns are not read.
    """
    found = None
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    schema = "doc_id long, item_id long, token_start long, n_tokens long, n_equal long"
    for index in blocks(benchmark, most):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                keys = column(batch, "doc_id")
                out = []
                for a, b, offsets, data in pieces(column(batch, "text")):
                    tokens, row = token_hashes(data, offsets)
                    out += [(a + r, *rest) for r, *rest in index.leaks(tokens, row, b - a)]
                doc, item, *cols = (pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 5))
                yield pa.RecordBatch.from_arrays([keys.take(doc), index.ids.take(item), *cols], names=["doc_id", "item_id", "token_start", "n_tokens", "n_equal"])

        part = rows.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], schema)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, most: int = BLOCK_TOKENS) -> DataFrame:
    """``docs`` without the rows that hold a benchmark passage (as in ``find_leaks``); columns and other rows stay."""
    out = docs
    for index in blocks(benchmark, most):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        out = out.where(_without(shared)(F.col("text")))
    return out


def _without(shared: Broadcast):
    """A column function: whether a text holds no passage of the shared index."""

    @F.arrow_udf("boolean")
    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in texts:
            free = np.ones(len(values), bool)
            for a, b, offsets, data in pieces(values):
                tokens, row = token_hashes(data, offsets)
                free[[a + leak[0] for leak in shared.value.leaks(tokens, row, b - a)]] = False
            yield pa.array(free)

    return clean
