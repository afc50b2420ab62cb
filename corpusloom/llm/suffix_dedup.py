"""Exact substring deduplication with suffix arrays built by induced sorting.

Every L-byte string is owned by the shard of its anchor: the least hash among its K-byte substrings, so equal strings
meet in one shard wherever they are. An anchor that occurs in one document only is dropped first. A shard gets the
bytes around the remaining anchors, equal ones once with the least doc_id, and sorts all their suffixes:

* suffixes are classified as larger or smaller than their successor, and leftmost-smaller positions are found;
* leftmost-smaller substrings are sorted by induction and named, and the string of names is sorted recursively;
* the shard's array is induced from them: every suffix is placed once, after its successor. Placement runs bucket by
  bucket, all suffixes that a filled stretch of a bucket induces at a time;
* common prefixes of neighbours are computed in text order (permuted), capped at L.

Neighbours with L bytes in common form classes; a class's least doc_id is where its string starts first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrow_text import U64, column, mix, pieces, powers, prefix_sums, span_hash
from corpusloom.llm.exchange import chunk_name, narrow, pack, shards, unpack, widen
from corpusloom.llm.shared import written

LENGTH, ANCHOR = 50, 24
#: Bytes of text for which there is one shard, and in a chunk.
SHARD_BYTES, CHUNK_BYTES = 6 << 20, 3 << 20
#: Positions for each kind of symbol below which suffixes are placed one by one, above by stretches of a bucket.
FEW = 40
#: Bytes between the spans around an anchor by which contexts are told to be alike.
STEP = 4
_KEY = U64((1 << 48) - 1)
_SEGMENT = 128 << 10


# ------------------------------------------------------------------------------------------------ suffix arrays


def _next_different(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than its successor. The last symbol must be the least and unique."""
    n = len(t)
    rise = np.zeros(n, np.int8)
    rise[:-1] = np.sign(t[1:].astype(np.int64) - t[:-1].astype(np.int64))
    rise[-1] = 1
    at = np.where(rise != 0, np.arange(n), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return rise[at] > 0


def _place(sa: np.ndarray, pointer: np.ndarray, items: np.ndarray, symbols: np.ndarray, forward: bool) -> None:
    """Appends items to their symbols' buckets, in order: upwards from ``pointer`` or downwards."""
    if not len(items):
        return
    order = np.argsort(symbols, kind="stable")
    items, symbols = items[order], symbols[order]
    starts = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
    sizes = np.diff(np.append(starts, len(symbols)))
    rank = np.arange(len(symbols)) - np.repeat(starts, sizes)
    if forward:
        sa[pointer[symbols] + rank] = items
        pointer[symbols[starts]] += sizes
    else:
        sa[pointer[symbols] - 1 - rank] = items
        pointer[symbols[starts]] -= sizes


def _induce(t: np.ndarray, smaller: np.ndarray, lms: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All suffixes from the leftmost-smaller ones in the given order."""
    if np.count_nonzero(end > begin) * FEW > len(t):
        return _induce_singly(t, smaller, lms, begin, end)
    sa = np.full(len(t), -1, np.int64)
    tail = end.copy()
    _place(sa, tail, lms[::-1], t[lms[::-1]], False)
    head = begin.copy()

    def before(block: np.ndarray, small: bool) -> np.ndarray:
        p = block[block > 0] - 1
        return p[smaller[p] == small]

    symbols = np.flatnonzero(end > begin)
    for c in symbols:
        lo = begin[c]
        while lo < head[c]:
            block, lo = sa[lo : head[c]], head[c]
            p = before(block, False)
            _place(sa, head, p, t[p], True)
        p = before(sa[tail[c] : end[c]], False)
        _place(sa, head, p, t[p], True)
    tail = end.copy()
    for c in symbols[::-1]:
        hi = end[c]
        while hi > tail[c]:
            block, hi = sa[tail[c] : hi][::-1], tail[c]
            p = before(block, True)
            _place(sa, tail, p, t[p], False)
        p = before(sa[begin[c] : head[c]][::-1], True)
        _place(sa, tail, p, t[p], False)
    sa[0] = len(t) - 1
    return sa


def _induce_singly(t: np.ndarray, smaller: np.ndarray, lms: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """``_induce`` for large alphabets, whose buckets hold few suffixes each."""
    n, tail, head = len(t), end.tolist(), begin.tolist()
    # the symbol before each position if its suffix is placed in this direction, else -1; free places hold 0, which has none before it
    larger, lesser, before = np.full(n, -1, np.int64), np.full(n, -1, np.int64), t[:-1].astype(np.int64)
    larger[1:], lesser[1:] = np.where(smaller[:-1], -1, before), np.where(smaller[:-1], before, -1)
    sa, symbol = np.zeros(n, np.int64), larger.tolist()
    _place(sa, end.copy(), lms[::-1], t[lms[::-1]], False)
    sa = sa.tolist()
    for p in sa:  # grows ahead of the loop
        c = symbol[p]
        if c >= 0:
            sa[head[c]] = p - 1
            head[c] += 1
    symbol = lesser.tolist()
    for p in reversed(sa):
        c = symbol[p]
        if c >= 0:
            tail[c] -= 1
            sa[tail[c]] = p - 1
    sa[0] = n - 1
    return np.array(sa, np.int64)


def _same_spans(t: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Whether two spans of symbols are equal: by length and 64-bit polynomial hash."""
    up, down = powers(len(t))
    sums = np.zeros(len(t) + 1, U64)
    np.cumsum(mix(np.arange(int(t.max()) + 1, dtype=U64) + U64(1))[t] * up[: len(t)], out=sums[1:])
    return (a_end - a == b_end - b) & ((sums[a_end] - sums[a]) * down[a] == (sums[b_end] - sums[b]) * down[b])


def suffix_array(t: np.ndarray, size: int) -> np.ndarray:
    """Suffix array of symbols 0..size-1; the last is 0 and occurs nowhere else."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int32)
    if size <= 1 << 16:
        t = t.astype(np.uint16, copy=False)  # numpy sorts 16-bit symbols by counting
    smaller = _next_different(t)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    end = np.cumsum(np.bincount(t, minlength=size))
    begin = np.concatenate([[0], end[:-1]])
    rough = _induce(t, smaller, lms, begin, end)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = rough[is_lms[rough]]
    # names: equal neighbours are equal substrings up to and with the next leftmost-smaller position
    stop = np.empty(n, np.int64)
    stop[lms] = np.append(lms[1:], n - 1)
    a, b = ordered[:-1], ordered[1:]
    same = _same_spans(t, a, stop[a] + 1, b, stop[b] + 1)
    rank = np.concatenate([[0], np.cumsum(~same)])
    name = np.empty(n, np.int64)
    name[ordered] = rank
    reduced = name[lms]
    kinds = int(rank[-1]) + 1
    if kinds == len(lms):
        order = np.empty(kinds, np.int64)
        order[reduced] = np.arange(kinds)
    else:
        order = suffix_array(reduced, kinds)
    return _induce(t, smaller, lms[order], begin, end)


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ``size`` bytes from ``a`` and from ``b`` are equal; ``data`` has 8 bytes beyond every span."""
    words, same = np.lib.stride_tricks.sliding_window_view(data, 8), np.ones(len(a), bool)
    at = np.arange(len(a))
    for o in range(0, int(size.max()) if len(size) else 0, 8):
        at = at[same[at] & (size[at] > o)]
        x = np.ascontiguousarray(words[a[at] + o]).view("<u8").ravel() ^ np.ascontiguousarray(words[b[at] + o]).view("<u8").ravel()
        beyond = np.maximum(0, 8 - (size[at] - o)).astype(U64) * U64(8)
        same[at] = (x << beyond) == 0
    return same


def permuted_prefixes(text: np.ndarray, sa: np.ndarray, limit: int = LENGTH) -> np.ndarray:
    """For each text position, the common prefix of its suffix with the one before it in ``sa``, capped at ``limit``; in
    text order. Positions that aren't in ``sa`` get 0. ``text`` has at least ``limit`` + 8 bytes beyond every position."""
    phi = np.full(len(text), -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    at = np.flatnonzero(phi >= 0)
    words = np.lib.stride_tricks.sliding_window_view(text, 8)
    out = np.zeros(len(text), np.int64)
    for o in range(0, limit, 8):
        x = np.ascontiguousarray(words[at + o]).view(">u8").ravel() ^ np.ascontiguousarray(words[phi[at] + o]).view(">u8").ravel()
        x = x.astype(U64)
        out[at] += np.where(x == 0, 8, (64 - np.ceil(np.log2(np.maximum(x, U64(1)).astype(float) + 1))).astype(np.int64) // 8)
        at = at[x == 0]
    return np.minimum(out, limit)


# ------------------------------------------------------------------------------------------------------- chunks


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes): of every L-byte string inside one row, its leftmost least K-byte substring."""
    window, found, hashes = LENGTH - ANCHOR + 1, [], []
    room = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data)) >= LENGTH
    for s in range(0, max(len(data) - LENGTH + 1, 0), _SEGMENT):
        part = data[s : s + _SEGMENT + LENGTH - 1]
        sums = prefix_sums(part).view(np.ndarray)
        h = mix((sums[ANCHOR:] - sums[:-ANCHOR]) * powers(len(part))[1][: len(part) - ANCHOR + 1])
        m = (h & ~U64((1 << 22) - 1)) | np.arange(len(h), dtype=U64)
        for step in (1, 2, 4, 8):
            m = np.minimum(m[:-step], m[step:])
        m = np.minimum(m[: len(m) - (window - 16)], m[window - 16 :])
        inside = room[s : s + len(m)]
        mark = np.zeros(len(part), bool)
        mark[(m[inside] & U64((1 << 22) - 1)).astype(np.int64)] = True
        at = np.flatnonzero(mark)
        found.append(at + s)
        hashes.append(h[at])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    at, h = np.concatenate(found), np.concatenate(hashes) & _KEY
    at, first = np.unique(at, return_index=True)
    return at, h[first]


def shard_of(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """Shards as equal ranges of 48-bit keys, so sorted keys are sorted by shard."""
    return ((keys >> U64(16)) * U64(n_shards) >> U64(32)).astype(np.int64)


class Chunk:
    """Anchors and contexts of one chunk of documents."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, n_shards: int):
        self.ids, self.data, self.offsets, self.n_shards = ids, data, offsets, n_shards
        at, h = anchors(data, offsets)
        row = np.searchsorted(offsets, at, "right") - 1
        order = np.argsort(h)
        self.at, self.row, h = at[order], row[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        self.starts = np.flatnonzero(new)
        self.of = np.cumsum(new) - 1
        self.keys = h[new]
        self.bounds = np.searchsorted(shard_of(self.keys, n_shards), np.arange(n_shards + 1))

    def questions(self) -> Iterator[tuple[int, bytes]]:
        """For each shard that has some, anchor hashes and whether two documents of the chunk have them."""
        doc = self.ids[self.row]
        several = np.minimum.reduceat(doc, self.starts) != np.maximum.reduceat(doc, self.starts) if len(doc) else np.zeros(0, bool)
        for s in np.flatnonzero(np.diff(self.bounds)).tolist():
            a, b = self.bounds[s], self.bounds[s + 1]
            yield s, pack(narrow(self.keys[a:b], 6), np.packbits(several[a:b]))

    def contexts(self, common: np.ndarray) -> None:
        """Keeps the anchors that several documents share, as distinct contexts by shard: all L-byte strings that an
        anchor can own lie in its context."""
        if len(common) != len(self.keys):
            raise ValueError("the passes over the documents were cut differently")
        at, row, key = self.at[common[self.of]], self.row[common[self.of]], self.keys[self.of[common[self.of]]]
        lo = np.maximum(at - (LENGTH - ANCHOR), self.offsets[row])
        hi = np.minimum(at + LENGTH, self.offsets[row + 1])
        h = span_hash(prefix_sums(self.data), lo, hi)
        shard = shard_of(key, self.n_shards)
        doc = self.ids[row]
        h = (shard.astype(U64) << U64(44)) | (h >> U64(20))
        order = np.lexsort((doc, h))
        self.lo, self.size, self.doc, h, shard = lo[order], (hi - lo)[order], doc[order], h[order], shard[order]
        self.off = at[order] - self.lo
        new = np.ones(len(order), bool)
        new[1:] = (h[1:] != h[:-1]) | (self.size[1:] != self.size[:-1])
        equal = np.flatnonzero(~new)
        new[equal] = ~same_bytes(np.append(self.data, np.zeros(8, np.uint8)), self.lo[equal - 1], self.lo[equal], self.size[equal])
        self.first, self.which = np.flatnonzero(new), np.cumsum(new) - 1
        self.shares = np.searchsorted(shard[self.first], np.arange(self.n_shards + 1)) if len(order) else np.zeros(self.n_shards + 1, np.int64)

    def message(self, s: int) -> bytes:
        """Distinct contexts of shard ``s``: lengths, bytes, least doc_id, where the anchor is."""
        f = self.first[self.shares[s] : self.shares[s + 1]]
        size = self.size[f]
        at = np.repeat(self.lo[f], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        return pack(size.astype(np.uint8), self.data[at], self.doc[f], self.off[f].astype(np.uint8))

    def results(self, earlier: np.ndarray) -> Iterator[tuple]:
        """Rows from ``earlier``: for each distinct context, bits of the L-byte strings that start in a document before
        the chunk's least one with that context."""
        if len(earlier) != len(self.first):
            raise ValueError("the passes over the documents were cut differently")
        bits = np.unpackbits(earlier.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, ::-1].view(bool) if len(earlier) else np.zeros((0, 32), bool)
        hit = bits[self.which] if len(self.which) else bits
        later = self.doc > self.doc[self.first][self.which] if len(self.which) else np.zeros(0, bool)
        window = np.arange(32)
        hit = (hit | later[:, None]) & (window < (self.size - LENGTH + 1)[:, None])
        cover = np.zeros(len(self.data) + 1, np.int32)
        begin = (self.lo[:, None] + window)[hit]
        mark = np.zeros(len(self.data) + 1, bool)
        mark[begin] = True
        begin = np.flatnonzero(mark)
        np.add.at(cover, begin, 1)
        np.add.at(cover, begin + LENGTH, -1)
        gone = np.cumsum(cover[:-1]) > 0
        for i in range(len(self.ids)):
            a, b = self.offsets[i], self.offsets[i + 1]
            g = gone[a:b]
            runs = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
            yield int(self.ids[i]), int(b - a), int(g.sum()), runs, self.data[a:b][~g]


# ------------------------------------------------------------------------------------------------------- shards


def _common(table: pa.Table) -> pa.Table:
    """First question: which anchors do several documents have?"""
    names, blob = table.column("chunk").to_numpy(), table.column("blob").to_pylist()
    asked = [unpack(b) for b in blob]
    keys = [widen(k) for k, _ in asked]
    every = np.concatenate(keys)
    several = np.concatenate([np.unpackbits(s, count=len(k)).view(bool) for k, (_, s) in zip(keys, asked, strict=True)])
    distinct, at, count = np.unique(every, return_inverse=True, return_counts=True)
    many = count > 1
    many[at[several]] = True
    out, done = [], 0
    for k in keys:
        out.append(pack(np.packbits(many[at[done : done + len(k)]]), np.array([len(k)])))
        done += len(k)
    del distinct
    return pa.table({"chunk": names, "shard": table.column("key"), "blob": pa.array(out, pa.binary())})


def _distinct(data: np.ndarray, bounds: np.ndarray, size: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of each, which of these each is) of the spans between ``bounds``; equal hashes are told apart by the bytes."""
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    at = bounds[:-1]
    if ((size == size[first][which]) & same_bytes(data, at, at[first][which], size)).all():
        return first, which
    seen: dict[bytes, int] = {}
    which = np.array([seen.setdefault(data[a:b].tobytes(), len(seen)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
    return np.unique(which, return_index=True)[1], which


def _alike(sums: np.ndarray, lo: np.ndarray, at: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which contexts (start, anchor, end) may have an L-byte string of another one: it reaches from the anchor over some multiple
    of ``STEP`` bytes before it and the rest, but for less than ``STEP`` bytes, behind it, and both contexts have that span."""
    alike, reach = np.zeros(len(at), bool), LENGTH - ANCHOR
    for left in range(0, reach + 1, STEP):
        a, b = at - left, at + ANCHOR + max(0, reach - STEP + 1 - left)
        there = np.flatnonzero((a >= lo) & (b <= hi))
        _, which, times = np.unique(span_hash(sums, a[there], b[there]), return_inverse=True, return_counts=True)
        alike[there[times[which] > 1]] = True
    return alike


def _classes(data: np.ndarray, at: np.ndarray, own: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each context (position, length, least doc_id) and each of its L-byte strings the least doc_id of the string's
    class, by the suffix array of all contexts."""
    # text: contexts (bytes + 2) each followed by 1, then 0
    start = np.cumsum(own + 1) - (own + 1)
    text = np.ones(int((own + 1).sum()) + 1, np.uint16)
    text[-1] = 0
    inner = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
    place, source = np.repeat(start, own) + inner, np.repeat(at, own) + inner
    del inner
    raw = np.zeros(len(text) + LENGTH + 8, np.uint8)
    raw[place] = data[source]
    text[place] = data[source].astype(np.uint16) + 2
    del place, source
    sa = suffix_array(text, 258)
    del text
    context = np.repeat(np.arange(len(own)), own + 1)
    room = np.append((start + own)[context] - np.arange(len(context)) >= LENGTH, False)
    sa = sa[room[sa]]
    lcp = permuted_prefixes(raw, sa)
    starts = np.flatnonzero(lcp[sa] < LENGTH)
    group = np.minimum.reduceat(least[context[sa]], starts) if len(starts) else least[:0]
    out = np.full((len(own), 32), np.iinfo(np.int64).max)
    out[context[sa], sa - start[context[sa]]] = np.repeat(group, np.diff(np.append(starts, len(sa))))
    return out


def _earlier(table: pa.Table) -> pa.Table:
    """Second question: which L-byte strings of each context start in an earlier document? By the shard's suffix array."""
    names, blob = table.column("chunk").to_numpy(), table.column("blob").to_pylist()
    asked = [unpack(b) for b in blob]
    size = np.concatenate([m[0] for m in asked]).astype(np.int64)
    data, doc = np.concatenate([m[1] for m in asked]), np.concatenate([m[2] for m in asked])
    out = np.zeros(len(size), np.uint32)
    if len(size):
        bounds = np.concatenate([[0], np.cumsum(size)])
        sums = prefix_sums(data)
        first, which = _distinct(np.append(data, np.zeros(8, np.uint8)), bounds, size, span_hash(sums, bounds[:-1], bounds[1:]))
        least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(least, which, doc)
        # only strings of one anchor can be equal: a context that is alone with its anchor meets no other
        at = bounds[:-1][first] + np.concatenate([m[3] for m in asked])[first]
        _, anchor, times = np.unique(span_hash(sums, at, at + ANCHOR), return_inverse=True, return_counts=True)
        several = np.flatnonzero(times[anchor] > 1)
        several = several[_alike(sums, bounds[:-1][first[several]], at[several], bounds[1:][first[several]])]
        del sums
        before = np.repeat(least[:, None], 32, axis=1)
        if len(several):
            before[several] = _classes(data, bounds[:-1][first[several]], size[first[several]], least[several])
        for a in range(0, len(size), 1 << 16):
            b = a + (1 << 16)
            hit = before[which[a:b]] < doc[a:b, None]
            out[a:b] = np.packbits(hit[:, ::-1], axis=1).view(">u4").ravel()
    replies, done = [], 0
    for m in asked:
        replies.append(pack(out[done : done + len(m[0])]))
        done += len(m[0])
    return pa.table({"chunk": names, "shard": table.column("key"), "blob": pa.array(replies, pa.binary())})


# ------------------------------------------------------------------------------------------------------ operator


def _gathered(table: pa.Table, n_shards: int) -> tuple[list[Chunk], np.ndarray, list[bytes]]:
    """A chunk's own text (kind 0), the first answers (1) in shard order, and the second ones (2)."""
    kind, shard, blob = (table.column(c).to_pylist() for c in ("kind", "shard", "blob"))
    own = [unpack(b) for k, b in zip(kind, blob, strict=True) if k == 0]
    first = sorted((s, b) for k, s, b in zip(kind, shard, blob, strict=True) if k == 1)
    second = sorted((s, b) for k, s, b in zip(kind, shard, blob, strict=True) if k == 2)
    if len(own) != 1:
        raise ValueError("the passes over the documents were cut differently")
    common = [np.unpackbits(bits, count=int(n[0])).view(bool) for bits, n in (unpack(b) for _, b in first)]
    chunks = [Chunk(ids, data, offsets, n_shards) for ids, data, offsets in own]
    chunks[0].contexts(np.concatenate(common) if common else np.zeros(0, bool))
    return chunks, common, [b for _, b in second]


def deduplicate(docs: DataFrame, n_shards: int | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary) for every row of ``docs``.

    A byte goes if an L-byte string that covers it also starts in a row with a smaller doc_id. Null and blank
    texts have nothing to remove. Rows with equal doc_id don't remove each other's bytes. A null doc_id counts as
    larger than any other. An empty table gives no rows. Other columns are not read.
    """
    n_shards = n_shards or shards(docs, each=SHARD_BYTES)
    last = np.iinfo(np.int64).max
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(last)).alias("doc_id"), F.col("text").alias("text"), F.spark_partition_id().alias("part"))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        nth = 0
        for batch in batches:
            ids = column(batch, "doc_id").to_numpy()
            for a, b, offsets, data in pieces(column(batch, "text"), chunk_bytes):
                yield chunk_name(column(batch, "part")[0].as_py(), nth, ids[a:b], offsets, data), ids[a:b], data, offsets
                nth += 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, ids, data, offsets in parts(batches):
            chunk = Chunk(ids, data, offsets, n_shards)
            asked = list(chunk.questions())
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in asked], pa.int64()), pa.array(np.full(len(asked), name)), pa.array([b for _, b in asked], pa.binary())], names=["key", "chunk", "blob"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, *own in parts(batches):
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([-1], pa.int64()), pa.array([pack(*own)], pa.binary())], names=["chunk", "shard", "blob"])

    def send(table: pa.Table) -> pa.Table:
        (chunk,), _, _ = _gathered(table, n_shards)
        name = table.column("chunk")[0].as_py()
        some = np.flatnonzero(np.diff(chunk.shares))
        return pa.table({"key": pa.array(some), "chunk": pa.array(np.full(len(some), name)), "blob": pa.array([chunk.message(s) for s in some.tolist()], pa.binary())})

    def finish(table: pa.Table) -> pa.Table:
        (chunk,), _, second = _gathered(table, n_shards)
        earlier = [unpack(b)[0] for b in second]
        out = list(chunk.results(np.concatenate([np.zeros(0, np.uint32), *earlier])))
        ids = np.array([r[0] for r in out], np.int64)
        kept = [r[4].tobytes() for r in out]
        return pa.table({"doc_id": pa.array(ids, mask=ids == last), **{n: pa.array([r[i] for r in out], pa.int64()) for i, n in enumerate(("n_bytes", "n_removed", "n_spans"), 1)}, "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), "kept": pa.array(kept, pa.binary())})

    answer, question = "chunk long, shard long, blob binary", "key long, chunk long, blob binary"
    texts = rows.mapInArrow(keep, answer).withColumn("kind", F.lit(0))
    common = written(rows.mapInArrow(ask, question).groupBy("key").applyInArrow(_common, answer), "shared-anchors").withColumn("kind", F.lit(1))
    earlier = texts.unionByName(common).groupBy("chunk").applyInArrow(send, question).groupBy("key").applyInArrow(_earlier, answer).withColumn("kind", F.lit(2))
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return texts.unionByName(common).unionByName(earlier).groupBy("chunk").applyInArrow(finish, out)
