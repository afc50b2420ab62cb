"""Language-model scores from an Elias-Fano n-gram trie.

Counting, the trie and the look-ups are sharded by context. Chunks of documents send each shard the distinct
contexts and successors they hold, with their training counts; the shard adds the counts up, builds its part of the
trie, answers every chunk, and a chunk's answers give its documents' scores.

A shard's trie has two levels for each order: contexts (a monotone sequence of hashes), pointers to each context's
successors (monotone), and the successors, stored relative to their context's position so that the whole level is
one monotone sequence. All three are Elias-Fano coded; probabilities and context weights are quantised to 16 bits. The levels
are files that are memory-mapped while the shard is queried.

p(w | h) = own(h w) + weight(h) p(w | h'), with own = c(h w) / (c(h) + S T(h)) and weight = S T(h) / (c(h) + S T(h)), T(h)
the number of distinct successors and S a strength; p(w) = (c + 0.1) / (N + 0.1 (V + 1)).
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrow_text import LOWER, U64, column, combine, mix, pieces, prefix_sums, span_hash, words
from corpusloom.llm.exchange import CHUNK_BYTES, chunk_name, narrow, pack, shards, unpack, widen

ORDER = 2
STRENGTH = 4.0
#: Bytes of a word's key (its whole 64-bit hash: base counts are exact), of a context's, and of a successor's within it.
WORD_BYTES, KEY_BYTES, NEXT_BYTES = 8, 6, 5
#: Bytes of text for which there is one shard.
SHARD_BYTES = 12 << 20
_KEY, _NEXT = U64((1 << 48) - 1), U64((1 << 40) - 1)
#: Quantisation steps for one decade of probability.
STEPS = 6000
_END, _BEGIN = mix(np.array([0xE0D], U64))[0], mix(np.array([0xB0D], U64))[0]


# ---------------------------------------------------------------------------------------------------- Elias-Fano


class EliasFano:
    """A non-decreasing sequence below ``universe``: low bits packed, high bits as unary gaps."""

    def __init__(self, values: np.ndarray, universe: int):
        n = len(values)
        self.n, self.low_bits = n, max(0, int(universe // max(n, 1)).bit_length() - 1)
        shift = U64(self.low_bits)
        high = (values >> shift).astype(np.int64)
        bits = np.zeros(n + (int(universe - 1) >> self.low_bits) + 2 if n else 1, bool)
        bits[high + np.arange(n)] = True
        self.high = np.packbits(bits)
        self.n_bits = len(bits)
        self.low = self._pack(values & ((U64(1) << shift) - U64(1)))

    def _pack(self, low: np.ndarray) -> np.ndarray:
        b, words_ = self.low_bits, np.zeros((len(low) * self.low_bits + 63) // 64 + 1, U64)
        if not b:
            return words_
        at = np.arange(len(low), dtype=np.int64) * b
        word, off = at >> 6, (at & 63).astype(U64)
        np.bitwise_or.at(words_, word, low << off)
        over = off + U64(b) > 64
        np.bitwise_or.at(words_, word[over] + 1, low[over] >> (U64(64) - off[over]))
        return words_

    def mapped(self, file) -> EliasFano:
        """The same sequence with its bits in ``file``, memory-mapped."""
        for name in ("high", "low"):
            a = getattr(self, name)
            start = file.seek(0, 2)
            file.seek(start + (-start) % 64)
            start = file.tell()
            file.write(a.tobytes() or b"\0")
            file.flush()
            setattr(self, name, np.memmap(file, a.dtype, "r", start, a.shape) if a.size else a)
        return self

    def open(self) -> EliasFano:
        """Prepares look-ups: positions of the unary code's ones and zeros."""
        bits = np.unpackbits(self.high, count=self.n_bits).view(bool)
        self.ones, self.zeros = np.flatnonzero(bits), np.flatnonzero(~bits)
        return self

    def get(self, i: np.ndarray) -> np.ndarray:
        high = (self.ones[i] - i).astype(U64) << U64(self.low_bits)
        b = self.low_bits
        if not b:
            return high
        at = i.astype(np.int64) * b
        word, off = at >> 6, (at & 63).astype(U64)
        raw = self.low[word] >> off
        over = off > 0
        raw = np.where(over, raw | (self.low[word + 1] << ((U64(64) - off) & U64(63))), raw)
        return high | (raw & ((U64(1) << U64(b)) - U64(1)))

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position of the first value >= x, whether it equals x): bisection inside x's bucket of high bits."""
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        h = np.minimum((x >> U64(self.low_bits)).astype(np.int64), len(self.zeros) - 1)
        hi = self.zeros[h] - h
        lo = np.where(h > 0, self.zeros[h - 1] - (h - 1), 0)
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            less = np.zeros(len(x), bool)
            less[open_] = self.get(mid[open_]) < x[open_]
            lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        at = np.minimum(lo, self.n - 1)
        return lo, (lo < self.n) & (self.get(at) == x)


def quantise(p: np.ndarray) -> np.ndarray:
    """Probabilities in (0, 1] as 16-bit steps of their logarithm."""
    return np.clip(np.rint(-np.log10(p) * STEPS), 0, 65534).astype(np.uint16)


def restore(q: np.ndarray) -> np.ndarray:
    """65535 stands for probability 0."""
    return np.where(q == 65535, 0.0, 10.0 ** (-q.astype(float) / STEPS))


class Trie:
    """Contexts and successors of one shard. ``contexts`` sorted and distinct, ``pairs`` (context rank, successor, count)."""

    def __init__(self, contexts: np.ndarray, rank: np.ndarray, successor: np.ndarray, count: np.ndarray, strength: float = STRENGTH):
        n = max(len(contexts), 1)
        total = np.bincount(rank, count, len(contexts))
        kinds = np.bincount(rank, minlength=len(contexts))
        self.file = tempfile.TemporaryFile()  # noqa: SIM115  unlinked; gone with the object
        self.contexts = EliasFano(contexts, 1 << 48).mapped(self.file).open()
        self.pointers = EliasFano(np.concatenate([[0], np.cumsum(kinds)]).astype(U64), len(rank) + 1).mapped(self.file).open()
        self.successors = EliasFano((rank.astype(U64) << U64(40)) | successor, n << 40).mapped(self.file).open()
        self.own = quantise(count / (total + strength * kinds)[rank]) if len(rank) else np.zeros(0, np.uint16)
        self.weight = quantise(strength * kinds / (total + strength * kinds)) if len(contexts) else np.zeros(0, np.uint16)

    def look_up(self, contexts: np.ndarray, sizes: np.ndarray, successors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(own, weight) steps: own for each successor query, weight for each context; unseen ones are 65535 and 0."""
        at, known = self.contexts.find(contexts)
        weight = np.zeros(len(contexts), np.uint16)
        weight[known] = self.weight[at[known]]
        owner, ok = np.repeat(at, sizes), np.repeat(known, sizes)
        own = np.full(len(successors), 65535, np.uint16)
        pos, hit = self.successors.find((owner[ok].astype(U64) << U64(40)) | successors[ok])
        hit &= (pos >= self.pointers.get(owner[ok]).astype(np.int64)) & (pos < self.pointers.get(owner[ok] + 1).astype(np.int64))
        where = np.flatnonzero(ok)[hit]
        own[where] = self.own[pos[hit]]
        return own, weight


# ------------------------------------------------------------------------------------------------------- chunks


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each row's lower-cased words, then one end."""
    data = LOWER[data]
    starts, ends, row = words(data, offsets)
    n = len(offsets) - 1
    h = np.concatenate([span_hash(prefix_sums(data), starts, ends), np.full(n, _END, U64)])
    row = np.concatenate([row, np.arange(n)])
    order = np.argsort(row, kind="stable")
    return h[order], row[order]


class Chunk:
    """The distinct unigrams and context-successor pairs of one chunk, by shard, and its documents in their terms."""

    def __init__(self, place: tuple[int, int], data: np.ndarray, offsets: np.ndarray, train: np.ndarray, n_shards: int, order: int):
        w, row = tokens(data, offsets)
        in_train = train[row]
        first = np.ones(len(row), bool)
        first[1:] = row[1:] != row[:-1]
        key = mix(w)
        self.row, self.n = row, len(offsets) - 1
        self.name = chunk_name(*place, w, offsets)
        shard = (key % U64(n_shards)).astype(np.int64)
        self.unigram, self.of_unigram, self.unigram_count, self.unigram_bounds = self._distinct(shard, key, np.zeros(len(key), U64), in_train, n_shards)
        self.pairs = []
        for k in range(2, order + 1):
            context = np.full(len(w), U64(k), U64)
            back, alive = np.arange(len(w)), np.ones(len(w), bool)
            for _ in range(k - 1):  # a context that would reach before the text is cut short by one begin mark
                begin = first[back] & alive
                prior = np.where(begin, _BEGIN, w[np.maximum(back - 1, 0)])
                context = np.where(alive, combine(context, prior), context)
                alive &= ~begin
                back = np.maximum(back - 1, 0)
            context &= _KEY
            shard = (context % U64(n_shards)).astype(np.int64)
            self.pairs.append(self._distinct(shard, context, mix(w ^ U64(0x77)) & _NEXT, in_train, n_shards))

    @staticmethod
    def _distinct(shard: np.ndarray, major: np.ndarray, minor: np.ndarray, train: np.ndarray, n_shards: int) -> tuple:
        """(sorted (shard, major, minor), index of each occurrence, training count, bounds by shard)."""
        order = np.lexsort((minor, major, shard))
        s, a, b = shard[order], major[order], minor[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        rank = np.cumsum(new) - 1
        of = np.empty(len(order), np.int64)
        of[order] = rank
        count = np.bincount(rank, train[order], int(new.sum())).astype(np.int64)
        return (a[new], b[new]), of, count, np.searchsorted(s[new], np.arange(n_shards + 1))

    def message(self, s: int) -> bytes:
        """What shard ``s`` needs: unigrams and counts; for each order contexts, successors of each, and counts."""
        a, b = self.unigram_bounds[s], self.unigram_bounds[s + 1]
        parts = [narrow(self.unigram[0][a:b], WORD_BYTES), self.unigram_count[a:b].astype(np.uint32)]
        for (context, successor), _, count, bounds in self.pairs:
            a, b = bounds[s], bounds[s + 1]
            c = context[a:b]
            new = np.ones(len(c), bool)
            new[1:] = c[1:] != c[:-1]
            size = np.diff(np.append(np.flatnonzero(new), len(c)))
            parts += [narrow(c[new], KEY_BYTES), size.astype(np.uint32), narrow(successor[a:b], NEXT_BYTES), count[a:b].astype(np.uint32)]
        return pack(*parts)

    def structure(self, keys: np.ndarray, held: np.ndarray) -> bytes:
        """The documents as occurrences of the chunk's distinct items, ordered within each document so that they compress."""
        last = self.pairs[-1][1] if self.pairs else self.of_unigram
        order = np.lexsort((last, self.row))
        ids = [np.diff(last[order], prepend=0).astype(np.int32)]
        for x in [self.of_unigram, *(p[1] for p in self.pairs[:-1])] if self.pairs else []:
            # the last pair fixes the word and all shorter contexts: one entry for each distinct pair
            firsts = np.zeros(int(last.max()) + 1 if len(last) else 0, np.int32)
            firsts[last] = x
            ids.append(firsts)
        return pack(keys, held, np.bincount(self.row, minlength=self.n).astype(np.int32), *ids)


# -------------------------------------------------------------------------------------------------------- operator


def held_out(key: Column) -> Column:
    """True for rows whose crc32 of the id as text is divisible by 10; a null id never is."""
    return F.coalesce(F.crc32(key.cast("string")) % 10 == 0, F.lit(False))


def _answers(table: pa.Table, order: int, strength: float) -> pa.Table:
    """A shard's work: adds the chunks' counts up, builds the trie of each order, and answers every chunk."""
    names, shard = table.column("chunk").to_numpy(), table.column("key")[0].as_py()
    blobs = table.column("blob")
    # a message is unpacked when it is needed, so that a shard holds its sums and one message
    counted = [(widen(m[0])[m[1] > 0], m[1][m[1] > 0]) for m in map(unpack, (b.as_py() for b in blobs))]
    vocab, at = np.unique(np.concatenate([k for k, _ in counted]), return_inverse=True)
    vocab_count = np.bincount(at, np.concatenate([c for _, c in counted]), len(vocab)).astype(np.int64)
    del counted, at
    tries = [Trie(*_summed(blobs, k), strength) for k in range(order - 1)]
    out = []
    for m in map(unpack, (b.as_py() for b in blobs)):
        q = widen(m[0])
        pos = np.minimum(np.searchsorted(vocab, q), max(len(vocab) - 1, 0))
        hit = vocab[pos] == q if len(vocab) else np.zeros(len(q), bool)
        c = np.zeros(len(q), np.uint32)
        c[hit] = vocab_count[pos[hit]]
        parts = [np.array([vocab_count.sum(), len(vocab)], np.int64), c]
        for k, trie in enumerate(tries):
            size = m[3 + 4 * k].astype(np.int64)
            own, weight = trie.look_up(widen(m[2 + 4 * k]), size, widen(m[4 + 4 * k]))
            parts += [own, weight, m[3 + 4 * k]]
        out.append(pack(*parts))
    return pa.table({"chunk": names, "shard": np.full(len(names), shard, np.int64), "blob": pa.array(out, pa.binary())})


def _summed(blobs: pa.ChunkedArray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, rank, successor, count) of a shard's n-grams of one order, the chunks' training counts added up."""
    rows = []
    for b in blobs:
        m = unpack(b.as_py())
        kept = m[5 + 4 * k] > 0
        rows.append((np.repeat(widen(m[2 + 4 * k]), m[3 + 4 * k])[kept], widen(m[4 + 4 * k])[kept], m[5 + 4 * k][kept]))
    context, successor, count = (np.concatenate(x) for x in zip(*rows, strict=True))
    del rows
    order = np.lexsort((successor, context))
    context, successor, count = context[order], successor[order], count[order].astype(np.int64)
    del order
    new = np.ones(len(context), bool)
    new[1:] = (context[1:] != context[:-1]) | (successor[1:] != successor[:-1])
    starts = np.flatnonzero(new)
    count = np.add.reduceat(count, starts) if len(starts) else count
    contexts, rank = np.unique(context[starts], return_inverse=True)
    return contexts, rank, successor[starts], count


def _finish(table: pa.Table, n_shards: int, order: int) -> pa.Table:
    """A chunk's work: the scores of its documents from all shards' answers."""
    shard, blob = table.column("shard").to_numpy(), table.column("blob").to_pylist()
    own = [unpack(blob[i]) for i in np.flatnonzero(shard < 0)]
    got = [unpack(blob[i]) for i in sorted(np.flatnonzero(shard >= 0), key=lambda i: shard[i])]
    if len(own) != 1 or len(got) != n_shards:
        raise ValueError("the passes over the documents were cut differently")
    total, kinds = sum(int(g[0][0]) for g in got), sum(int(g[0][1]) for g in got)
    c = np.concatenate([g[1] for g in got]).astype(float)
    base = (c + 0.1) / (total + 0.1 * (kinds + 1))
    levels = [(restore(np.concatenate([g[2 + 3 * k] for g in got])), restore(np.concatenate([np.repeat(g[3 + 3 * k], g[4 + 3 * k]) for g in got]))) for k in range(order - 1)]
    keys, held, n_tokens, n_known, base_score, score = [], [], [], [], [], []
    for key, out, sizes, last, *others in own:
        row = np.repeat(np.arange(len(sizes)), sizes)
        last = np.cumsum(last.astype(np.int64))
        if order == 1:
            word, ids = last, []
        else:
            word, ids = others[0][last], [*(o[last] for o in others[1:]), last]
        p = base[word]
        for (alpha, weight), i in zip(levels, ids, strict=True):
            p = alpha[i] + weight[i] * p
        keys.append(key)
        held.append(out)
        n_tokens.append(sizes.astype(np.int64))
        n_known.append(np.bincount(row, c[word] > 0, len(sizes)).astype(np.int64))
        base_score.append(np.bincount(row, np.log10(base[word]), len(sizes)))
        score.append(np.bincount(row, np.log10(p), len(sizes)))
    cat = lambda x: pa.array(np.concatenate(x))
    ids, out = np.concatenate(keys), np.concatenate(held)
    return pa.table({"doc_id": pa.array(ids, mask=out == 2), "held_out": pa.array(out == 1), "n_tokens": cat(n_tokens), "n_known": cat(n_known), "train_tokens": pa.array(np.full(len(ids), total, np.int64)), "base_score": cat(base_score), "score": cat(score)})


def score(docs: DataFrame, order: int = ORDER, strength: float = STRENGTH, n_shards: int | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Tokens are lower-cased words and one end. The model and the base counts come from all rows that aren't held out.
    A null or blank text is its end alone. Repeated rows stay repeated and count as often in training. A null
    doc_id is in training. An empty table gives no rows. Other columns are not read.
    """
    n_shards = n_shards or shards(docs, each=SHARD_BYTES)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), held_out(F.col("doc_id")).alias("held"), F.spark_partition_id().alias("part"))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Chunk, np.ndarray, np.ndarray]]:
        nth = 0
        for batch in batches:
            held, keys = np.asarray(column(batch, "held").to_numpy(zero_copy_only=False), bool), column(batch, "doc_id")
            missing, ids = keys.is_null().to_numpy(zero_copy_only=False), keys.fill_null(0).to_numpy()
            for a, b, offsets, data in pieces(column(batch, "text"), chunk_bytes):
                yield Chunk((column(batch, "part")[0].as_py(), nth), data, offsets, ~held[a:b], n_shards, order), ids[a:b], np.where(missing[a:b], 2, held[a:b]).astype(np.int8)
                nth += 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, _ in chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_shards)), pa.array(np.full(n_shards, chunk.name)), pa.array([chunk.message(s) for s in range(n_shards)], pa.binary())], names=["key", "chunk", "blob"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, ids, held in chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([chunk.name]), pa.array([-1], pa.int64()), pa.array([chunk.structure(ids, held)], pa.binary())], names=["chunk", "shard", "blob"])

    schema = "chunk long, shard long, blob binary"
    answers = rows.mapInArrow(ask, "key long, chunk long, blob binary").groupBy("key").applyInArrow(lambda t: _answers(t, order, strength), schema)
    own = rows.mapInArrow(keep, schema)
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return answers.unionByName(own).groupBy("chunk").applyInArrow(lambda t: _finish(t, n_shards, order), out)
