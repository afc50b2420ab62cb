"""Vectorised helpers over the bytes of an Arrow string column.

The Python operators of this subpackage run inside ``mapInArrow``. They never make one
Python string per word: a column's UTF-8 bytes are one numpy array, words are index
ranges into it, and a word or n-gram is known by a 64-bit hash of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
#: Bytes between words in every contract of this subpackage: space and \t..\r.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: True for bytes that are not ASCII letters or digits and not part of a longer UTF-8 sequence.
NOT_WORD = np.array([not (chr(i).isalnum() and i < 128 or i >= 128) for i in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
with np.errstate(over="ignore"):
    _BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, at least ``n + 1`` of each."""
    if len(_POWERS.get("up", ())) < n + 1:
        size = max(n + 1, 1 << 20)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


#: Spans over so many bytes are hashed by XXH64. A polynomial modulo 2**64 maps some texts of 1,024 bytes and more (Thue-Morse
#: words and their complements) to one value, whatever its base.
LONG_SPAN = 256


class Sums(np.ndarray):
    """Prefix hashes that know the bytes they are of."""

    text: np.ndarray


def prefix_sums(data: np.ndarray) -> Sums:
    """Polynomial prefix hashes modulo 2**64; ``span_hash`` reads any substring's hash from them."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=out[1:])
    out = out.view(Sums)
    out.text = data
    return out


def span_hash(sums: Sums, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums) - 1)
    plain = sums.view(np.ndarray)
    out = mix((plain[ends] - plain[starts]) * down[starts] + (ends - starts).astype(U64))
    for i in np.flatnonzero(ends - starts > LONG_SPAN):
        out[i] = xxhash.xxh64_intdigest(sums.text[starts[i] : ends[i]].tobytes())
    return out


def combine(*parts: np.ndarray) -> np.ndarray:
    """Order-sensitive hash of aligned hash columns."""
    out = parts[0]
    for p in parts[1:]:
        out = mix(out * U64(0x9FB21C651E98DF25) + p)
    return out


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The named column of a batch; the last one if the name is repeated."""
    return batch.column(max(i for i, n in enumerate(batch.schema.names) if n == name))


def utf8(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; a null counts as empty."""
    values = pc.fill_null(values.cast(pa.large_string()), "")
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def pieces(values: pa.Array, most: int = 256 << 10) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``most`` bytes: (first row, end row, offsets from 0, bytes)."""
    offsets, data = utf8(values)
    row, n = 0, len(values)
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, offsets[row : end + 1] - offsets[row], data[offsets[row] : offsets[end]]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the maximal runs of non-separator bytes within each row."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~separators[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def per_row(row: np.ndarray, n: int) -> np.ndarray:
    """Bounds of each row's items in arrays that are ordered by row."""
    return np.searchsorted(row, np.arange(n + 1))
