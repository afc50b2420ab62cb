"""Exchange of packed arrays between chunks of documents and shards of keys.

A chunk is a few megabytes of whole documents inside one batch of a task; a shard owns the keys that hash to it. What
a chunk sends to a shard is one row with a compressed blob, so a key that a chunk repeats is sent once, no key is
a row, and a very frequent key costs a shard as many entries as there are chunks.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a chunk, and for which there is one shard.
CHUNK_BYTES = 3 << 20
SHARD_BYTES = 24 << 20
_CODEC = pa.Codec("zstd", 1)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob."""
    out = io.BytesIO()
    for a in arrays:
        np.save(out, a, allow_pickle=False)
    raw = out.getvalue()
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = _CODEC.decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    at, out = io.BytesIO(raw), []
    while at.tell() < len(raw):
        out.append(np.load(at, allow_pickle=False))
    return out


def narrow(x: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bytes of 64-bit integers, as a byte matrix."""
    return np.ascontiguousarray(x.astype("<u8", copy=False)).view(np.uint8).reshape(-1, 8)[:, :width].copy()


def widen(x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), 8), np.uint8)
    out[:, : x.shape[1]] = x
    return out.view("<u8").ravel()


def chunk_name(part: int, nth: int, *parts: np.ndarray) -> int:
    """A chunk's id from its scan partition (``spark_partition_id`` of the rows), its place there and its content. Two
    passes over the same scan name it alike; a pass that cut its input otherwise would name it otherwise, so that
    can't go unnoticed."""
    import zlib

    a = b = 0
    for p in (np.array([part, nth], np.int64), *parts):
        raw = np.ascontiguousarray(p).tobytes()
        a, b = zlib.crc32(raw, a), zlib.adler32(raw, b)
    return (a << 31) ^ b


def shards(docs: DataFrame, text: str = "text", each: int = SHARD_BYTES) -> int:
    """Shards for this much text; at least as many as tasks can run at once."""
    size = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // each))


def blobs(table: pa.Table, name: str = "blob") -> list[bytes]:
    return table.column(name).to_pylist()
