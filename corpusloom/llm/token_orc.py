"""Token ids in ORC: one row a document, in ascending doc_id order.

The ids are an ``array<int>`` column, which ORC run-length encodes; stripes, row indexes and a Bloom filter on
doc_id let a reader fetch one document, or a share of the stripes, from the metadata. Files are range
partitions, so file order is doc_id order and every file can be read (and lost, and rewritten) alone.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.arrow_text import column, pieces
from corpusloom.llm.bpe import byte_symbols, gathered

STRIPE_BYTES = 8 << 20
INDEX_STRIDE = 1000
#: Distinct parts of text that a Python worker remembers: between so many and twice as many.
REMEMBERED = 250_000
#: Bytes of text whose distinct parts are looked up together.
BLOCK = 2 << 20

#: Classes of ASCII between which the byte-level pattern always starts a new piece: letters, digits, punctuation.
#: Apostrophes (contractions) and the characters of special-token marks belong to none.
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = 3
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[48:58] = 2
_CLASS[[ord(c) for c in "'<|>"]] = 0
_VISIBLE = np.zeros(256, bool)
_VISIBLE[33:127] = True


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Marks of places between which the byte-level pattern can be applied alone.

    A space belongs to the visible character behind it, and begins a run of blanks behind a visible one; a single line
    end between visible characters stands alone; letters, digits and punctuation part from each other."""
    n = len(data)
    mark = np.zeros(n + 1, bool)
    if n:
        seen, kind = _VISIBLE[data], _CLASS[data]
        seen_before, seen_behind = np.append(False, seen[:-1]), np.append(seen[1:], False)
        mark[:-1] = (data == 32) & (seen_before | seen_behind)
        line = (data == 10) & seen_before & seen_behind
        mark[:-1] |= line
        mark[1:] |= line
        mark[1:-1] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
    mark[offsets] = True
    return mark


class PartMemo:
    """Encodes whole texts with a vocabulary of the ``tokenizers`` library, each distinct part of a block only once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.space = byte_symbols()[32]

    def parts(self, raw: list[bytes]) -> list[bytes]:
        """Ids of parts, as little-endian 32-bit integers. Letters go to the library's model directly (it is a byte-level
        BPE, and they are one piece); anything else is encoded by the whole tokenizer."""
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        known, older, tokenize = self.known, self.older, self.lib.model.tokenize
        found: list = [known.get(w) for w in raw]
        rest = []
        for k in [k for k, x in enumerate(found) if x is None]:
            w = raw[k]
            ids = older.get(w)
            if ids is None:
                if w.isascii() and (w[1:] if w[0] == 32 else w).isalpha():
                    text = w.decode()
                    ids = np.array([t.id for t in tokenize(self.space + text[1:] if w[0] == 32 else text)], "<u4").tobytes()
                else:
                    rest.append(k)
                    continue
            found[k] = ids
            if len(w) < 64:
                known[w] = ids
        for k, e in zip(rest, self.lib.encode_batch_fast([raw[k].decode() for k in rest], add_special_tokens=False) if rest else [], strict=True):
            found[k] = np.array(e.ids, "<u4").tobytes()
            if len(raw[k]) < 64:
                known[raw[k]] = found[k]
        return found

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds): each text's ids and the end."""
        mark = cuts(data, offsets)
        at = np.flatnonzero(mark).astype(np.int64)
        parts = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
        values = [*self.parts(parts.dictionary.to_pylist()), np.array([end_id], "<u4").tobytes()]
        bounds = np.searchsorted(at, offsets)
        index = np.insert(parts.indices.to_numpy(), bounds[1:], len(values) - 1)
        held, ends = gathered(pa.array(values, pa.large_binary()), pa.array(index), bounds + np.arange(len(bounds)))
        return np.frombuffer(held, "<u4")[: ends[-1] // 4], ends // 4


#: One memo for each vocabulary in a Python worker; it serves all tasks that the worker runs.
_MEMOS: dict[str, PartMemo] = {}


def memo(path: str) -> PartMemo:
    if path not in _MEMOS:
        _MEMOS[path] = PartMemo(path)
    return _MEMOS[path]


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, text: str = "text", key: str = "doc_id", partitions: int | None = None) -> None:
    """Writes (doc_id, offset, n_tokens, ids, part) to ORC files under ``path``; offset counts the ids before a document in
    its file, ``part``.

    ``end_id`` follows each document's ids. A null text has only that id. A null doc_id comes first. Rows with equal
    doc_id are in the order of a hash of their texts, by which they may also be parted, so one id may hold any share
    of the rows. An empty table writes an empty file set.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, before = memo(vocabulary), 0
        for batch in batches:
            for a, b, offsets, data in pieces(column(batch, "text"), BLOCK):
                ids, bounds = parts.encode(data, offsets, end_id)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id").slice(a, b - a), pa.array(bounds[:-1] + before), pa.array(np.diff(bounds)), lists], names=["doc_id", "offset", "n_tokens", "ids"])
                before += int(bounds[-1])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("mark"))
    rows = rows.repartitionByRange(partitions, "doc_id", "mark") if partitions else rows.repartitionByRange("doc_id", "mark")
    (
        rows.sortWithinPartitions("doc_id", "mark").select("doc_id", "text").mapInArrow(run, "doc_id long, offset long, n_tokens long, ids array<int>")
        .withColumn("part", F.spark_partition_id())
        .write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.row.index.stride", str(INDEX_STRIDE))
        .option("orc.stripe.size", str(STRIPE_BYTES)).option("compression", "zstd").orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, offset, n_tokens, ids, part) of written files; filters on doc_id prune by min-max and Bloom filter."""
    return spark.read.schema("doc_id long, offset long, n_tokens long, ids array<int>, part int").orc(path)


def file_starts(tokens: DataFrame) -> DataFrame:
    """(part, base): ids in all files before each file. One row a file; only lengths are read."""
    before = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return tokens.groupBy("part").agg(F.sum("n_tokens").alias("total")).select("part", before.alias("base"))


def digest(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of written files, in one pass over the ids; ids_crc32 is of the ids as
    little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = column(batch, "ids")
            raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False)).astype("<u4", copy=False)).cast("B")
            at = ids.offsets.to_numpy()
            sums = pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "offset"), pa.array(np.diff(at).astype(np.int64)), column(batch, "part"), sums], names=["doc_id", "offset", "n_tokens", "part", "ids_crc32"])

    found = tokens.select("doc_id", "offset", "ids", "part").mapInArrow(run, "doc_id long, offset long, n_tokens long, part int, ids_crc32 long")
    return found.join(file_starts(tokens), "part").select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
