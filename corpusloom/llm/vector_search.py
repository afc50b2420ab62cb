"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

Vectors become 64-bit codes: inner-product search is turned into angle search by one more component, then the signs
after a rotation that is learned on a bounded sample (alternating between codes and rotation). A code is split into
substrings, and every block of vectors keeps one bucket table for each substring. Codes within radius r of a query
differ by at most r // m bits in at least one of the m substrings, so probing those buckets finds all of them; the
found codes are checked against r and their vectors reranked in double precision.

Blocks of vectors meet blocks of queries by a key, so a task holds one block of each. The radius is learned on the
sample so that the wanted share of true neighbours lies within it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.shared import written

K = 20
BITS, SUBSTRINGS = 64, 8
#: Rows of the sample for rotation and radius, its queries, and the share of true neighbours within the radius.
SAMPLE, SAMPLE_QUERIES, RECALL = 4096, 256, 0.97
#: Most vectors and most queries in one task.
VECTOR_BLOCK, QUERY_BLOCK = 32_768, 8_192

_BYTE = np.arange(256, dtype=np.uint8)
#: Byte values ordered by their number of set bits: probing takes the first so many, exclusive-or the query's byte.
_NEAR = _BYTE[np.argsort(np.bitwise_count(_BYTE), kind="stable")]
_WITHIN = np.searchsorted(np.sort(np.bitwise_count(_BYTE)), np.arange(10), "left")


class Codes:
    """Learned rotation and radius."""

    def __init__(self, sample: np.ndarray, largest: float, k: int = K, recall: float = RECALL, seed: int = 11):
        self.largest = largest
        x = self.lifted(sample)
        rng = np.random.default_rng(seed)
        dim = x.shape[1]
        _, _, v = np.linalg.svd(x, full_matrices=dim <= BITS)
        base = v[:BITS].T if len(v) >= BITS else np.concatenate([v.T, rng.normal(size=(dim, BITS - len(v))) / np.sqrt(dim)], 1)
        z = x @ base
        r = np.linalg.qr(rng.normal(size=(BITS, BITS)))[0]
        for _ in range(30):
            u, _, w = np.linalg.svd(np.where(z @ r > 0, 1.0, -1.0).T @ z)
            r = (u @ w).T
        self.rotation = base @ r
        queries = sample[:SAMPLE_QUERIES]
        scores = queries @ sample.T
        scores[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
        near = np.argsort(-scores, axis=1)[:, : min(k, max(len(sample) - 1, 0))]
        bits = np.bitwise_count(self.of_queries(queries)[:, None] ^ self.of(sample)[near]) if near.size else np.zeros(1)
        self.radius = int(np.ceil(np.quantile(bits, recall)))

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Vectors of equal length whose angles to a query order them as their inner products do."""
        x = x / self.largest
        return np.column_stack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))])

    @staticmethod
    def _pack(z: np.ndarray) -> np.ndarray:
        return np.packbits(z > 0, axis=1).view(">u8").ravel().astype(np.uint64)

    def of(self, x: np.ndarray) -> np.ndarray:
        return self._pack(self.lifted(x) @ self.rotation)

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        return self._pack(np.column_stack([q, np.zeros(len(q))]) @ self.rotation)


class Block:
    """The multi-index of one block of vectors."""

    def __init__(self, x: np.ndarray, code: np.ndarray):
        self.x, self.code = x, code
        self.parts = code.astype(">u8").view(np.uint8).reshape(-1, SUBSTRINGS)
        self.order = [np.argsort(self.parts[:, s], kind="stable") for s in range(SUBSTRINGS)]
        self.start = [np.searchsorted(self.parts[o, s], np.arange(257)) for s, o in enumerate(self.order)]

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """Rows whose code differs in at most ``radius`` bits, by probing every substring's buckets."""
        most = radius // SUBSTRINGS
        if most >= 8:
            seen = np.ones(len(self.code), bool)
        else:
            seen = np.zeros(len(self.code), bool)
            query = np.array([code], ">u8").view(np.uint8)
            for s in range(SUBSTRINGS):
                probe = _NEAR[: _WITHIN[most + 1]] ^ query[s]
                for a, b in zip(self.start[s][probe], self.start[s][probe.astype(np.int64) + 1], strict=True):
                    seen[self.order[s][a:b]] = True
        rows = np.flatnonzero(seen)
        return rows[np.bitwise_count(self.code[rows] ^ code) <= radius]


def usable(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors that take part: not null, not zero, all components present and finite."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(fine & F.exists("v", lambda c: c != 0))


def search(vectors: DataFrame, every: int = 20, k: int = K, vector_block: int = VECTOR_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with an id divisible by ``every`` its ``k`` nearest other rows.

    Nearness is the inner product in double precision, ties to the smaller vec_id; with fewer candidates all are
    given. Equal vectors are one candidate that holds its k + 1 smallest ids, which is exact. A query meets vectors
    of its own length, since there is no other inner product; each length of a table has its codes. Vectors that
    ``usable`` leaves out take no part. An empty table gives no rows; a repeated vec_id with equal vectors counts once.
    """
    rows = written(usable(vectors), "vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))
    found = None
    for size, n, largest in rows.groupBy(F.size("v").alias("size")).agg(F.count("*"), F.max(norm)).sort("size").collect():
        part = _of_one_length(rows.where(F.size("v") == size), n, largest, every, k, vector_block, query_block)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def sampled(rows: DataFrame, n: int, most: int) -> np.ndarray:
    """At most ``most`` of ``n`` vectors, the first by hash; about twice as many reach the driver whatever the size."""
    span = 1 << 40
    few = rows.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(span)) < F.lit(min(span, span * 2 * most // n)))
    taken = few.sort(F.xxhash64("vec_id", "v")).select("v").limit(most).collect()
    return np.array([r[0] for r in taken or rows.select("v").limit(most).collect()])


def _of_one_length(rows: DataFrame, n: int, largest: float, every: int, k: int, vector_block: int, query_block: int) -> DataFrame:
    spark = rows.sparkSession
    sample = sampled(rows, n, SAMPLE)
    codes = Codes(sample, largest, k)
    shared = spark.sparkContext.broadcast(codes)

    least = rows.withColumn("nth", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    distinct = least.groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    n_vectors, n_queries = max(spark.sparkContext.defaultParallelism, -(-n // vector_block)), -(-n // (every * query_block))
    left = distinct.withColumn("vb", F.pmod(F.xxhash64("v"), F.lit(n_vectors))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    queries = rows.where(F.col("vec_id") % every == 0).withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(n_queries)).cast("int"))
    right = queries.withColumn("vb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_vectors - 1).cast("long")))).select("vec_id", "v", "vb", "qb")

    def matrix(col: pa.ChunkedArray) -> np.ndarray:
        col = col.combine_chunks()
        return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1) if len(col) else np.zeros((0, 0))

    def run(block: pa.Table, queries: pa.Table) -> pa.Table:
        codes = shared.value
        out: list[tuple] = []
        if len(block) and len(queries):
            x, q = matrix(block.column("v")), matrix(queries.column("v"))
            ids = block.column("ids").combine_chunks()
            flat, bounds = ids.flatten().to_numpy(), ids.offsets.to_numpy() - ids.offsets[0].as_py()
            size = np.diff(bounds)
            index = Block(x, codes.of(x))
            for name, vector, code in zip(queries.column("vec_id").to_numpy(), q, codes.of_queries(q), strict=True):
                radius = codes.radius
                while True:  # too few codes in reach: reach further, up to all
                    found = index.within(code, radius)
                    if size[found].sum() > k or radius >= BITS:
                        break
                    radius = min(BITS, radius + SUBSTRINGS)
                score = np.einsum("ij,j->i", x[found], vector)
                if len(found) > k + 1:
                    cut = np.partition(score, -(k + 1))[-(k + 1)]
                    found, score = found[score >= cut], score[score >= cut]
                at = np.repeat(np.arange(len(found)), size[found])
                vec = flat[bounds[found][at] + np.arange(len(at)) - np.repeat(np.cumsum(size[found]) - size[found], size[found])]
                own = vec != name
                vec, value = vec[own], score[at[own]]
                best = np.lexsort((vec, -value))[:k]
                out.append((np.full(len(best), name), vec[best], value[best]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": cols[0], "vec_id": cols[1], "score": cols[2]})

    found = left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
