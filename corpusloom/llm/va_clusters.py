"""Centroid clustering over a VA-file: compressed cells decide most assignments, full vectors are fetched for the rest.

Two tables share a row number. ``cells`` has a few bits for each component of a vector and its squared length; ``vectors`` has the components,
bucketed by row number, so that fetching is a join that moves row numbers to the vectors and never the vectors. For a
set of centroids, lookup tables turn the cells of a vector into an interval of its distance to each centroid. A vector
whose nearest interval ends before all others begin is assigned by its cells alone. The squared length is exact, so only
the product with the centroid is uncertain; centroids are means, shorter than vectors, which makes intervals narrow.

A round's sums come from the round before: only vectors that change their centroid are added and taken away, so a round
fetches what is undecided now, was undecided before, or moved. All arithmetic is in whole numbers and exact.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.arrow_text import column
from corpusloom.llm.shared import new_path, written

DIMENSIONS = 64
SCALE = 1024
CENTROIDS = 8
ROUNDS = 10
#: Bits of a cell. The nearest and the second centroid of the given vectors differ by 3 % of their distance; with 5 and 6 bits
#: about 85 and 55 % of them stay undecided, with 7 a round fetches 38 to 48 %.
BITS = 7
#: Components are below this in size, so that a squared distance of 64 of them is a long.
LARGEST = 1 << 27
#: Vectors that are looked at together inside a task.
BLOCK = 8192


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield batch.slice(at, BLOCK)


def _matrix(values: pa.Array, kind: str, width: int) -> np.ndarray:
    """Fixed-width binaries as a matrix."""
    return np.frombuffer(b"".join(values.to_pylist()), kind).reshape(len(values), width)


def integers(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(row, vec_id, x) of the vectors that take part; x packs floor(1024 * component) as 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            lists = column(batch, "embedding").cast(pa.large_list(pa.float64()))
            lengths = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
            right = np.flatnonzero(lengths == dimensions)
            flat = lists.take(pa.array(right)).flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(right), dimensions)
            fine = np.isfinite(x).all(1)  # a null component is NaN here
            x = np.floor(SCALE * x[fine])
            if (np.abs(x) >= LARGEST).any():
                raise ValueError(f"a component of {LARGEST // SCALE} or more has no exact squared distance in 64 bits")
            rows = batch.take(pa.array(right[fine]))
            packed = pa.array([v.tobytes() for v in x.astype("<i4")], pa.binary())
            yield pa.RecordBatch.from_arrays([column(rows, "row"), column(rows, "vec_id"), packed], names=["row", "vec_id", "x"])

    numbered = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"))
    return numbered.mapInArrow(run, "row long, vec_id long, x binary")


@contextmanager
def stored(vectors: DataFrame) -> Iterator[tuple[DataFrame, DataFrame]]:
    """(vectors, vectors bucketed by row), both over one external table in the shared folder; its name goes at the end, its files stay."""
    spark = vectors.sparkSession
    name, path = f"va_{uuid.uuid4().hex}", new_path(spark, "va-vectors")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    vectors.repartition(n, "row").write.option("path", path).option("compression", "zstd").bucketBy(n, "row").sortBy("row").saveAsTable(name)
    try:
        yield spark.read.schema(vectors.schema).parquet(path), spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def edges_of(vectors: DataFrame, bits: int = BITS) -> np.ndarray:
    """Edges of the cells for each component: the whole range, ends included, parted evenly. Empty without vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for batch in _blocks(batches):
            if batch.num_rows:
                x = _matrix(batch.column(0), "<i4", DIMENSIONS)
                low = x.min(0) if low is None else np.minimum(low, x.min(0))
                high = x.max(0) if high is None else np.maximum(high, x.max(0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(DIMENSIONS), pa.int32()), pa.array(low.astype(np.int64)), pa.array(high.astype(np.int64))], names=["at", "low", "high"])

    ends = vectors.select("x").mapInArrow(run, "at int, low long, high long").groupBy("at").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    found = sorted(tuple(r) for r in ends.collect())  # one row a component
    if not found:
        return np.zeros((0, (1 << bits) + 1), np.int64)
    low, high = (np.array([r[k] for r in found], np.int64)[:, None] for k in (1, 2))
    return low + (high + 1 - low) * np.arange((1 << bits) + 1) // (1 << bits)


def cells(vectors: DataFrame, edges: np.ndarray, bits: int = BITS) -> DataFrame:
    """(row, norm, cells) with ``bits`` bits for each component; norm is the squared length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            x = _matrix(column(batch, "x"), "<i4", DIMENSIONS)
            cell = np.stack([np.searchsorted(edges[j], x[:, j], "right") - 1 for j in range(DIMENSIONS)], 1).astype(np.uint8)
            packed = np.packbits((cell[:, :, None] >> np.arange(bits, dtype=np.uint8) & 1).reshape(len(cell), DIMENSIONS * bits), axis=1)
            norm = pa.array((x.astype(np.int64) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([column(batch, "row"), norm, pa.array([c.tobytes() for c in packed], pa.binary())], names=["row", "norm", "cells"])

    return vectors.select("row", "x").mapInArrow(run, "row long, norm long, cells binary")


def lookup(edges: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest c * c - 2 * c * x of a centroid's component c and the x of a cell: two tables by (centroid, component, cell)."""
    c = centroids[:, :, None]
    one, other = c * (c - 2 * edges[None, :, :-1]), c * (c - 2 * (edges[None, :, 1:] - 1))
    return np.minimum(one, other), np.maximum(one, other)


def intervals(cell: np.ndarray, norm: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest squared distance to each centroid."""
    at = np.arange(DIMENSIONS)
    return tuple(norm[:, None] + np.stack([one[at, cell].sum(1) for one in t], 1) for t in tables)


def decided(cell: np.ndarray, norm: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The nearest centroid by the cells alone, -1 where intervals overlap."""
    low, high = intervals(cell, norm, tables)
    at, best = np.arange(len(cell)), high.argmin(1)
    low[at, best] = np.iinfo(np.int64).max
    return np.where(high[at, best] < low.min(1), best, -1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid; ties to the smaller number."""
    far = np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)
    return far.argmin(1), far.min(1)


def _unpacked(values: pa.Array, bits: int) -> np.ndarray:
    packed = _matrix(values, np.uint8, (DIMENSIONS * bits + 7) // 8)
    flags = np.unpackbits(packed, axis=1, count=DIMENSIONS * bits).reshape(len(packed), DIMENSIONS, bits)
    return (flags << np.arange(bits, dtype=np.uint8)).sum(2, dtype=np.int64)


def undecided(table: DataFrame, edges: np.ndarray, centroids: np.ndarray, before: np.ndarray, bits: int = BITS) -> DataFrame:
    """Rows whose full vectors a round needs: overlapping intervals now or before, or another centroid than before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = lookup(edges, centroids), lookup(edges, before)
        for batch in _blocks(batches):
            cell = _unpacked(column(batch, "cells"), bits)
            norm = column(batch, "norm").to_numpy()
            now, then = (decided(cell, norm, t) for t in tables)
            yield pa.RecordBatch.from_arrays([column(batch, "row").take(pa.array(np.flatnonzero((now != then) | (now < 0))))], names=["row"])

    return table.mapInArrow(run, "row long")


def moves(vectors: DataFrame, centroids: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Change of (counts, sums) of each cluster by these vectors: a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids), DIMENSIONS + 1), np.int64)
        for batch in _blocks(batches):
            x = _matrix(batch.column(0), "<i4", DIMENSIONS).astype(np.int64)
            x1 = np.concatenate([np.ones((len(x), 1), np.int64), x], 1)
            now = nearest(x, centroids)[0]
            then = np.full(len(x), -1) if before is None else nearest(x, before)[0]
            for c in range(len(centroids)):
                total[c] += x1[(now == c) & (then != c)].sum(0) - x1[(then == c) & (now != c)].sum(0)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total.ravel()[at])], names=["at", "n"])

    total = np.zeros(len(centroids) * (DIMENSIONS + 1), np.int64)
    for r in vectors.select("x").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        total[r.at] = r.n
    total = total.reshape(len(centroids), -1)
    return total[:, 0], total[:, 1:]


def first_centroids(vectors: DataFrame, most: int) -> np.ndarray:
    """The vectors whose ids have the smallest hashes; rows without an id come last, ties go by components."""
    key = F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256)
    found = vectors.select(key.alias("key"), "x").orderBy(F.col("key").asc_nulls_last(), "x").limit(most).collect()
    return np.array([struct.unpack(f"<{DIMENSIONS}i", r.x) for r in found], np.int64).reshape(len(found), DIMENSIONS)


def fit(vectors: DataFrame, bucketed: DataFrame, rounds: int = ROUNDS, most: int = CENTROIDS, bits: int = BITS) -> np.ndarray:
    """The centroids after all rounds."""
    centroids, edges = first_centroids(vectors, most), edges_of(vectors, bits)
    if not len(centroids):
        return centroids
    table = written(cells(vectors, edges, bits), "va-cells")
    before, counts, sums = None, np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
    for _ in range(rounds):
        if before is None:
            here = vectors
        elif (before == centroids).all():
            break  # nothing moves any more
        else:
            here = undecided(table, edges, centroids, before, bits).join(bucketed, "row")
        n, total = moves(here, centroids, before)
        counts, sums, before = counts + n, sums + total, centroids
        centroids = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids)
    return centroids


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(c)) for c in centroid).encode()).hexdigest()


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector, exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            cluster, distance = nearest(_matrix(column(batch, "x"), "<i4", DIMENSIONS).astype(np.int64), centroids)
            yield pa.RecordBatch.from_arrays([column(batch, "vec_id"), pa.array(cluster, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "x").mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, rounds: int = ROUNDS, most: int = CENTROIDS, bits: int = BITS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part.

    Vectors that are null, of another length, or hold a null or non-finite component take no part. Rows without a
    vec_id do, but begin no centroid while others can; repeated rows count as often as they occur. With fewer vectors
    than centroids there are as many centroids as vectors; an empty table gives an empty one. Other columns aren't read.
    """
    spark: SparkSession = vectors.sparkSession
    with stored(integers(vectors)) as (plain, bucketed):
        centroids = fit(plain, bucketed, rounds, most, bits)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    rows = written(assigned(plain, centroids), "va-assigned")
    sums = {r.cluster: r.s for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row a centroid
    facts = spark.createDataFrame([(c, sums.get(c, 0), sum(sums.values()), digest(centroids[c])) for c in range(len(centroids))], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
