"""Near copies by similarity: the Jaccard index of the sets of word shingles, exact for every candidate pair.

1. Texts with equal shingle sets are one class, so a thousand copies are one row.
2. SimHash fingerprints of the same shingles are joined by the binary trie (``simhash``): fingerprints at ``RADIUS`` or fewer
   differing bits are candidates.
3. Fingerprints miss many pairs of this similarity, so a class's set also gets ``BANDS * ROWS`` minimum hashes; classes that
   agree in all rows of a band share a bucket. At a similarity of 0.8 a pair misses all buckets once in 1,000 times or less.
4. Members of a bucket that the fingerprints don't join with its least class are compared with it. What isn't joined by these
   links meets the members of other components block by block: tasks get two blocks of texts and give links, so no row is a pair.
5. A compared pair, of fingerprints or of a bucket, is linked if the Jaccard index of the shingle sets reaches the similarity.

Most texts are like no other. A bitmap of the names that a join asks for is broadcast, bounded in size, so that texts and band keys
which it rules out aren't shuffled; the exact join follows over the rest.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrow_text import LOWER, U64, column, combine, mix, pieces, prefix_sums, span_hash, words
from corpusloom.llm.components import connected_components
from corpusloom.llm.shared import new_path, written
from corpusloom.llm.simhash import fingerprints, hamming_links

SHINGLE = 5
#: Differing bits of fingerprints that the trie joins.
RADIUS = 2
SIMILARITY = 0.8
BANDS, ROWS = 24, 6
_PAIRS = 256
#: Bits of a bitmap for each name, and the logarithm of its bits at most: 8 MB; with more names it only rules out less.
NAME_BITS, BITMAP = 16, 26
#: Members and shingles of a block at most (on average), and shingles whose holders are multiplied at once.
BLOCK_CLASSES, BLOCK_SHINGLES, TOGETHER = 512, 300_000, 2048
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
_ODD = mix(_SEEDS) | U64(1)


def shingle_sets(offsets: np.ndarray, data: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each row's distinct shingles, in order; the whole word sequence if it is shorter than a shingle."""
    data = LOWER[data]
    starts, ends, row = words(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    token = span_hash(prefix_sums(data), starts, ends)
    n = len(token) - shingle + 1
    size = np.bincount(row)
    full = np.flatnonzero(row[:n] == row[shingle - 1 :]) if n > 0 else np.zeros(0, np.int64)
    found = [(row[full], combine(*(token[full + i] for i in range(shingle))))]
    first = np.cumsum(size) - size
    for k in range(1, shingle):
        short = np.flatnonzero(size == k)
        found.append((short, combine(np.full(len(short), k, U64), *(token[first[short] + i] for i in range(k)))))
    row, key = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return row[new], key[new]


def _marks(offsets: np.ndarray, data: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, size, band keys) of every row; blank rows have class 0 and size 0."""
    n = len(offsets) - 1
    row, key = shingle_sets(offsets, data, shingle)
    size = np.bincount(row, minlength=n)
    held = np.flatnonzero(size)
    kind, bands = np.zeros(n, U64), np.zeros((n, BANDS), U64)
    if len(held):
        at = (np.cumsum(size) - size)[held]
        kind[held] = combine(np.add.reduceat(mix(key), at), np.bitwise_xor.reduceat(key, at), size[held].astype(U64))
        least = np.stack([np.minimum.reduceat((key ^ s) * o, at) for s, o in zip(_SEEDS, _ODD, strict=True)], axis=1)
        for b in range(BANDS):
            bands[held, b] = combine(np.full(len(held), b + 1, U64), *(least[:, b * ROWS + i] for i in range(ROWS)))
    return kind.view(np.int64), size.astype(np.int64), bands.view(np.int64)


def marked(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(row, class, size, bands): every row of ``docs`` as a struct, with the marks of its shingle set."""

    @F.arrow_udf("struct<class:long,size:long,bands:array<long>>")
    def marks(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in texts:
            found = [_marks(offsets, data, shingle) for _, _, offsets, data in pieces(values)] or [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, BANDS), np.int64))]
            kind, size, bands = (np.concatenate(x) for x in zip(*found, strict=True))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(kind) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel()))
            yield pa.StructArray.from_arrays([pa.array(kind), pa.array(size), lists], names=["class", "size", "bands"])

    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), marks(F.col("text")).alias("mark"))
    return whole.select("row", "mark.class", "mark.size", "mark.bands")


def flagged(rows: DataFrame, key: str, names: DataFrame) -> DataFrame:
    """``rows`` with ``asked``: false only if ``key`` (long) is none of ``names`` (one column of distinct longs)."""
    width = min(BITMAP, max(10, (NAME_BITS * names.count()).bit_length()))

    def place(name: str):
        at = F.xxhash64(name).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        return F.shiftright(at, 6), F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int"))

    slot, bit = place(names.columns[0])
    bitmap = names.select(slot.alias("slot"), bit.alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits"))
    slot, bit = place(key)
    found = rows.join(F.broadcast(bitmap), slot == bitmap["slot"], "left")
    return found.select(*rows.columns, F.coalesce(F.col("bits").bitwiseAND(bit) != 0, F.lit(False)).alias("asked"))


def possible(rows: DataFrame, key: str, names: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``key`` is none of ``names``; none whose key is one of them is missing."""
    return flagged(rows, key, names).where("asked").drop("asked")


def similar(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, hubs: DataFrame | None = None) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose texts (class, text) have shingle sets of at least this Jaccard index. ``hubs`` are the same
    texts for a, which may be in many pairs: not stored by class, so that Spark can split such a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, _PAIRS):
                batch = whole.slice(k, _PAIRS)
                n = batch.num_rows
                rows, keys = [], []
                for name in ("text_a", "text_b"):
                    for a, _, offsets, data in pieces(column(batch, name)):
                        row, key = shingle_sets(offsets, data, shingle)
                        rows.append(row + a)
                        keys.append(key)
                row, key = np.concatenate(rows), np.concatenate(keys)
                order = np.lexsort((key, row))
                row, key = row[order], key[order]
                both = np.bincount(row[1:][(row[1:] == row[:-1]) & (key[1:] == key[:-1])], minlength=n)
                union = np.bincount(row, minlength=n) - both
                yield batch.select(["a", "b"]).filter(pa.array(both >= similarity * union - 1e-9))

    held = texts if hubs is None else possible(hubs, "class", pairs.select("a").distinct())
    near = pairs.join(texts.select(F.col("class").alias("b"), F.col("text").alias("text_b")), "b").join(held.select(F.col("class").alias("a"), F.col("text").alias("text_a")), "a")
    return near.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _near(size: str, other: str, similarity: float):
    """Sizes of sets that may reach the similarity."""
    return F.least(size, other) >= similarity * F.greatest(size, other) - 1e-9


def near_classes(rows: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """(class, component) of the classes in ``marked`` rows that have a similar class."""
    classes = rows.where("size > 0").groupBy("class", "size").agg(F.first("bands").alias("bands"))
    entries = written(classes.select("class", "size", F.explode("bands").alias("key")), "band-keys")
    # nearly all keys are one class's: they are counted by name, and only what may be shared is dealt with its class
    several = written(entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared-keys")
    entries = written(possible(entries, "key", several), "shared-entries")
    shared = entries.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("class", "size")).alias("least")).where("n > 1").select("key", F.col("least.class").alias("pivot"), F.col("least.size").alias("pivot_size"))
    members = written(entries.join(shared, "key"), "bucket-members")
    near = written(by_fingerprint(rows, shingle), "near-fingerprints")
    wanted = written(members.select("class").unionByName(near.select(F.explode(F.array("a", "b")).alias("class"))).distinct(), "wanted")
    texts = possible(rows.select("class", F.col("row.text").alias("text")), "class", wanted).join(wanted, "class", "left_semi").groupBy("class").agg(F.first("text").alias("text"))
    # stored by class: texts are dealt once, the joins below deal names only
    spark, table = rows.sparkSession, f"texts_{uuid.uuid4().hex}"
    stored = new_path(spark, "bucket-texts")
    texts.write.option("path", stored).option("compression", "zstd").bucketBy(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "class").sortBy("class").saveAsTable(table)
    texts, plain = spark.table(table), spark.read.schema("class long, text string").parquet(stored)

    # first the links of the fingerprints, then one comparison a class that they don't join: with the least of all its buckets' pivots
    links = written(similar(near, texts, similarity, shingle, plain), "similar")
    first = _unlike(members, connected_components(links)).where(_near("size", "pivot_size", similarity)).groupBy(F.col("class").alias("b")).agg(F.min("pivot").alias("a"))
    first = written(first, "first-pairs")
    links = written(links.unionByName(similar(first, texts, similarity, shingle, plain)), "similar")
    members = members.select("key", "class", "size", "pivot", "pivot_size")
    # then with the pivots of those buckets that it isn't joined with yet
    parts = connected_components(links)
    second = _unlike(members, parts).where(_near("size", "pivot_size", similarity)).select(F.col("pivot").alias("a"), F.col("class").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    second = written(second, "second-pairs")
    links = written(links.unionByName(similar(second, texts, similarity, shingle, plain)), "similar")
    named = written(_parted(members, connected_components(links)), "bucket-parts")
    # a pivot has met every member or is joined with it; the members outside a bucket's largest part meet those of all other parts
    every = links.unionByName(similar_in_blocks(named.where("class <> pivot"), texts, similarity, shingle))
    parts = connected_components(every)
    spark.sql(f"DROP TABLE {table}")  # the name in the catalog; the files are the shared folder's
    return parts.select(F.col("node").alias("class"), "component")


def by_fingerprint(rows: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Candidate links (a, b) of classes by the trie join of their fingerprints: each class with the least one of its fingerprint, and
    the forest that joins fingerprints by steps of at most ``radius`` bits."""
    texts = rows.where("size > 0").select("class", F.col("row.text").alias("text"))
    prints = written(fingerprints(texts, shingle, key="class").groupBy("doc_id").agg(F.min("fp").alias("fp")), "class-fingerprints")
    kinds = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprints")
    equal = prints.join(kinds, "fp").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    return equal.unionByName(hamming_links(kinds, radius).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).where("a <> b").distinct()


def similar_in_blocks(members: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """Links (a, b) between similar members (key, class, size, part) of one bucket and different parts.

    A bucket's members fall into bands of sizes, each a factor of the similarity wide, so similar sets are in one band or in neighbouring
    ones; the members of its largest part, which needs no comparison with itself, are apart. These groups are cut into blocks of
    bounded size. A task compares two blocks by the shingles that both hold and gives links only: no row is a pair.
    """
    several = members.groupBy("key", "part").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("kinds"), F.max(F.struct("n", "part"))["part"].alias("main")).where("kinds > 1")
    # buckets with the same members are compared once
    same = members.join(several.select("key"), "key", "left_semi").groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("class").cast("decimal(38,0)")).alias("a"), F.bit_xor(F.xxhash64("class", F.lit(1))).alias("b"))
    once = same.groupBy("n", "a", "b").agg(F.min("key").alias("key")).select("key")
    band = F.floor(F.log(F.col("size")) / (-math.log(similarity) * 1.000001)).cast("int")
    rows = members.join(several.join(once, "key"), "key").select("key", "class", "size", "part", (F.col("part") == F.col("main")).alias("inner"), band.alias("band"))
    counts = rows.groupBy("key", "band", "inner").agg(F.greatest(F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    each = counts.select("key", "band", "inner", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    x, y = each.alias("x"), each.alias("y")
    one = (F.col("x.band") == F.col("y.band")) & ((F.col("x.inner") & ~F.col("y.inner")) | ((F.col("x.inner") == F.col("y.inner")) & (F.col("x.block") <= F.col("y.block"))))
    next_ = F.col("y.band") == F.col("x.band") + 1
    meet = x.join(y, F.col("x.key") == F.col("y.key")).where((one | next_) & ~(F.col("x.inner") & F.col("y.inner")))
    meet = meet.select(F.col("x.key").alias("key"), *[F.struct(F.col(f"{s}.band"), F.col(f"{s}.inner"), F.col(f"{s}.block")).alias(s) for s in "xy"]).withColumn("pair", F.struct("key", "x", "y"))
    sides = meet.select("key", "pair", F.explode(F.array_distinct(F.array("x", "y"))).alias("at"))
    placed = rows.join(counts, ["key", "band", "inner"]).select("key", "class", "part", F.struct("band", "inner", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int").alias("block")).alias("at"))
    sent = placed.join(sides, ["key", "at"]).select("pair", "class", "part", (F.col("at") == F.col("pair.x")).alias("left"), (F.col("at") == F.col("pair.y")).alias("right")).join(texts, "class")

    def compare(table: pa.Table) -> pa.Table:
        sets = []
        for a, _, offsets, data in pieces(table.column("text").combine_chunks()):
            row, key = shingle_sets(offsets, data, shingle)
            sets.append((row + a, key))
        row, key = (np.concatenate(v) for v in zip(*sets, strict=True))
        size = np.bincount(row, minlength=len(table))
        _, key, times = np.unique(key, return_inverse=True, return_counts=True)
        shared = times[key] > 1
        row, (_, key) = row[shared], np.unique(key[shared], return_inverse=True)
        left, right = (np.flatnonzero(table.column(c).to_numpy(zero_copy_only=False)) for c in ("left", "right"))
        part = table.column("part").to_numpy()
        both = np.zeros((len(left), len(right)), np.float32)
        for k in range(0, int(key.max()) + 1 if len(key) else 0, TOGETHER):
            held = np.zeros((len(table), TOGETHER), np.float32)
            now = (key >= k) & (key < k + TOGETHER)
            held[row[now], key[now] - k] = 1
            both += held[left] @ held[right].T
        union = size[left][:, None] + size[right][None, :] - both
        near = (both >= similarity * union - 1e-9) & (part[left][:, None] != part[right][None, :])
        i, j = np.nonzero(near)
        name = table.column("class").to_numpy()
        a, b = name[left[i]], name[right[j]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return sent.groupBy("pair").applyInArrow(compare, "a long, b long").where("a <> b").distinct()


def _unlike(members: DataFrame, parts: DataFrame) -> DataFrame:
    """Members of buckets that aren't in the component of their pivot."""
    own = parts.select(F.col("node").alias("pivot"), F.col("component").alias("pivot_part"))
    return _parted(members, parts).where("class <> pivot").join(own, "pivot", "left").where(F.col("part") != F.coalesce("pivot_part", "pivot"))


def _parted(members: DataFrame, parts: DataFrame) -> DataFrame:
    """Members of buckets with the component that they are in so far."""
    return members.join(parts, members["class"] == parts["node"], "left").select("key", "class", "size", "pivot", "pivot_size", F.coalesce("component", "class").alias("part"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one document of each group of near copies, the one with the least doc_id; columns stay, whatever
    their names.

    Groups are joined by steps of at least ``similarity``. Rows are told apart by doc_id and text, so rows with one doc_id
    and different texts stay unless they have a near copy; of rows with one doc_id and equal shingles one stays. Rows
    without a doc_id aren't compared. Null and blank texts are near copies of each other.
    """
    rows = written(marked(docs.where("doc_id is not null"), shingle), "shingled")
    parts = near_classes(rows, similarity, shingle)
    key = F.col("row.doc_id").cast("long")
    ids = written(rows.groupBy("class").agg(F.min(key).alias("id"), F.count("*").alias("n")).join(parts, "class", "left"), "classes")
    groups = ids.groupBy(F.coalesce("component", "class").alias("component")).agg(F.min(F.struct("id", "class")).alias("kept"))
    kept = groups.select("kept.id", "kept.class")
    # the only row of a class without links stays as it is read; the others are looked up
    split = flagged(rows.select("row", key.alias("id"), "class"), "class", ids.where("n > 1 or component is not null").select("class"))
    asked = split.where("asked").join(kept, ["id", "class"], "left_semi").dropDuplicates(["id", "class"])
    stay = split.where("not asked").select("row").unionByName(asked.select("row"))
    return stay.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns]).unionByName(docs.where("doc_id is null"))
