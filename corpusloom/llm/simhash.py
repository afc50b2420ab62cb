"""SimHash near-duplicate detection by a binary trie self-join.

1. Every text gets a 64-bit fingerprint (majority of the bits of its shingles' XXH64, seed 42).
2. Equal fingerprints are one class, so a thousand copies are one leaf of the trie.
3. The trie is joined with itself: pairs of nodes go down together, a pair carries the bits in which its
   paths differ so far, and it is dropped once they are more than the radius. The first levels are
   DataFrame rows - a leaf is sent to each node pair at depth p that its prefix can take part in - and a
   node pair that holds too many leaves goes down further levels there, until it is small. The rest of
   the levels run in one vectorised traversal for each node pair.
4. A node pair returns a spanning forest of its links, never all pairs, and the forests' components
   are joined in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrow_text import column, utf8
from corpusloom.llm.components import connected_components
from corpusloom.llm.shared import written

RADIUS = 2
SHINGLE = 3
#: Leaves in a node pair beyond which it is split further before it goes to one task.
LEAVES = 4096
_BLOCK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of UTF-8 text; 0 without words; the whole word sequence if it is shorter than a shingle."""
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends, at = [], 0
    for w in found:
        at += len(w)
        ends.append(at)
        at += 1
    starts = [0, *(e + 1 for e in ends[:-1])]
    total, n = np.zeros(64, np.int64), len(found) - shingle + 1
    digest = xxhash.xxh64_digest
    for k in range(0, n, _BLOCK):
        raw = b"".join([digest(joined[a:b], 42) for a, b in zip(starts[k : min(n, k + _BLOCK)], ends[k + shingle - 1 : k + _BLOCK + shingle - 1], strict=False)])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        total += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id long, fp long) for every row. A null or blank text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(column(batch, "text"))
            raw = data.tobytes()
            found = np.array([fingerprint(raw[a:b], shingle) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def trie_pairs(a: np.ndarray, b: np.ndarray, radius: int, same: bool, leaf: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) of sorted distinct fingerprints with at most ``radius`` differing bits (i < j if ``same``).

    A frontier of node pairs goes down bit by bit; below ``leaf`` leaf pairs a node pair is compared outright.
    """
    lo_a, hi_a, lo_b, hi_b, diff = (np.array([x], np.int64) for x in (0, len(a), 0, len(b), 0))
    left, right = [], []
    for depth in range(65):
        small = (hi_a - lo_a) * (hi_b - lo_b) <= leaf if depth < 64 else np.ones(len(lo_a), bool)
        if small.any():
            na, nb = (hi_a - lo_a)[small], (hi_b - lo_b)[small]
            size = na * nb
            node = np.repeat(np.arange(len(size)), size)
            k = np.arange(len(node)) - np.repeat(np.cumsum(size) - size, size)
            i, j = lo_a[small][node] + k // nb[node], lo_b[small][node] + k % nb[node]
            ok = np.bitwise_count(a[i] ^ b[j]) <= radius
            if same:
                ok &= i < j
            left.append(i[ok])
            right.append(j[ok])
            lo_a, hi_a, lo_b, hi_b, diff = (x[~small] for x in (lo_a, hi_a, lo_b, hi_b, diff))
        if not len(lo_a):
            break
        shift = np.uint64(63 - depth)
        ones_a = np.concatenate([[0], np.cumsum((a >> shift) & np.uint64(1), dtype=np.int64)])
        ones_b = np.concatenate([[0], np.cumsum((b >> shift) & np.uint64(1), dtype=np.int64)])
        mid_a, mid_b = hi_a - (ones_a[hi_a] - ones_a[lo_a]), hi_b - (ones_b[hi_b] - ones_b[lo_b])
        own = np.full(len(lo_a), False) if not same else (lo_a == lo_b) & (hi_a == hi_b)
        kids = [(lo_a, mid_a, lo_b, mid_b, diff, None), (mid_a, hi_a, mid_b, hi_b, diff, None), (lo_a, mid_a, mid_b, hi_b, diff + 1, None), (mid_a, hi_a, lo_b, mid_b, diff + 1, ~own)]
        parts = []
        for la, ha, lb, hb, d, extra in kids:
            keep = (ha > la) & (hb > lb) & (d <= radius)
            if extra is not None:
                keep &= extra
            parts.append([x[keep] for x in (la, ha, lb, hb, d)])
        lo_a, hi_a, lo_b, hi_b, diff = (np.concatenate(x) for x in zip(*parts, strict=True))
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def forest(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the given links."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    out = []
    for x, y in zip(left.tolist(), right.tolist(), strict=True):
        p, q = top(x), top(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _spread(leaves: DataFrame, depth: int, step: int, radius: int) -> DataFrame:
    """Leaves (x, y, fp, rep) of node pairs at ``depth`` go to the node pairs ``step`` levels below.

    x <= y are the paths of the pair so far. A leaf lies below x, below y or below both.
    """
    masks = [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(step), k)]
    own = F.shiftrightunsigned("fp", 64 - depth - step)
    pairs = leaves.withColumn("p", own).withColumn("mask", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])))
    if depth:
        # the partner's path: the other end of the pair, continued by this leaf's next bits with the mask's changes
        prefix = F.shiftrightunsigned("fp", 64 - depth)
        other = F.when(prefix == F.col("x"), F.col("y")).otherwise(F.col("x"))
        low = own.bitwiseAND(F.lit((1 << step) - 1).cast("long")).bitwiseXOR(F.col("mask"))
        partner = F.shiftleft(other, step).bitwiseOR(low)
    else:
        partner = own.bitwiseXOR(F.col("mask"))
    pairs = pairs.withColumn("q", partner).where(F.bit_count(F.col("p").bitwiseXOR(F.col("q"))) <= radius)
    return pairs.select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"), "fp", "rep")


def hamming_links(classes: DataFrame, radius: int = RADIUS, leaves: int = LEAVES) -> DataFrame:
    """Classes (fp long, rep long), one row a fingerprint -> links (a, b) between reps that connect all classes
    whose fingerprints are joined by steps of at most ``radius`` bits. An empty table gives no rows."""
    n = classes.count()
    depth = 1
    while n >> depth > leaves // 4 and depth < 40:
        depth += 1
    rows = _spread(classes.select(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), "fp", "rep"), 0, depth, radius)
    found = None

    def run(group: pa.Table) -> pa.Table:
        fp = group.column("fp").to_numpy().view(np.uint64)
        rep = group.column("rep").to_numpy()
        x, y = group.column("x")[0].as_py(), group.column("y")[0].as_py()
        at = group.column("depth")[0].as_py()
        order = np.argsort(fp, kind="stable")
        fp, rep = fp[order], rep[order]
        if x == y:
            i, j = trie_pairs(fp, fp, radius, True)
            links = forest(i, j)
            a, b = [rep[p] for p, _ in links], [rep[q] for _, q in links]
        else:
            below = (fp >> np.uint64(64 - at)) == np.uint64(x)
            (fa, ra), (fb, rb) = (fp[below], rep[below]), (fp[~below], rep[~below])
            i, j = trie_pairs(fa, fb, radius, False)
            links = forest(i, j + len(fa))
            a, b = [ra[p] for p, _ in links], [rb[q - len(fa)] for _, q in links]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    while True:
        here = rows.withColumn("depth", F.lit(depth))
        step = min(6, 62 - depth)
        size = here.groupBy("x", "y").count()
        hot = written(size.where(F.col("count") > leaves).select("x", "y"), "hot-nodes") if step > 0 else None
        split = hot is not None and not hot.isEmpty()
        cold = here.join(hot, ["x", "y"], "left_anti") if split else here
        part = cold.groupBy("x", "y").applyInArrow(run, "a long, b long")
        found = part if found is None else found.unionByName(part)
        if not split:
            return found
        rows = written(_spread(here.join(hot, ["x", "y"], "left_semi").select("x", "y", "fp", "rep"), depth, step, radius), "node-pairs")
        depth += step


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, leaves: int = LEAVES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    fingerprint is 16 lowercase hex digits; component_id is the least doc_id that can be reached by steps of at
    most ``radius`` differing bits. Null and blank texts share fingerprint 0 and are linked like any other. A
    null doc_id keeps its row and gets its class's id. Repeated rows stay repeated.
    """
    prints = written(fingerprints(docs, shingle, text, key), "fingerprints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    parts = connected_components(hamming_links(classes.where("rep is not null"), radius, leaves))
    named = classes.join(parts, classes["rep"] == parts["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
