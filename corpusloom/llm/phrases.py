"""Phrase collocations by dynamic itemset counting.

The corpus is dealt into shards that are scanned in a cycle. A phrase of k + 1 words becomes active as soon as both of
its phrases of k words have reached the threshold, is counted from the next shard on, and is done after one full cycle;
lengths interleave, so several are counted in one scan.

The scans read shards of 64-bit word hashes and count phrase hashes, so a count is never too small and no phrase is lost; what is
active is told to tasks by two bitmaps of bounded size. A last scan counts the words and phrases found by their words: a hash
or a bit that two phrases share costs work, never a wrong count. Tasks send these counts packed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.arrow_text import LOWER, U64, column, mix, prefix_sums, span_hash, utf8
from corpusloom.llm.shared import new_path, written

LEAST = 100
LONGEST = 5
TOP = 2000
#: Shards of a cycle.
SHARDS = 2
#: Bits of a bitmap for each phrase that has reached the threshold, at least, and at most (16 MB).
FILL, LEAST_BITS, MOST_BITS = 64, 1 << 15, 1 << 27
#: Bytes that a task looks at together, and counts that it holds before it sums and sends them.
BLOCK, HELD = 1 << 20, 1 << 21
#: Phrases for which there is one part of the last counts.
EACH = 50_000
#: Groups that a language's phrases are ranked in before the groups' best are ranked together.
RANKS = 64
#: Fixed values of the contract: characters that part pieces, and those that part words.
PIECE = np.isin(np.arange(256), [*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D])
BETWEEN = PIECE | np.isin(np.arange(256), [0x20, 0x09])
COUNTS = "h long, c int"
#: Shifts of a hash to its two places in a bitmap.
PROBES = (3, 31)
_STEP = U64(0x9FB21C651E98DF25)


def blocks(offsets: np.ndarray, data: np.ndarray, most: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of the texts, cut between words: (which words are new, their starts, ends and rows). A part begins with the
    last LONGEST - 1 words of the part before, so that no phrase is lost at a cut."""
    n = len(data)
    inside = ~BETWEEN[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + most, "right")))
        begin = max(0, at - LONGEST + 1)
        yield np.arange(begin, stop) >= at, starts[begin:stop], ends[begin:stop], np.searchsorted(offsets, starts[begin:stop], "right") - 1
        at = stop


class Bits:
    """A bitmap of phrase hashes, two bits for each: chunks of 32,768 bits by their number."""

    def __init__(self, chunks: dict[int, bytes], size: int):
        self.size = size
        self.bytes = np.zeros(max(1, size // 8), np.uint8)
        for at, chunk in chunks.items():
            part = np.frombuffer(chunk, np.uint8)[: len(self.bytes) - at * 4096]
            self.bytes[at * 4096 : at * 4096 + len(part)] = part

    def has(self, h: np.ndarray) -> np.ndarray:
        return np.logical_and(*(self._set((h >> U64(shift)) & U64(self.size - 1)) for shift in PROBES))

    def _set(self, at: np.ndarray) -> np.ndarray:
        return (self.bytes[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8) & 1).astype(bool)


def tagged(h: np.ndarray, k: int) -> np.ndarray:
    """A phrase's hash with its number of words in the last three bits."""
    return (h & ~U64(7)) | U64(k)


class Words:
    """The words of a block: hashes that tell languages apart, and which words go on a piece."""

    def __init__(self, lang: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray):
        low = starts[0]
        self.part, self.starts, self.ends = data[low : ends[-1]], starts - low, ends - low
        self.hash = tagged(mix(span_hash(prefix_sums(self.part), self.starts, self.ends) + lang[row]), 1)
        marks = np.concatenate([[0], np.cumsum(PIECE[self.part])])
        self.joined = (row[1:] == row[:-1]) & (marks[self.starts[1:]] == marks[self.ends[:-1]])

    def strings(self) -> pa.Array:
        used = np.zeros(len(self.part) + 1, np.int8)
        used[self.starts] += 1
        used[self.ends] -= 1
        text = self.part[np.cumsum(used[:-1], dtype=np.int8) > 0]
        lengths = np.concatenate([[0], np.cumsum(self.ends - self.starts)]).astype(np.int64)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(lengths), pa.py_buffer(text)])


def _lang_hashes(lang: pa.Array) -> np.ndarray:
    coded = lang.dictionary_encode()
    return np.array([xxhash.xxh64_intdigest(x.encode(), seed=1) for x in coded.dictionary.to_pylist()], U64)[coded.indices.to_numpy()]


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    offsets, data = utf8(column(batch, "text"))
    return offsets - offsets[0], LOWER[data[offsets[0] : offsets[-1]]]


def encode(text: DataFrame) -> DataFrame:
    """(words, joined, old): blocks of word hashes, bits for the words that go on a piece, and how many words repeat the block before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = _texts(batch)
            lang = _lang_hashes(column(batch, "lang"))
            out = []
            for fresh, starts, ends, row in blocks(offsets, data):
                w = Words(lang, data, starts, ends, row)
                out.append((w.hash.tobytes(), np.packbits(w.joined).tobytes(), int((~fresh).sum())))
            yield pa.RecordBatch.from_pylist([dict(zip(("words", "joined", "old"), r, strict=True)) for r in out], pa.schema([("words", pa.binary()), ("joined", pa.binary()), ("old", pa.int32())]))

    return text.mapInArrow(run, "words binary, joined binary, old int")


def windows(word: np.ndarray, joined: np.ndarray, old: int, k: int, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all runs of k words, which of them lie in a piece and end in a new word), from the hashes for k - 1."""
    n = len(whole) - 1
    fits = np.logical_and.reduce([joined[i : i + n] for i in range(k - 1)])
    fits[: max(0, old - k + 1)] = False
    return tagged(mix(whole[:-1] * _STEP + word[k - 1 :]), k), fits


def active(word: np.ndarray, joined: np.ndarray, old: int, words_too: bool, reached: Bits | None, recent: Bits | None) -> Iterator[np.ndarray]:
    """Hashes of the occurrences of active phrases: both parts have reached the threshold, one of them within the last cycle."""
    if words_too:
        yield word[old:]
    if reached is None:
        return
    whole, ok, new = word, reached.has(word), recent.has(word)
    for k in range(2, LONGEST + 1):
        if len(whole) < 2:
            return
        longer, fits = windows(word, joined, old, k, whole)
        yield longer[fits & ok[:-1] & ok[1:] & (new[:-1] | new[1:])]
        whole, ok, new = longer, reached.has(longer), recent.has(longer)


def count_shard(shard: DataFrame, words_too: bool, reached: Bits | None, recent: Bits | None) -> DataFrame:
    """(h, c): counts of a shard's active phrases, summed within tasks."""
    shared = shard.sparkSession.sparkContext.broadcast((reached, recent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached, recent = shared.value
        held: list[np.ndarray] = []
        size = 0

        def sent() -> Iterator[pa.RecordBatch]:
            if held:
                h, c = np.unique(np.concatenate(held), return_counts=True)
                yield from pa.table({"h": pa.array(h.view(np.int64)), "c": pa.array(c.astype(np.int32))}).to_batches(1 << 17)

        for batch in batches:
            for words, joined, old in zip(batch.column("words"), batch.column("joined"), batch.column("old").to_pylist(), strict=True):
                word = np.frombuffer(words.as_buffer(), U64)
                bits = np.unpackbits(np.frombuffer(joined.as_buffer(), np.uint8), count=len(word) - 1).astype(bool)
                for h in active(word, bits, old, words_too, reached, recent):
                    held.append(h)
                    size += len(h)
                if size > HELD:
                    yield from sent()
                    held, size = [], 0
        yield from sent()

    return shard.mapInArrow(run, COUNTS)


def _summed(counts: list[pa.Table]) -> pa.Table:
    """One row for each phrase, told apart by its bytes."""
    whole = pa.concat_tables(counts).group_by(["lang", "phrase", "k"], use_threads=False).aggregate([("f", "sum")])
    return whole.rename_columns(["lang", "phrase", "k", "f"]).combine_chunks()


def packed(counts: pa.Table, parts: int) -> Iterator[tuple[int, bytes]]:
    """(part, compressed table) of the counts, dealt by the hash of language and phrase."""
    found = []
    for batch in counts.to_batches(1 << 16):
        offsets, data = utf8(batch.column("phrase").cast(pa.large_string()))
        low, offsets = offsets[0], offsets - offsets[0]
        h = span_hash(prefix_sums(data[low : low + offsets[-1]]), offsets[:-1], offsets[1:]) + _lang_hashes(batch.column("lang"))
        found.append((mix(h) % U64(parts)).astype(np.int64))
    part = np.concatenate(found)
    order = np.argsort(part, kind="stable")
    counts, cut = counts.take(pa.array(order)).combine_chunks(), np.searchsorted(part[order], np.arange(parts + 1))
    for at in np.flatnonzero(np.diff(cut)).tolist():
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, counts.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_table(counts.slice(cut[at], cut[at + 1] - cut[at]))
        yield at, out.getvalue().to_pybytes()


def count_words(text: DataFrame, found: Bits, parts: int, least: int) -> DataFrame:
    """(lang, phrase, k, f): exact counts, of ``least`` or more, of the words and phrases that have their hash in ``found``, with
    every language's number of words as k = 0. A task's counts go to the ``parts`` as compressed tables: no phrase of a task is a row."""
    shared = text.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        held: list[pa.Table] = []

        def sent() -> Iterator[pa.RecordBatch]:
            for at, counts in packed(_summed(held), parts) if held else ():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([counts], pa.binary())], names=["part", "counts"])

        def table(lang: pa.Array, row: np.ndarray, phrase: pa.Array, k: int, f: np.ndarray) -> pa.Table:
            return _summed([pa.table({"lang": lang.take(pa.array(row)), "phrase": phrase, "k": pa.array(np.full(len(row), k, np.int32)), "f": pa.array(f.astype(np.int64))})])

        for batch in batches:
            offsets, data = _texts(batch)
            lang, seeds = column(batch, "lang"), _lang_hashes(column(batch, "lang"))
            kinds = lang.dictionary_encode().indices.to_numpy()
            for fresh, starts, ends, row in blocks(offsets, data):
                w, old = Words(seeds, data, starts, ends, row), int((~fresh).sum())
                strings, ok = w.strings(), found.has(w.hash)
                rows, n = np.unique(row[old:], return_counts=True)
                held.append(table(lang, rows, pa.array([b""] * len(rows), pa.large_binary()), 0, n))
                at = np.flatnonzero(ok & fresh)
                coded = strings.take(pa.array(at)).dictionary_encode()  # by their bytes, not by their hashes
                own = kinds[row[at]].astype(np.int64) * (len(coded.dictionary) + 1) + coded.indices.to_numpy()
                _, first, n = np.unique(own, return_index=True, return_counts=True)
                held.append(table(lang, row[at[first]], strings.take(pa.array(at[first])), 1, n))
                whole = w.hash
                for k in range(2, LONGEST + 1):
                    if len(whole) < 2:
                        break
                    whole, fits = windows(w.hash, w.joined, old, k, whole)
                    ok = ok[:-1] & ok[1:] & found.has(whole)  # a phrase is there only if both its parts are
                    at = np.flatnonzero(fits & ok)
                    if len(at):
                        spans = [strings.take(pa.array(at + i)) for i in range(k)]
                        held.append(table(lang, row[at], pc.binary_join_element_wise(*spans, pa.scalar(b" ", pa.large_binary())), k, np.ones(len(at))))
            if sum(map(len, held)) > HELD:
                held = [_summed(held)]
                if len(held[0]) > HELD // 2:
                    yield from sent()
                    held = []
        yield from sent()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size, most = 0, HELD
        for batch in batches:
            for counts in batch.column("counts"):
                held.append(pa.ipc.open_stream(counts.as_buffer()).read_all())
                size += len(held[-1])
                if size > most:
                    held = [_summed(held)]
                    size = len(held[0])
                    most = max(HELD, 2 * size)
        if held:
            whole = _summed(held)
            whole = whole.filter(pc.or_(pc.greater_equal(whole["f"], least), pc.equal(whole["k"], 0)))
            yield from whole.set_column(1, "phrase", whole["phrase"].cast(pa.large_string())).to_batches(1 << 16)

    # all counts of a phrase are in one part, and a part is in one task
    return text.mapInArrow(run, "part int, counts binary").repartition(parts, "part").mapInArrow(total, "lang string, phrase string, k int, f long")


def bitmap(hashes: DataFrame, size: int) -> Bits:
    """The bits of the column h, gathered in chunks: ``size`` bits whatever the number of phrases."""
    places = F.array(*[F.shiftrightunsigned("h", shift).bitwiseAND(F.lit(size - 1)) for shift in PROBES])
    at = hashes.select(F.explode(places).alias("at"))
    chunks = at.groupBy(F.shiftright("at", 15).cast("int").alias("chunk")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(32767))).alias("bits"))
    return Bits({r["chunk"]: bytes(r["bits"]) for r in chunks.collect()}, size)


def frequent(text: DataFrame, least: int, shards: int) -> tuple[DataFrame | None, int]:
    """(h of every phrase that may occur ``least`` times or more, their number), by cyclic scans."""
    spark = text.sparkSession
    base = new_path(spark, "phrases")
    encode(text).withColumn("shard", F.pmod(F.xxhash64("words"), F.lit(shards)).cast("int")).write.partitionBy("shard").option("compression", "zstd").parquet(f"{base}/words")
    columns = "words binary, joined binary, old int"
    there = {r["shard"] for r in spark.read.schema(f"{columns}, shard int").parquet(f"{base}/words").select("shard").distinct().collect()}

    def tables(name: str, kind: str, steps: range) -> DataFrame:
        return spark.read.schema(kind).parquet(*[f"{base}/{name}/{t}" for t in steps])

    step, total, sizes, names = 0, 0, [], []
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    while step < shards or any(sizes[max(0, step - shards) :]):
        size = bits_for(total)
        reached = bitmap(tables("reached", "h long", range(step)), size) if total else None
        recent = bitmap(tables("reached", "h long", range(max(0, step - shards), step)), size) if total else None
        shard = step % shards
        here = spark.read.schema(columns).parquet(f"{base}/words/shard={shard}") if shard in there else spark.createDataFrame([], columns)
        # a step's counts are dealt by hash once and stored so; steps meet without another shuffle
        counts = count_shard(here, step < shards, reached, recent).groupBy("h").agg(F.sum("c").alias("c"))
        names.append(f"phrases_{uuid.uuid4().hex}")
        counts.write.option("path", f"{base}/facts/{step}").option("compression", "zstd").bucketBy(buckets, "h").sortBy("h").saveAsTable(names[-1])
        # the last ``shards`` steps have met every shard once; only what this step has counted can reach the threshold now
        now = spark.table(names[-1])
        for before in names[max(0, step - shards + 1) : -1]:
            earlier = spark.table(before).select("h", F.col("c").alias("before"))
            now = now.join(earlier, "h", "left").select("h", (F.col("c") + F.coalesce("before", F.lit(0))).alias("c"))
        sums = now.where(F.col("c") >= least).select("h")
        if total:
            sums = sums.join(tables("reached", "h long", range(step)), "h", "left_anti")
        sums.write.option("compression", "zstd").parquet(f"{base}/reached/{step}")
        new = tables("reached", "h long", range(step, step + 1)).agg(F.count("*").alias("n"), F.count_if(F.col("h").bitwiseAND(F.lit(7)) < LONGEST).alias("open")).first()
        total += new["n"]
        sizes.append(new["open"])
        step += 1
    for name in names:
        spark.sql(f"DROP TABLE {name}")  # the name in the catalog; the files are the shared folder's
    return (tables("reached", "h long", range(step)), total) if total else (None, 0)


def bits_for(phrases: int) -> int:
    size = LEAST_BITS
    while size < min(phrases * FILL, MOST_BITS):
        size *= 2
    return size


def count(docs: DataFrame, least: int = LEAST, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of every phrase of up to LONGEST words that occurs ``least`` times or more, and (lang, n)."""
    text = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found, total = frequent(text, least, shards)
    parts = max(text.sparkSession.sparkContext.defaultParallelism, -(-total // EACH))
    exact = written(count_words(text, bitmap(found, bits_for(total)) if total else Bits({}, LEAST_BITS), parts, least), "phrase-counts")
    return exact.where("k > 0"), exact.where("k = 0").select("lang", F.col("f").alias("n"))


def rank(counts: DataFrame, words: DataFrame, top: int = TOP, least: int = LEAST) -> DataFrame:
    """The best phrases of each language by the score of their weakest cut."""
    f = counts.select("lang", "phrase", "f")
    candidates = counts.where((F.col("k") > 1) & (F.col("f") >= least))
    # phrases inside a longer one that occurs as often
    parts = F.split("phrase", " ", -1)
    inner = [F.array_join(F.slice(parts, i + 1, m), " ") for m in range(2, LONGEST) for i in range(LONGEST - m + 1)]
    fits = [(F.lit(m) < F.col("k")) & (F.lit(i + m) <= F.col("k")) for m in range(2, LONGEST) for i in range(LONGEST - m + 1)]
    inside = candidates.where("k > 2").select("lang", "f", F.explode(F.array_distinct(F.array_compact(F.array(*[F.when(ok, part) for ok, part in zip(fits, inner, strict=True)])))).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = candidates.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("f")))
    cuts = kept.select("lang", "phrase", "f", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "f", "cut", F.expr("substring_index(phrase, ' ', cut)").alias("left"), F.expr("substr(phrase, length(substring_index(phrase, ' ', cut)) + 2)").alias("right"))
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(f.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cuts = cuts.join(words, "lang")
    score = F.expr("(cast(1000 * cast(f as decimal(15,0)) as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    scored = cuts.select("lang", "phrase", "f", "l", "r", "n", "cut", score.cast("long").alias("score")).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "f", "l", "r", "n")).alias("best"))
    scored = scored.select("lang", "phrase", F.col("best.f").alias("a"), "best.l", "best.r", "best.n", "best.score")

    def ranked(rows: DataFrame, by: list[str]) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    some = ranked(scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANKS))), ["lang", "part"]).drop("rank", "part")
    return ranked(some, ["lang"]).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP, shards: int = SHARDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to LONGEST words.

    A null lang counts as ``und``, a null text as empty; repeated rows count as often as they occur, ties go to the
    more frequent and then the smaller phrase. Languages without a phrase, and an empty table, give no rows. Other columns aren't read.
    """
    return rank(*count(docs, least, shards), top, least)
