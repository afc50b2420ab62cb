"""Overlapping small chunks, packed large chunks, rows of the chunk table and ingest counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import strip


def small_chunks(segments: DataFrame, size: int = 700, overlap: int = 120) -> DataFrame:
    """(file_id, seg_no, page_start, page_end, source_type, small_chunk_index, small_chunk_text), numbered through a file.

    Windows explode inside their row; numbering is one window over short rows of a file."""
    step = max(1, size - overlap)
    text = strip("text")
    n = F.when(F.length(text) <= size, 1).otherwise(1 + F.ceil((F.length(text) - size) / F.lit(step)))
    rows = segments.where(text != "").select("file_id", "seg_no", "page_start", "page_end", "source_type", text.alias("text"), F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("w"))
    rows = rows.withColumn("small_chunk_text", strip(F.substring("text", F.col("w") * step + 1, F.lit(size)))).where("small_chunk_text <> ''")
    number = F.row_number().over(Window.partitionBy("file_id").orderBy("seg_no", "w")) - 1
    return rows.select("file_id", "seg_no", "page_start", "page_end", "source_type", number.alias("small_chunk_index"), "small_chunk_text")


def greedy_groups(lengths: Column, limit: int) -> Column:
    """Group number of each length: a group takes the next one while its sum stays within ``limit``. The fold keeps the
    sizes of closed groups and the open one's size and sum."""
    start = F.struct(F.array().cast("array<int>").alias("closed"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("sum"))

    def add(acc: Column, n: Column) -> Column:
        new = (acc["n"] > 0) & (acc["sum"] + n > limit)
        closed = F.when(new, F.concat(acc["closed"], F.array(acc["n"]))).otherwise(acc["closed"])
        return F.struct(closed.alias("closed"), F.when(new, 1).otherwise(acc["n"] + 1).alias("n"), F.when(new, n.cast("long")).otherwise(acc["sum"] + n).alias("sum"))

    sizes = F.aggregate(lengths, start, add, lambda a: F.concat(a["closed"], F.array(a["n"])))
    return F.flatten(F.transform(sizes, lambda n, g: F.array_repeat(g, n)))


def large_groups(chunks: DataFrame, large: int = 2100) -> DataFrame:
    """Adds large_no. A file's fold holds its chunk lengths, never its text; all steps share one placement by file."""
    item = F.struct("small_chunk_index", F.length("small_chunk_text").alias("n"))
    files = chunks.groupBy("file_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    files = files.select("file_id", greedy_groups(F.transform("items", lambda x: x["n"]), large).alias("groups"))
    at = F.row_number().over(Window.partitionBy("file_id").orderBy("small_chunk_index")) - 1
    return chunks.withColumn("at", at).join(files, "file_id").withColumn("large_no", F.get("groups", F.col("at"))).drop("at", "groups")


def pack_large(chunks: DataFrame, large: int = 2100) -> DataFrame:
    """Adds large_chunk_id and large_chunk_text (the group's texts one after the other, overlaps included)."""
    group = F.collect_list("small_chunk_text").over(Window.partitionBy("file_id", "large_no").orderBy("small_chunk_index").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = large_groups(chunks, large).withColumn("large_chunk_text", F.array_join(group, ""))
    return rows.withColumn("large_chunk_id", F.concat(F.lit("large-"), F.col("large_no").cast("string"))).drop("large_no")


def chunk_rows(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of the chunk table: id file:index, missing pages as 0, the file's metadata."""
    meta = files.select("file_id", "user_id", "file_name", "file_ext", "mime_type", "created_epoch")
    rows = chunks.withColumn("page_start", F.coalesce("page_start", F.lit(0))).withColumn("page_end", F.coalesce("page_end", F.lit(0)))
    return rows.join(meta, "file_id").withColumn("id", F.concat_ws(":", F.col("file_id").cast("string"), F.col("small_chunk_index").cast("string")))


def image_rows(files: DataFrame) -> DataFrame:
    """One row for each png file; with ``content`` also its data URL."""
    out = files.where("file_ext = 'png'").withColumn("id", F.concat(F.col("file_id").cast("string"), F.lit(":image:0"))).withColumn("image_index", F.lit(0)).withColumn("source_type", F.lit("image"))
    if "content" in files.columns:
        out = out.withColumn("data_url", F.concat(F.lit("data:image/png;base64,"), F.base64("content")))
    return out


def ingest_counts(files: DataFrame, text_rows: DataFrame, images: DataFrame) -> DataFrame:
    """(file_id, text_chunk_count, image_chunk_count, chunk_count, error) for every file."""
    text = text_rows.groupBy("file_id").agg(F.count("*").alias("t"))
    image = images.groupBy("file_id").agg(F.count("*").alias("i"))
    out = files.select("file_id").join(text, "file_id", "left").join(image, "file_id", "left")
    t, i = F.coalesce("t", F.lit(0)), F.coalesce("i", F.lit(0))
    return out.select("file_id", t.alias("text_chunk_count"), i.alias("image_chunk_count"), (t + i).alias("chunk_count"), F.when(t + i == 0, "No text content extracted").alias("error"))
