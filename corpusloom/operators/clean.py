"""Segments: from pages or lines, normalised, without repeated page headers and footers, flattened."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import collapse, lines_of, page_text, strip


def pages_to_segments(pages: DataFrame) -> DataFrame:
    """(page_id, seg_no, text): the non-blank lines of raw HTML pages."""
    parts = F.transform(F.split(page_text(F.col("html")), "\n"), collapse)
    return pages.select("page_id", F.posexplode(F.filter(parts, lambda x: x != "")).alias("seg_no", "text"))


def coalesce_ocr(native: DataFrame, ocr: DataFrame) -> DataFrame:
    """(file_id, page, text, source_type): native text of a page, or the recognised text where it is blank."""
    blank = strip(F.coalesce("text", F.lit(""))) == ""
    found = native.join(ocr.withColumnRenamed("text", "ocr_text"), ["file_id", "page"], "left")
    use = blank & (strip(F.coalesce("ocr_text", F.lit(""))) != "")
    return found.select("file_id", "page", F.when(use, F.col("ocr_text")).otherwise(F.coalesce("text", F.lit(""))).alias("text"), F.when(use, "pdf_ocr").otherwise("pdf_text").alias("source_type"))


def table_rows_to_segments(cells: DataFrame) -> DataFrame:
    """(file_id, row_no, text): a table row's cells, trimmed, blank and repeated ones dropped, joined by ' | '."""
    ordered = F.array_sort(F.collect_list(F.struct("col_no", strip("text").alias("text"))))
    joined = F.array_join(F.array_distinct(F.filter(F.transform(ordered, lambda x: x["text"]), lambda t: t != "")), " | ")
    return cells.groupBy("file_id", "row_no").agg(joined.alias("text")).where("text <> ''")


def normalize(segments: DataFrame) -> DataFrame:
    """Adds ``lines`` and drops segments without any. The generator keeps the filter from splitting every text again."""
    return segments.select("*", F.explode(F.array(lines_of(F.col("text")))).alias("lines")).where(F.size("lines") > 0)


def drop_repeated_edges(segments: DataFrame) -> DataFrame:
    """Takes first (last) lines that begin (end) two or more pages of a file off all its segments, unless nothing is left.

    ``segments`` has ``lines``; segments without a page count for nothing but lose such lines as well. A file's
    repeated lines are joined back as two small sets, so no file's text is gathered.
    """
    first, last = F.element_at("lines", 1), F.element_at("lines", -1)
    ends = F.array(F.struct(F.lit(True).alias("top"), first.alias("line")), F.struct(F.lit(False).alias("top"), last.alias("line")))
    paged = segments.where("page_start is not null").select("file_id", F.inline(ends))
    repeated = paged.groupBy("file_id", "top", "line").count().where("count >= 2")
    sets = repeated.groupBy("file_id").agg(F.collect_list(F.when(F.col("top"), F.col("line"))).alias("headers"), F.collect_list(F.when(~F.col("top"), F.col("line"))).alias("footers"))
    out = segments.join(sets, "file_id", "left")
    out = out.withColumn("kept", F.when(F.array_contains("headers", first), F.expr("slice(lines, 2, greatest(size(lines) - 1, 0))")).otherwise(F.col("lines")))
    end = F.when(F.size("kept") > 0, F.element_at("kept", -1))
    out = out.withColumn("kept", F.when(F.array_contains("footers", end), F.expr("slice(kept, 1, greatest(size(kept) - 1, 0))")).otherwise(F.col("kept")))
    return out.withColumn("lines", F.when(F.size("kept") > 0, F.col("kept")).otherwise(F.col("lines"))).drop("headers", "footers", "kept")


def flatten(segments: DataFrame) -> DataFrame:
    """Lines as one text; empty segments go."""
    return segments.withColumn("text", collapse(F.array_join("lines", " "))).drop("lines").where("text <> ''")


def clean_segments(segments: DataFrame) -> DataFrame:
    """Normalised segments without repeated edges, as texts. Segments are placed by file once; the repeated lines, their join
    and a later numbering within files use that placement. A file is an upload of bounded size."""
    return flatten(drop_repeated_edges(normalize(segments.repartition("file_id"))))


