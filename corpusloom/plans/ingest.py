"""Registered queries of the ingest pipeline, with DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import vectors as vec
from corpusloom.operators import chunk, clean
from corpusloom.plans import views as v
from corpusloom.plans.views import sql


def html_segments(spark, d):
    return clean.pages_to_segments(v.table(spark, d, "pages")).withColumn("seg_no", F.col("seg_no").cast("long"))


def ocr_coalesce(spark, d):
    rows = v.lines(spark, d)
    native = rows.select("file_id", F.col("line_no").alias("page"), F.when(F.col("line_no") % 3 == 0, " \n\t").otherwise(F.col("line")).alias("text"))
    ocr = rows.where("line_no % 2 = 0").select("file_id", F.col("line_no").alias("page"), F.concat(F.lit("ocr "), F.col("line")).alias("text"))
    return clean.coalesce_ocr(native, ocr)


def table_row_segments(spark, d):
    cells = v.lines(spark, d).where("contains(line, '|')").select("file_id", F.col("line_no").alias("row_no"), F.posexplode(F.split("line", "\\|")).alias("col_no", "text")).withColumn("text", F.when(F.col("col_no") % 2 == 1, F.concat(F.lit("\t"), "text", F.lit("\n\u3000"))).otherwise(F.col("text")))
    return clean.table_rows_to_segments(cells)


def normalize_segments(spark, d):
    return clean.normalize(v.segments(spark, d)).select("file_id", "seg_no", F.array_join("lines", "\n").alias("text"))


def header_footer(spark, d):
    return clean.drop_repeated_edges(clean.normalize(v.segments(spark, d))).select("file_id", "seg_no", F.array_join("lines", "\n").alias("text"))


def clean_segments(spark, d):
    return clean.clean_segments(v.segments(spark, d)).select("file_id", "seg_no", "page_start", "text")


def chunk_documents(spark, d):
    return v.chunks(spark, d).select("id", "file_id", "small_chunk_index", "small_chunk_text", "page_start", "page_end", "source_type", "file_name", "created_epoch")


def pack_large(spark, d):
    return chunk.pack_large(chunk.small_chunks(clean.clean_segments(v.segments(spark, d)))).select("file_id", "small_chunk_index", "large_chunk_id", F.md5("large_chunk_text").alias("large_md5"))


def ingest_counts(spark, d):
    files = v.files(spark, d)
    return chunk.ingest_counts(files, v.chunks(spark, d), chunk.image_rows(files))


def image_rows(spark, d):
    return chunk.image_rows(v.files(spark, d)).select("id", "file_id", "image_index", "source_type", "mime_type")


def l2_normalize(spark, d):
    unit = vec.l2_normalize(vec.truncate(F.col("embedding"), 48))
    return v.chunk_vectors(spark, d).select("file_id", "small_chunk_index", F.round(F.element_at(unit, 1), 6).alias("first"), F.round(F.element_at(unit, 48), 6).alias("last"), F.round(vec.norm(unit), 6).alias("norm"))


def cosine_pairs(spark, d):
    a = v.chunk_vectors(spark, d)
    b = a.select("file_id", F.col("small_chunk_index").alias("other"), F.col("embedding").alias("e2"))
    pairs = a.join(b, "file_id").where("small_chunk_index < other").withColumn("distance", vec.cosine_distance(F.col("embedding"), F.col("e2")))
    return pairs.select("file_id", "small_chunk_index", "other", F.round("distance", 6).alias("distance"), F.round(vec.similarity(F.col("distance")), 6).alias("similarity"))


def vector_quality(spark, d):
    bad = vec.problem(F.col("embedding"), 64)
    return v.chunk_vectors(spark, d).groupBy(F.coalesce(bad, F.lit("ok")).alias("problem")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (html_segments, ocr_coalesce, table_row_segments, normalize_segments, header_footer, clean_segments, chunk_documents, pack_large, ingest_counts, image_rows, l2_normalize, cosine_pairs, vector_quality)}

_PACK = """SELECT c.file_id, c.small_chunk_index, 'large-' || c.g AS large_chunk_id, md5(t.large) AS large_md5 FROM (SELECT s.file_id, s.small_chunk_index, p.g FROM small s JOIN packed p USING (file_id, small_chunk_index)) c
    JOIN (SELECT s.file_id, p.g, string_agg(small_chunk_text, '' ORDER BY s.small_chunk_index) AS large FROM small s JOIN packed p USING (file_id, small_chunk_index) GROUP BY s.file_id, p.g) t ON c.file_id = t.file_id AND c.g = t.g"""
_PACKED = """SELECT file_id, small_chunk_index, 0 AS g, length(small_chunk_text) AS total FROM small WHERE small_chunk_index = 0
    UNION ALL SELECT s.file_id, s.small_chunk_index, CASE WHEN p.total + length(s.small_chunk_text) <= 2100 THEN p.g ELSE p.g + 1 END, CASE WHEN p.total + length(s.small_chunk_text) <= 2100 THEN p.total + length(s.small_chunk_text) ELSE length(s.small_chunk_text) END
    FROM packed p JOIN small s ON s.file_id = p.file_id AND s.small_chunk_index = p.small_chunk_index + 1"""
_NORM = "sqrt(list_sum(list_transform(e, lambda x: x * x)))"

ORACLES = {
    "html_segments": r"""SELECT page_id, CAST(k AS BIGINT) AS seg_no, l[k + 1] AS text FROM (SELECT page_id, list_filter(list_transform(string_split(CASE WHEN contains(t, '<') AND contains(t, '>') THEN regexp_replace(t, '<[^>]+>', ' ', 'g') ELSE t END, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS l
        FROM (SELECT page_id, regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->', ' ', 'g') AS t FROM pages)), LATERAL (SELECT unnest(range(len(l))) AS k)""",
    "ocr_coalesce": sql("""SELECT file_id, line_no AS page, CASE WHEN b AND trim(ocr) <> '' THEN ocr ELSE t END AS text, CASE WHEN b AND trim(ocr) <> '' THEN 'pdf_ocr' ELSE 'pdf_text' END AS source_type FROM
        (SELECT *, trim(t, ' ' || chr(10) || chr(9)) = '' AS b, CASE WHEN line_no % 2 = 0 THEN 'ocr ' || line ELSE '' END AS ocr FROM (SELECT *, CASE WHEN line_no % 3 = 0 THEN ' ' || chr(10) || chr(9) ELSE line END AS t FROM lines))""", "lines"),
    "table_row_segments": sql("""SELECT file_id, line_no AS row_no, text FROM (SELECT file_id, line_no, array_to_string(list_filter(p, lambda x, i: x <> '' AND list_position(p, x) = i), ' | ') AS text
        FROM (SELECT file_id, line_no, list_transform(string_split(line, '|'), lambda x: trim(x)) AS p FROM lines WHERE contains(line, '|'))) WHERE text <> ''""", "lines"),
    "normalize_segments": sql("SELECT file_id, seg_no, array_to_string(l, chr(10)) AS text FROM normal", "normal"),
    "header_footer": sql("SELECT file_id, seg_no, array_to_string(l, chr(10)) AS text FROM trimmed", "trimmed"),
    "clean_segments": sql("SELECT file_id, seg_no, page_start, text FROM cleaned", "cleaned"),
    "chunk_documents": sql("SELECT id, file_id, small_chunk_index, small_chunk_text, page_start, page_end, source_type, file_name, created_epoch FROM chunks", "chunks"),
    "pack_large": sql(_PACK, "small", recursive=True, packed=_PACKED),
    "ingest_counts": sql("""SELECT f.file_id, coalesce(t, 0) AS text_chunk_count, coalesce(i, 0) AS image_chunk_count, coalesce(t, 0) + coalesce(i, 0) AS chunk_count, CASE WHEN coalesce(t, 0) + coalesce(i, 0) = 0 THEN 'No text content extracted' END AS error
        FROM files f LEFT JOIN (SELECT file_id, count(*) AS t FROM chunks GROUP BY file_id) c USING (file_id) LEFT JOIN (SELECT file_id, 1 AS i FROM files WHERE file_ext = 'png') p USING (file_id)""", "chunks"),
    "image_rows": sql("SELECT file_id || ':image:0' AS id, file_id, 0 AS image_index, 'image' AS source_type, mime_type FROM files WHERE file_ext = 'png'", "files"),
    "l2_normalize": sql(f"SELECT file_id, small_chunk_index, round(e[1] / {_NORM}, 6) AS first, round(e[48] / {_NORM}, 6) AS last, 1.0::DOUBLE AS norm FROM (SELECT *, embedding[1:48] AS e FROM chunk_vectors)", "chunk_vectors"),
    "cosine_pairs": sql("""SELECT a.file_id, a.small_chunk_index, b.small_chunk_index AS other, round(1 - list_cosine_similarity(a.embedding, b.embedding), 6) AS distance, round(greatest(0, least(1, list_cosine_similarity(a.embedding, b.embedding))), 6) AS similarity
        FROM chunk_vectors a JOIN chunk_vectors b ON a.file_id = b.file_id AND a.small_chunk_index < b.small_chunk_index""", "chunk_vectors"),
    "vector_quality": sql("SELECT CASE WHEN embedding IS NULL THEN 'missing' WHEN len(embedding) <> 64 THEN 'dimension' WHEN len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 THEN 'not finite' ELSE 'ok' END AS problem, count(*) AS n FROM chunk_vectors GROUP BY 1", "chunk_vectors"),
}
