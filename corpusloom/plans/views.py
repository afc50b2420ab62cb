"""Model tables over the driver's tables, once as Spark DataFrames and once as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import chunk, clean

DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    ext = F.when(k == 1, "docx").when(k == 2, "png").otherwise("pdf")
    status = F.when(F.col("n_chars") < 200, "FAILED").when(F.col("doc_id") % 17 == 0, "PENDING").otherwise("VECTORIZED")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("file_id"), F.col("source").alias("user_id"), ext.alias("file_ext"),
        F.concat(F.concat_ws("_", "lang", "source", F.col("doc_id").cast("string")), F.lit("."), ext).alias("file_name"),
        F.when(ext == "docx", DOCX).when(ext == "png", "image/png").otherwise("application/pdf").alias("mime_type"),
        F.col("n_chars").alias("file_size"), status.alias("text_vector_status"), (F.lit(1704067200) + 3600 * F.col("doc_id")).cast("long").alias("created_epoch"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_segments(table(spark, sf_dir, "documents"))


def cut_segments(documents: DataFrame) -> DataFrame:
    """Three lines a page, cut inside the document's row; docx files have no pages."""
    docs = documents.select(F.col("doc_id").alias("file_id"), F.split("text", "\n").alias("l"))
    starts = F.transform(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / 3).cast("int")), lambda i: F.array_join(F.slice(F.col("l"), i * 3 + 1, F.lit(3)), "\n"))
    page = F.when(F.col("file_id") % 4 != 1, F.col("seg_no") + 1)
    return docs.select("file_id", F.posexplode(starts).alias("seg_no", "text")).select("file_id", "seg_no", "text", page.alias("page_start"), page.alias("page_end"), F.lit("text").alias("source_type"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.chunk_rows(chunk.small_chunks(clean.clean_segments(segments(spark, sf_dir))), files(spark, sf_dir))


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 5").alias("file_id"), (F.col("vec_id") % 5).cast("int").alias("small_chunk_index"), F.col("embedding").cast("array<double>").alias("embedding"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.expr("vec_id div 5").alias("file_id"), F.col("embedding").cast("array<double>").alias("query_vector"))
    return q.join(files(spark, sf_dir).select("file_id", "user_id"), "file_id").drop("file_id")


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text", F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("user_id"))


#: Letters and the Chinese characters that stand for them in queries over mixed script; neighbours make words like 怎么 and 报告.
LETTERS, SCRIPT = "theanorids", "文件系统怎么报告的如"


def cjk(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ten letters of a column as Chinese characters."""
    return df.withColumn(column, F.translate(F.lower(column), LETTERS, SCRIPT))


#: White space as a DuckDB string, for trim.
WHITE = " || ".join(f"chr({ord(c)})" for c in text.WHITE)
#: DuckDB twins, in an order in which each may use those before it.
CTE = {
    "files": f"""SELECT doc_id AS file_id, source AS user_id, ext AS file_ext, lang || '_' || source || '_' || doc_id || '.' || ext AS file_name,
        CASE ext WHEN 'docx' THEN '{DOCX}' WHEN 'png' THEN 'image/png' ELSE 'application/pdf' END AS mime_type, n_chars AS file_size,
        CASE WHEN n_chars < 200 THEN 'FAILED' WHEN doc_id % 17 = 0 THEN 'PENDING' ELSE 'VECTORIZED' END AS text_vector_status, CAST(1704067200 + 3600 * doc_id AS BIGINT) AS created_epoch
        FROM (SELECT *, CASE doc_id % 4 WHEN 1 THEN 'docx' WHEN 2 THEN 'png' ELSE 'pdf' END AS ext FROM documents)""",
    "lines": "SELECT file_id, CAST(k AS INTEGER) AS line_no, l[k + 1] AS line FROM (SELECT doc_id AS file_id, string_split(text, chr(10)) AS l FROM documents), LATERAL (SELECT unnest(range(len(l))) AS k)",
    "segments": """SELECT file_id, seg_no, string_agg(line, chr(10) ORDER BY line_no) AS text, CASE WHEN file_id % 4 <> 1 THEN seg_no + 1 END AS page_start, CASE WHEN file_id % 4 <> 1 THEN seg_no + 1 END AS page_end, 'text' AS source_type
        FROM (SELECT *, CAST(line_no // 3 AS INTEGER) AS seg_no FROM lines) GROUP BY file_id, seg_no""",
    "normal": r"""SELECT * FROM (SELECT file_id, seg_no, page_start, page_end, source_type, list_filter(list_transform(string_split(CASE WHEN contains(t, '<') AND contains(t, '>') THEN regexp_replace(t, '<[^>]+>', ' ', 'g') ELSE t END, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS l
        FROM (SELECT *, replace(text, chr(12), chr(10)) AS t FROM segments)) WHERE len(l) > 0""",
    "headers": "SELECT file_id, l[1] AS h FROM normal WHERE page_start IS NOT NULL GROUP BY file_id, l[1] HAVING count(*) >= 2",
    "footers": "SELECT file_id, l[-1] AS f FROM normal WHERE page_start IS NOT NULL GROUP BY file_id, l[-1] HAVING count(*) >= 2",
    "trimmed": """SELECT file_id, seg_no, page_start, page_end, source_type, CASE WHEN len(b) > 0 THEN b ELSE l END AS l FROM
        (SELECT *, CASE WHEN len(a) > 0 AND EXISTS (SELECT 1 FROM footers f WHERE f.file_id = s.file_id AND f.f = s.a[-1]) THEN a[:-2] ELSE a END AS b FROM
        (SELECT n.*, CASE WHEN EXISTS (SELECT 1 FROM headers h WHERE h.file_id = n.file_id AND h.h = n.l[1]) THEN l[2:] ELSE l END AS a FROM normal n) s)""",
    "cleaned": r"SELECT * FROM (SELECT file_id, seg_no, page_start, page_end, source_type, trim(regexp_replace(array_to_string(l, ' '), '\s+', ' ', 'g')) AS text FROM trimmed) WHERE text <> ''",
    "small": """SELECT file_id, seg_no, page_start, page_end, source_type, CAST(row_number() OVER (PARTITION BY file_id ORDER BY seg_no, w) - 1 AS INTEGER) AS small_chunk_index, t AS small_chunk_text FROM
        (SELECT *, trim(substring(text, CAST(w * 580 + 1 AS BIGINT), 700)) AS t FROM cleaned, LATERAL (SELECT unnest(range(CASE WHEN length(text) <= 700 THEN 1 ELSE 1 + CAST(ceil((length(text) - 700) / 580.0) AS BIGINT) END)) AS w)) WHERE t <> ''""",
    "chunks": """SELECT s.file_id || ':' || s.small_chunk_index AS id, s.file_id, s.seg_no, coalesce(page_start, 0) AS page_start, coalesce(page_end, 0) AS page_end, source_type, small_chunk_index, small_chunk_text, user_id, file_name, file_ext, mime_type, created_epoch
        FROM small s JOIN files f ON s.file_id = f.file_id""",
    "chunk_vectors": "SELECT vec_id // 5 AS file_id, CAST(vec_id % 5 AS INTEGER) AS small_chunk_index, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings",
    "vector_queries": "SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS query_vector, f.user_id FROM embeddings e JOIN files f ON e.vec_id // 5 = f.file_id WHERE vec_id % 50 = 0",
    "text_queries": "SELECT item_id AS query_id, text, 'src' || (item_id % 20) AS user_id FROM benchmark",
}
_NEEDS = {"segments": ["lines"], "normal": ["segments"], "headers": ["normal"], "footers": ["normal"], "trimmed": ["normal", "headers", "footers"], "cleaned": ["trimmed"], "small": ["cleaned"], "chunks": ["small", "files"], "vector_queries": ["files"]}


def sql(body: str, /, *views: str, recursive: bool = False, **more: str) -> str:
    """``body`` with the named views (and what they need) in front, and further expressions after them."""
    need: list[str] = []

    def add(v: str) -> None:
        for w in _NEEDS.get(v, ()):
            add(w)
        if v not in need:
            need.append(v)

    for v in views:
        add(v)
    parts = [f"{v} AS ({CTE[v]})" for v in need] + [f"{k} AS ({v})" for k, v in more.items()]
    return (f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" if parts else "") + body
