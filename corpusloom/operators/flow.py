"""Chapters and sections from document lines, their graph, and the import of a graph to a canvas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import strip

CHAPTER = r"^(?:\d+\.\s*)?(第[一二三四五六七八九十百千]+章\s+.+)$"
SECTION = r"^(\d+\.\d+)\s+(.+)$"
FIELDS = {"岗位": "role", "部门": "department", "责任人": "owner", "职责": "duty"}
DELIMITERS = "。！？.!?"
# Fixed values of the request language, in natural order.
STOP_TERMS = ["根据", "文件", "文档", "生成", "流程图", "请", "帮我", "从", "用"]


def _by_file() -> Window:
    return Window.partitionBy("file_id").orderBy("line_no")


def classify(lines: DataFrame) -> DataFrame:
    """Adds kind (chapter, section, text), title and section_code; blank lines go."""
    t = strip(F.regexp_replace("line", r"(?U)\s+", " "))
    rows = lines.withColumn("line", t).where(t != "")
    chapter, code = F.regexp_extract("line", CHAPTER, 1), F.regexp_extract("line", SECTION, 1)
    return rows.withColumn("kind", F.when(chapter != "", "chapter").when(code != "", "section").otherwise("text")).withColumn("title", F.when(chapter != "", chapter).when(code != "", F.regexp_extract("line", SECTION, 2))).withColumn("section_code", F.nullif(code, F.lit("")))


def assign(lines: DataFrame) -> DataFrame:
    """Adds chapter_no (0: before any chapter, only if a section is there), section_no (null outside sections) by running counts."""
    rows = lines.withColumn("c", F.sum((F.col("kind") == "chapter").cast("int")).over(_by_file()))
    rows = rows.withColumn("s", F.sum((F.col("kind") == "section").cast("int")).over(Window.partitionBy("file_id", "c").orderBy("line_no")))
    lead = F.max(((F.col("c") == 0) & (F.col("kind") == "section")).cast("int")).over(Window.partitionBy("file_id"))
    # the unnamed chapter counts as a chapter before the first one
    return rows.withColumn("chapter_no", F.col("c") + F.when(F.col("c") > 0, lead).otherwise(0)).withColumn("section_no", F.when(F.col("s") > 0, F.col("s"))).drop("s")


def document_title(lines: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, title): the first text line outside any section, else the file name."""
    first = lines.where("kind = 'text' and section_no is null").groupBy("file_id").agg(F.min_by("line", "line_no").alias("t"))
    return files.select("file_id", "file_name").join(first, "file_id", "left").select("file_id", F.coalesce("t", "file_name").alias("title"))


def summary(text: Column) -> Column:
    """The first sentence with its delimiter, by delimiter priority; else 80 characters."""
    text = strip(text)
    first = lambda d: strip(F.split_part(text, F.lit(d), F.lit(1)))
    cuts = [F.when((F.instr(text, d) > 1) & (first(d) != ""), F.concat(first(d), F.lit(d))) for d in DELIMITERS]
    return F.coalesce(*cuts, F.substring(text, 1, 80))


def sections(lines: DataFrame) -> DataFrame:
    """One row a section: ids, title, order, role, department, owner, responsibilities, content, summary, next section.

    ``name：value`` lines set fields (the last one wins, blank is null); the rest is content, or all lines if none is."""
    body = lines.where("section_no is not null")
    at = F.instr("line", "：")
    key = F.when(at > 0, strip(F.split_part("line", F.lit("："), F.lit(1))))
    value = strip(F.expr("substring(line, instr(line, '：') + 1)"))
    rows = body.withColumn("key", key).withColumn("value", value)
    pick = lambda k: F.nullif(F.max_by(F.when(F.col("key") == k, F.col("value")), F.when(F.col("key") == k, F.col("line_no"))), F.lit(""))
    plain = (F.col("kind") == "text") & (F.col("key").isNull() | ~F.col("key").isin(*FIELDS)) & ~((F.col("key") == "内容") & (F.col("value") == "")).eqNullSafe(True)
    ordered = lambda keep, what: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("line_no", what.alias("t"))))), lambda x: x["t"]), "\n")
    content = F.when(F.col("key") == "内容", F.col("value")).otherwise(F.col("line"))
    out = rows.groupBy("file_id", "chapter_no", "section_no").agg(
        F.max_by("section_code", F.when(F.col("kind") == "section", F.col("line_no"))).alias("section_code"), F.max_by("title", F.when(F.col("kind") == "section", F.col("line_no"))).alias("title"),
        *[pick(k).alias(n) for k, n in FIELDS.items()], ordered(plain, content).alias("content"), ordered(F.col("kind") == "text", F.col("line")).alias("raw"), F.min("line_no").alias("first_line"),
    )
    out = out.withColumn("content", F.when(F.col("content") == "", F.col("raw")).otherwise(F.col("content"))).drop("raw")
    out = out.withColumn("responsibilities", F.filter(F.transform(F.split(F.coalesce("duty", F.lit("")), "[；;]"), lambda x: strip(x)), lambda x: x != "")).drop("duty")
    out = out.withColumn("section_id", F.col("section_code")).withColumn("chapter_id", F.concat(F.lit("chapter-"), F.col("chapter_no").cast("string")))
    order = Window.partitionBy("file_id", "chapter_no").orderBy("section_no")
    return out.withColumn("summary", summary(F.col("content"))).withColumn("next_id", F.lead("section_id").over(order))


def chapters(lines: DataFrame) -> DataFrame:
    """(file_id, chapter_no, chapter_id, title) of all chapters, the unnamed one included where it has sections."""
    named = lines.where("kind = 'chapter'").select("file_id", "chapter_no", "title")
    unnamed = lines.where("c = 0 and kind = 'section'").select("file_id", "chapter_no").distinct().withColumn("title", F.lit("未分章内容"))
    return named.unionByName(unnamed).withColumn("chapter_id", F.concat(F.lit("chapter-"), F.col("chapter_no").cast("string")))


def edges(found: DataFrame) -> DataFrame:
    """(file_id, edge_id, source, target) between neighbouring sections of a chapter."""
    return found.where("next_id is not null").select("file_id", F.concat(F.lit("edge-"), "section_id", F.lit("-"), "next_id").alias("edge_id"), F.col("section_id").alias("source"), F.col("next_id").alias("target"))


def graph(found_chapters: DataFrame, found: DataFrame) -> DataFrame:
    """One lane a chapter with its nodes in order: (file_id, chapter_id, title, lane_no, n_nodes, nodes)."""
    node = F.struct("section_no", "section_id", "title", "summary")
    kids = found.groupBy("file_id", "chapter_id").agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    return found_chapters.join(kids, ["file_id", "chapter_id"], "left").select("file_id", "chapter_id", "title", F.col("chapter_no").alias("lane_no"), F.greatest(F.size(F.coalesce("nodes", F.array().cast(kids.schema["nodes"].dataType))), F.lit(0)).alias("n_nodes"), "nodes")


def flow_requests(queries: DataFrame) -> DataFrame:
    """Adds wants_flow: asks to generate a flow chart from a file."""
    t = F.col("text")
    return queries.withColumn("wants_flow", t.contains("流程图") & t.contains("生成") & (t.contains("文件") | t.contains("文档") | t.contains("根据")))


def match_terms(queries: DataFrame) -> DataFrame:
    """Adds terms, without repeats: what is left of the text without stop terms (longest first) and other signs, the named
    document, and the text's tokens, all of two characters or more but stop terms (the named one may be shorter)."""
    t = F.lower(strip("text"))
    focus = F.col("text")
    for w in sorted(STOP_TERMS, key=len, reverse=True):
        focus = F.replace(focus, F.lit(w), F.lit(""))
    focus = F.lower(F.regexp_replace(focus, r"[^0-9a-zA-Z\u4e00-\u9fff]+", ""))
    named = strip(F.regexp_extract("text", "根据(.+?)(文件|文档)", 1))
    long = lambda x: F.length(x) >= 2
    other = lambda x: ~x.isin(*STOP_TERMS)
    tokens = F.filter(F.regexp_extract_all(t, F.lit(r"[0-9a-zA-Z\u4e00-\u9fff]+"), F.lit(0)), lambda x: long(x) & other(x))
    found = F.concat(F.filter(F.array(focus), long), F.filter(F.array(named), lambda x: (x != "") & other(x)), tokens)
    return queries.withColumn("terms", F.array_distinct(found))


def candidates(queries: DataFrame, files: DataFrame, k: int = 5, newest: int = 200) -> DataFrame:
    """(query_id, file_id, score, rank): the docx files among a user's ``newest`` uploads by the length of the terms in their
    names; all zero: the newest."""
    docx = files.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("created_epoch"), F.desc("file_id")))).where(F.col("n") <= newest).where("file_ext = 'docx'")
    rows = queries.where(F.size("terms") > 0).select("query_id", "user_id", "terms").join(docx, "user_id")
    name = F.lower("file_name")
    stem = F.regexp_replace(name, r"\.docx$", "")
    hits = lambda where: F.aggregate("terms", F.lit(0), lambda a, t: a + F.when(F.contains(where, t), F.length(t)).otherwise(0))
    rows = rows.withColumn("score", hits(name) + hits(stem))
    best = F.max("score").over(Window.partitionBy("query_id"))
    rows = rows.withColumn("best", best).where((F.col("score") > 0) | (F.col("best") == 0))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("created_epoch"), F.desc("file_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "file_id", "score", "rank")


def slug(raw: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(strip(raw)), r"[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "item").otherwise(s)


def issue_ids(rows: DataFrame, to: str, prefix: str, raw: str, order: str) -> DataFrame:
    """Adds ids that are unique within a file: prefix and slug, or the first of -2, -3, ... behind it that no earlier row was
    given. A file's rows are folded in their order, with the ids issued so far; a file is an upload of bounded size."""
    if not prefix:
        raise ValueError("a prefix keeps ids apart from the reserved 0 and 1")
    fields = rows.columns
    listed = rows.withColumn("base", F.concat(F.lit(prefix), slug(F.col(raw)))).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_order"), F.struct(*fields).alias("_row"), "base"))).alias("all"))

    def free(issued: Column, base: Column) -> Column:
        numbered = F.transform(F.sequence(F.lit(2), F.size(issued) + 2), lambda i: F.concat(base, F.lit("-"), i.cast("string")))
        return F.when(~F.array_contains(issued, base), base).otherwise(F.element_at(F.array_except(numbered, issued), 1))

    ids = F.aggregate("all", F.array().cast("array<string>"), lambda issued, r: F.concat(issued, F.array(free(issued, r["base"]))))
    out = listed.select(F.inline(F.arrays_zip(F.col("all._row").alias("row"), ids.alias("id"))))
    return out.select(*[F.col(f"row.{c}").alias(c) for c in fields], F.col("id").alias(to))


def import_ids(nodes: DataFrame, prefix: str) -> DataFrame:
    """Adds canvas_id to (file_id, raw_id, pos), issued in order of pos."""
    return issue_ids(nodes, "canvas_id", prefix, "raw_id", "pos")


def import_edges(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends are imported, by the first node of a raw id; ids are issued in order of pos, or of the raw id where links have none."""
    first = nodes.groupBy("file_id", "raw_id").agg(F.min_by("canvas_id", "pos").alias("id"))
    a, b = first.select("file_id", F.col("raw_id").alias("source"), F.col("id").alias("source_id")), first.select("file_id", F.col("raw_id").alias("target"), F.col("id").alias("target_id"))
    both = links.join(a, ["file_id", "source"]).join(b, ["file_id", "target"]).withColumnRenamed("edge_id", "raw_edge")
    return issue_ids(both, "edge_id", "ai-edge-", "raw_edge", "pos" if "pos" in links.columns else "raw_edge").select("file_id", "edge_id", "source_id", "target_id")


def node_info(found_chapters: DataFrame, found: DataFrame) -> DataFrame:
    """One row for each lane and each node: (file_id, raw_id, kind, title, content, role, department, owner, duty, tags,
    metrics as (label, value))."""
    none = F.lit("").alias
    tags = lambda kind: F.array(F.lit(kind), F.lit("AI 导入")).alias("tags")
    metric = lambda label, value: F.array(F.struct(F.lit(label).alias("label"), value.alias("value")))
    lanes = found_chapters.select("file_id", F.col("chapter_id").alias("raw_id"), F.lit("lane").alias("kind"), "title", none("content"), none("role"), none("department"), none("owner"), none("duty"), tags("泳道"), metric("章节序号", F.col("chapter_no").cast("string")).alias("metrics"))
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    duty = F.array_join("responsibilities", "；")
    duties = F.when(duty != "", metric("职责", duty)).otherwise(F.array().cast("array<struct<label:string,value:string>>")).alias("metrics")
    nodes = found.select("file_id", F.col("section_id").alias("raw_id"), F.lit("node").alias("kind"), "title", F.col("summary").alias("content"), blank("role"), blank("department"), blank("owner"), duty.alias("duty"), tags("活动"), duties)
    return lanes.unionByName(nodes)
