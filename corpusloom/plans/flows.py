"""Registered queries over chapter flows and event streams (batch twins), with DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import chunk, clean, embed, flow
from corpusloom.plans import views as v
from corpusloom.plans.records import _METRICS
from corpusloom.plans.views import sql
from corpusloom.sources.files import exists, is_folder, new_folder, write_by_bucket
from corpusloom.sources.stored import stored
from corpusloom.streaming import events as ev
from corpusloom.streaming import ingest
from corpusloom.streaming import stateful as st


def _lines(spark, d):
    """Document lines rewritten as chapters, sections, fields and text by their number."""
    n, k = F.col("line_no"), F.col("line_no") % 6
    block = F.expr("line_no div 6").cast("string")
    word = F.regexp_extract("line", r"([A-Za-z]+)", 1)
    line = (
        F.when((n == 0) & (F.col("file_id") % 3 == 0), F.concat(F.lit("t "), "line")).when(k == 0, F.concat(F.lit("第一章 "), word)).when(k.isin(1, 3), F.concat(block, F.lit("."), k.cast("string"), F.lit(" s"), word)).when(k == 2, F.concat(F.lit("岗位："), word))
        .when(k == 4, F.concat(F.lit("职责：a"), n.cast("string"), F.lit("；b"))).otherwise(F.concat(F.lit("t "), F.col("line")))
    )
    rows = v.lines(spark, d).withColumn("line", line)
    return flow.assign(flow.classify(rows))


def flow_sections(spark, d):
    out = flow.sections(_lines(spark, d))
    return out.select("file_id", "section_id", "section_code", "title", "role", F.array_join("responsibilities", ",").alias("duties"), F.md5("content").alias("content_md5"), F.md5("summary").alias("summary_md5"), "next_id")


def flow_edges(spark, d):
    return flow.edges(flow.sections(_lines(spark, d)))


def flow_graph(spark, d):
    rows = _lines(spark, d)
    return flow.graph(flow.chapters(rows), flow.sections(rows)).select("file_id", "chapter_id", "title", F.col("lane_no").cast("int").alias("lane_no"), "n_nodes", F.array_join(F.transform("nodes", lambda x: x["section_id"]), ",").alias("nodes"))


def flow_titles(spark, d):
    return flow.document_title(_lines(spark, d), v.files(spark, d)).select("file_id", F.md5("title").alias("title_md5"))


def flow_candidates(spark, d):
    files = v.files(spark, d)
    q = files.select(F.col("file_id").alias("query_id"), "user_id", F.concat(F.lit("请根据"), F.when(F.col("file_id") % 4 == 1, F.concat(F.regexp_extract("file_name", "^([a-z]+)_", 1), F.lit("_"), "user_id")).otherwise("没有的"), F.lit("文件生成流程图")).alias("text"))
    return flow.candidates(flow.match_terms(flow.flow_requests(q).where("wants_flow")), files)


def import_graph(spark, d):
    rows = _lines(spark, d)
    s = flow.sections(rows)
    raw = F.concat(F.substring("title", 1, 3), F.when(F.col("section_no") % 3 == 0, "-2").when(F.col("section_no") % 5 == 0, " 图").otherwise(""))
    nodes = flow.import_ids(s.select("file_id", raw.alias("raw_id"), (F.col("chapter_no") * 1000 + F.col("section_no")).alias("pos")), "ai-node-")
    return nodes.select("file_id", "raw_id", "pos", "canvas_id")


def import_edges(spark, d):
    s = flow.sections(_lines(spark, d))
    nodes = flow.import_ids(s.select("file_id", F.col("section_id").alias("raw_id"), (F.col("chapter_no") * 1000 + F.col("section_no")).alias("pos")), "ai-node-")
    return flow.import_edges(flow.edges(s), nodes)


def node_info(spark, d):
    rows = _lines(spark, d)
    out = flow.node_info(flow.chapters(rows), flow.sections(rows))
    one = F.get("metrics", F.lit(0))
    return out.select("file_id", "raw_id", "kind", "title", F.md5("content").alias("content_md5"), "role", "duty", F.array_join("tags", ",").alias("tags"), F.concat(one["label"], F.lit("="), one["value"]).alias("metric"))


# ----------------------------------------------------------------------------------------------------------- streams


def last_n_events(spark, d):
    e = v.table(spark, d, "events").select(F.col("user_id"), "event_id", "ts", "event_type")
    return ev.last_n_batch(e, "user_id", ["ts", "event_id"], 50).select("user_id", "event_id", "pos")


def short_memory(spark, d):
    e = v.table(spark, d, "events").where("event_type <> 'view'").select(F.col("user_id"), "event_id", "ts")
    return ev.last_n_batch(e, "user_id", ["ts", "event_id"], 5).select("user_id", "event_id", "pos")


def _deltas(spark, d):
    c = v.table(spark, d, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("stream_id"), "text")
    cuts = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 20).cast("int")), lambda i: F.substring(F.col("text"), i * 20 + 1, F.lit(20)))
    return c.where("text <> ''").select("stream_id", F.posexplode(cuts).alias("seq", "delta"))


def assemble_deltas(spark, d):
    return ev.assemble_text(_deltas(spark, d)).select("stream_id", "n_deltas", F.md5("text").alias("text_md5"))


def assemble_calls(spark, d):
    f = _deltas(spark, d).select("stream_id", "seq", F.when(F.col("seq") % 3 == 2, -1).otherwise(F.col("seq") % 3).alias("index"), F.when(F.col("seq") % 2 == 0, F.concat(F.lit("id"), F.col("seq").cast("string"))).alias("id"), F.when(F.col("seq") < 3, "f").alias("name"), F.substring("delta", 1, 2).alias("arguments"))
    return ev.assemble_calls(f).select("stream_id", "index", "id", "name", F.md5("arguments").alias("arguments_md5"))


def visible_deltas(spark, d):
    marked = _deltas(spark, d).withColumn("delta", F.when(F.col("seq") % 5 == 1, F.concat(F.lit("Action: "), "delta")).when(F.col("seq") % 5 == 2, "  ").otherwise(F.col("delta")))
    return marked.where(ev.visible(F.col("delta"))).groupBy("stream_id").agg(F.count("*").alias("n"))


def _sse(spark, d):
    k = F.col("seq") % 5
    block = (
        F.when(k == 0, F.concat(F.lit("event: assistant_delta\ndata: "), F.to_json(F.struct("delta")))).when(k == 1, 'event: debug\ndata: {bad').when(k == 2, "event: ping")
        .when(k == 3, 'data: {"a":\ndata: 1}').otherwise('event: assistant_done\ndata: {"message":"m"}')
    )
    parts = F.array_sort(F.collect_list(F.struct("seq", block.alias("b"))))
    return _deltas(spark, d).groupBy("stream_id").agg(F.array_join(F.transform(parts, lambda x: x["b"]), "\n\n").alias("raw"))


def parse_sse(spark, d):
    return ev.parse_sse(_sse(spark, d)).select("stream_id", "event_no", "event", "bad")


def check_events(spark, d):
    return ev.check_events(ev.parse_sse(_sse(spark, d)))


def _stream(spark, d, name):
    """A table as a file stream: a folder of files, or one file picked out of its folder."""
    schema, path = v.table(spark, d, name).schema, f"{d}/{name}.parquet"
    if is_folder(spark, path):
        return spark.readStream.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(f"{d}/")


def _arrivals(spark, rows, parts, name):
    """``rows`` as a stream of one file after the other, by the number in their column ``part``. They are computed once, by all
    tasks; only the finished rows of a part go through one task."""
    path, found = new_folder(spark, name), stored(rows, f"{name}-dealt")
    for k in range(parts):
        found.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(path)


def _events(spark, d):
    """Events dealt to four arrivals by time, every seventh up to six hours late; a fifth has one row, by which the watermark
    passes all others."""
    e = v.table(spark, d, "events").select("event_id", "user_id", "event_type", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("us"))
    ends = e.agg(F.min("us").alias("low"), F.max("us").alias("high")).first()
    low, high = ends["low"] or 0, ends["high"] or 0
    late = F.when(F.col("event_id") % 7 == 0, 6 * 3600 * 1_000_000).otherwise(0)
    e = e.withColumn("part", F.least(F.lit(3), F.expr(f"(us - {low}) * 4 div {high - low + 1}") + (F.expr(f"(us - {low}) * 4 % {high - low + 1}") / 4 + late > (high - low + 1) / 4).cast("int")).cast("int"))
    last = spark.createDataFrame([(-1, None, None, high + 4 * 86_400_000_000, 4)], e.schema)
    return e.unionByName(last).withColumn("at", F.timestamp_micros("us"))


def trace_metrics_stream(spark, d):
    """Every event as a step of its user's session, over five batches with late rows; idle sessions start anew after a day."""
    st.use_rocksdb(spark)
    sink, checkpoint = new_folder(spark, "trace-metrics"), new_folder(spark, "trace-checkpoint")
    act = F.col("event_type") != "view"
    steps = _arrivals(spark, _events(spark, d), 5, "trace-arrivals").select(F.coalesce(F.col("user_id").cast("string"), F.lit("")).alias("session_id"), "at", F.col("us").alias("seq"), act.alias("has_activity"), F.when(act, F.col("event_type")).alias("tool_name"), F.lit("{}").alias("tool_args"))
    out = st.step_metrics(steps).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    _finished(out)
    return spark.read.schema("session_id string, seq long, empty_steps long, repeated_actions long").parquet(sink).where("session_id <> ''")


def last_n_stream(spark, d):
    """The newest 50 events of every user since a pause of a day, over five batches with late rows; the last list of each user
    is what stays in the table."""
    st.use_rocksdb(spark)
    sink, checkpoint = new_folder(spark, "last-n"), new_folder(spark, "last-n-checkpoint")
    rows = _arrivals(spark, _events(spark, d), 5, "last-n-arrivals").select(F.coalesce(F.col("user_id").cast("string"), F.lit("")).alias("key"), "at", F.col("event_id").alias("seq"), F.col("event_type").alias("value"))
    out = st.last_n(rows).writeStream.foreachBatch(lambda batch, _: write_by_bucket(batch, sink, "key")).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
    _finished(out)
    return spark.read.parquet(sink).select("key", "pos", "seq", "value").where("key <> ''")


def assembly_stream(spark, d):
    """Replies and their tool calls put together from fragments that come in any order over four batches and a closing one;
    every tenth stream has no done event and is given up."""
    st.use_rocksdb(spark)
    sink, checkpoint = new_folder(spark, "assembly"), new_folder(spark, "assembly-checkpoint")
    f = _deltas(spark, d).select("stream_id", "seq", F.lit(False).alias("done"), F.when(F.col("seq") % 4 != 3, F.col("delta")).alias("delta"), F.when(F.col("seq") % 3 == 2, -1).otherwise(F.col("seq") % 3).alias("index"), F.when(F.col("seq") % 2 == 0, F.concat(F.lit("id"), F.col("seq").cast("string"))).alias("id"), F.when(F.col("seq") < 3, "f").alias("name"), F.substring("delta", 1, 2).alias("arguments"))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in f.dtypes[3:]]
    ends = f.groupBy("stream_id").agg(F.count("*").cast("int").alias("seq")).where(~F.col("stream_id").endswith("0")).select("stream_id", "seq", F.lit(True).alias("done"), *nothing)
    every = f.unionByName(ends).withColumn("part", F.pmod(F.xxhash64("stream_id", "seq"), F.lit(4)).cast("int")).withColumn("us", F.lit(0).cast("long"))
    last = spark.range(1).select(F.lit("").alias("stream_id"), F.lit(0).alias("seq"), F.lit(False).alias("done"), *nothing, F.lit(4).alias("part"), F.lit(4 * 86_400_000_000).alias("us"))
    rows = _arrivals(spark, every.unionByName(last).withColumn("at", F.timestamp_micros(F.col("us") + 1_700_000_000_000_000)).drop("us"), 5, "fragments")
    out = st.assemble(rows).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    _finished(out)
    found = spark.read.schema("stream_id string, finished boolean, index int, id string, name string, body string").parquet(sink)
    return found.where("stream_id <> ''").select("stream_id", "finished", "index", "id", "name", F.md5("body").alias("body_md5"))


def _finished(query):
    query.awaitTermination()
    return query


def ingest_stream(spark, d):
    """Incremental ingest: documents as a file stream, cut into segments, cleaned and chunked batch by batch into a table
    partitioned by key bucket, which is read back."""
    sink, checkpoint = new_folder(spark, "chunk-table"), new_folder(spark, "ingest-checkpoint")

    def to_chunks(batch):
        segs = v.cut_segments(batch)
        return chunk.small_chunks(clean.clean_segments(segs)).select("file_id", "small_chunk_index", "small_chunk_text", "page_start")

    _finished(ev.ingest_stream(_stream(spark, d, "documents"), to_chunks, lambda rows: write_by_bucket(rows, sink), checkpoint))
    held = spark.read.schema("file_id long, small_chunk_index int, small_chunk_text string, page_start int")
    held = held.parquet(sink) if exists(spark, sink) else held.load([], format="parquet")
    return held.select("file_id", "small_chunk_index", "small_chunk_text", "page_start")


def ingest_status(spark, d):
    """Documents arrive in three batches, every seventh again in the last; thirteenths can't be read and texts with an asterisk
    are refused by the model. One row a file: its last status, error, and what the chunk table has of it."""
    path, checkpoint = new_folder(spark, "ingest"), new_folder(spark, "ingest-checkpoint")
    docs = v.table(spark, d, "documents").select("doc_id", "text", F.col("doc_id").alias("file_id"))
    parts = docs.withColumn("part", (F.col("doc_id") % 2).cast("int"))
    again = docs.where("doc_id % 7 = 0").withColumn("part", F.lit(2))
    problem = F.when(F.col("doc_id") % 13 == 0, F.concat(F.lit("unreadable file "), F.col("doc_id").cast("string")))

    def model(texts):
        if any("*" in t for t in texts):
            raise ValueError("refused")
        return embed.hashed(texts, 16)

    chunked = lambda rows: chunk.small_chunks(clean.clean_segments(v.cut_segments(rows))).select("file_id", "small_chunk_index", "small_chunk_text")
    _finished(ingest.ingest(_arrivals(spark, parts.unionByName(again), 3, "uploads"), path, checkpoint, problem, chunked, model, 16))
    held = spark.read.parquet(f"{path}/chunks").groupBy("file_id").agg(F.count("embedding").alias("n_vectors"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("small_chunk_index", "small_chunk_text"))), lambda x: x["small_chunk_text"]), "|")).alias("text_md5"))
    return ingest.statuses(spark, path).join(held, "file_id", "left").select("file_id", "status", "error", "n_chunks", F.coalesce("n_vectors", F.lit(0)).alias("n_vectors"), "text_md5")


QUERIES = {f.__name__: f for f in (flow_sections, flow_edges, flow_graph, flow_titles, flow_candidates, import_graph, import_edges, node_info, last_n_events, short_memory, assemble_deltas, assemble_calls, visible_deltas, parse_sse, check_events, ingest_stream, trace_metrics_stream, last_n_stream, assembly_stream, ingest_status)}

_W = "regexp_extract(line, '([A-Za-z]+)', 1)"
_FLOW = {
    "raw": f"""SELECT file_id, line_no, trim(regexp_replace(CASE WHEN line_no = 0 AND file_id % 3 = 0 THEN 't ' || line ELSE CASE line_no % 6 WHEN 0 THEN '第一章 ' || {_W} WHEN 1 THEN (line_no // 6) || '.1 s' || {_W} WHEN 3 THEN (line_no // 6) || '.3 s' || {_W} WHEN 2 THEN '岗位：' || {_W} WHEN 4 THEN '职责：a' || line_no || '；b' ELSE 't ' || line END END, '\\s+', ' ', 'g')) AS line FROM lines""",
    "kinds": r"SELECT *, CASE WHEN regexp_matches(line, '^(\d+\.\s*)?第[一二三四五六七八九十百千]+章\s+.+$') THEN 'chapter' WHEN regexp_matches(line, '^\d+\.\d+\s+.+$') THEN 'section' ELSE 'text' END AS kind FROM raw WHERE line <> ''",
    "c1": "SELECT *, sum(CASE WHEN kind = 'chapter' THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY line_no) AS c FROM kinds",
    "c2": "SELECT *, sum(CASE WHEN kind = 'section' THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, c ORDER BY line_no) AS s, max(CASE WHEN c = 0 AND kind = 'section' THEN 1 ELSE 0 END) OVER (PARTITION BY file_id) AS lead0 FROM c1",
    "al": r"SELECT *, c + CASE WHEN c > 0 THEN lead0 ELSE 0 END AS chapter_no, CASE kind WHEN 'chapter' THEN regexp_extract(line, '^(?:\d+\.\s*)?(第[一二三四五六七八九十百千]+章\s+.+)$', 1) WHEN 'section' THEN regexp_extract(line, '^(\d+\.\d+)\s+(.+)$', 2) END AS title, CASE WHEN kind = 'section' THEN regexp_extract(line, '^(\d+\.\d+)\s+', 1) END AS code FROM c2",
    "sec0": """SELECT file_id, chapter_no, s AS section_no, max(code) AS section_code, max(title) AS title, nullif(max(CASE WHEN starts_with(line, '岗位：') THEN substring(line, 4) END), '') AS role, max(CASE WHEN starts_with(line, '职责：') THEN substring(line, 4) END) AS duty,
        string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE kind = 'text' AND NOT starts_with(line, '岗位：') AND NOT starts_with(line, '职责：')) AS content, string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE kind = 'text') AS rawtext FROM al WHERE s > 0 GROUP BY ALL""",
    "sec": """SELECT *, section_code AS section_id, coalesce(content, rawtext, '') AS body, lead(section_code) OVER (PARTITION BY file_id, chapter_no ORDER BY section_no) AS next_id FROM sec0""",
    "chap": "SELECT file_id, chapter_no, title FROM al WHERE kind = 'chapter' UNION ALL SELECT DISTINCT file_id, chapter_no, '未分章内容' FROM al WHERE c = 0 AND kind = 'section'",
}
_CUT = "coalesce(" + ", ".join(f"CASE WHEN strpos(body, '{c}') > 1 AND trim(split_part(body, '{c}', 1)) <> '' THEN trim(split_part(body, '{c}', 1)) || '{c}' END" for c in flow.DELIMITERS) + ", left(body, 80))"
_SLUG = "CASE WHEN trim(regexp_replace(lower(trim(x)), '[^a-z0-9]+', '-', 'g'), '-') = '' THEN 'item' ELSE trim(regexp_replace(lower(trim(x)), '[^a-z0-9]+', '-', 'g'), '-') END"
_DELTAS = "SELECT stream_id, CAST(k AS INTEGER) AS seq, substring(text, CAST(k * 20 + 1 AS BIGINT), 20) AS delta FROM (SELECT conv_id || ':' || turn AS stream_id, text FROM conversations WHERE text <> ''), LATERAL (SELECT unnest(range(CAST(floor((length(text) - 1) / 20) AS BIGINT) + 1)) AS k)"


def _f(body: str) -> str:
    return sql(body, "lines", "files", **_FLOW)


_LAST = "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS b FROM events WHERE {}) WHERE b <= {}".format
#: Events with the number of pauses of more than a day before them, and the step metrics that start anew after each.
_PAUSES = "SELECT *, sum(CASE WHEN epoch_us(ts) - before > 86400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pause FROM (SELECT *, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)"
_AFTER_PAUSES = {"tr": f"SELECT *, user_id || ':' || pause AS session_id, epoch_us(ts) AS step_index, event_type <> 'view' AS act, CASE WHEN event_type <> 'view' THEN event_type END AS tool FROM ({_PAUSES})"} | {k: x for k, x in _METRICS.items() if k != "tr"}
ORACLES = {
    "ingest_status": sql("""SELECT doc_id AS file_id, CASE WHEN e IS NULL THEN 'VECTORIZED' ELSE 'FAILED' END AS status, e AS error, CASE WHEN e IS NULL THEN n ELSE 0 END AS n_chunks, CASE WHEN e IS NULL THEN n ELSE 0 END AS n_vectors, CASE WHEN e IS NULL THEN t END AS text_md5 FROM
        (SELECT doc_id, n, t, CASE WHEN doc_id % 13 = 0 THEN 'unreadable file ' || doc_id WHEN n IS NULL THEN 'No text content extracted for vectorization' WHEN star THEN 'refused' END AS e FROM documents LEFT JOIN
        (SELECT file_id, count(*) AS n, md5(string_agg(small_chunk_text, '|' ORDER BY small_chunk_index)) AS t, bool_or(contains(small_chunk_text, '*')) AS star FROM small GROUP BY file_id) s ON doc_id = s.file_id)""", "small"),
    "ingest_stream": sql("SELECT file_id, small_chunk_index, small_chunk_text, page_start FROM small", "small"),
    "flow_sections": _f(f"SELECT file_id, section_id, section_code, title, role, coalesce(replace(duty, '；', ','), '') AS duties, md5(body) AS content_md5, md5({_CUT}) AS summary_md5, next_id FROM sec"),
    "flow_edges": _f("SELECT file_id, 'edge-' || section_id || '-' || next_id AS edge_id, section_id AS source, next_id AS target FROM sec WHERE next_id IS NOT NULL"),
    "flow_graph": _f("SELECT c.file_id, 'chapter-' || c.chapter_no AS chapter_id, c.title, CAST(c.chapter_no AS INTEGER) AS lane_no, CAST(count(s.section_id) AS INTEGER) AS n_nodes, string_agg(s.section_id, ',' ORDER BY s.section_no) AS nodes FROM chap c LEFT JOIN sec s ON c.file_id = s.file_id AND c.chapter_no = s.chapter_no GROUP BY c.file_id, c.chapter_no, c.title"),
    "flow_titles": _f("SELECT f.file_id, md5(coalesce(t, file_name)) AS title_md5 FROM files f LEFT JOIN (SELECT file_id, arg_min(line, line_no) AS t FROM al WHERE kind = 'text' AND s = 0 GROUP BY file_id) x ON f.file_id = x.file_id"),
    "flow_candidates": sql("""SELECT query_id, file_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, created_epoch DESC, file_id DESC) AS rank FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM
        (SELECT q.query_id, f.file_id, f.created_epoch, CAST(list_sum(list_transform(q.terms, lambda t: CASE WHEN contains(lower(f.file_name), t) THEN length(t) ELSE 0 END + CASE WHEN contains(regexp_replace(lower(f.file_name), '\\.docx$', ''), t) THEN length(t) ELSE 0 END)) AS INTEGER) AS score FROM q JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_epoch DESC, file_id DESC) AS n FROM files) f ON q.user_id = f.user_id AND n <= 200 AND f.file_ext = 'docx'))
        WHERE score > 0 OR best = 0) WHERE rank <= 5""", "files", q="SELECT file_id AS query_id, user_id, CASE WHEN file_id % 4 = 1 THEN list_distinct([regexp_extract(file_name, '^([a-z]+)_', 1) || '_' || user_id, regexp_extract(file_name, '^([a-z]+)_', 1) || user_id, '请根据' || regexp_extract(file_name, '^([a-z]+)_', 1), user_id || '文件生成流程图']) ELSE ['没有的', '请根据没有的文件生成流程图'] END AS terms FROM files"),
    "import_graph": _f(f"""SELECT file_id, unnest(xs) AS raw_id, unnest(ps) AS pos, unnest(list_reduce(list_transform(gs, lambda g: [g]), lambda acc, g: list_append(acc, CASE WHEN NOT list_contains(acc, g[1]) THEN g[1]
        ELSE list_filter(list_transform(range(2, len(acc) + 3), lambda n: g[1] || '-' || n), lambda c: NOT list_contains(acc, c))[1] END))) AS canvas_id
        FROM (SELECT file_id, list(x ORDER BY pos) AS xs, list(pos ORDER BY pos) AS ps, list('ai-node-' || {_SLUG} ORDER BY pos) AS gs
        FROM (SELECT file_id, left(title, 3) || CASE WHEN section_no % 3 = 0 THEN '-2' WHEN section_no % 5 = 0 THEN ' 图' ELSE '' END AS x, CAST(chapter_no * 1000 + section_no AS BIGINT) AS pos FROM sec) GROUP BY file_id)"""),
    "import_edges": _f("SELECT file_id, 'ai-edge-edge-' || replace(section_id, '.', '-') || '-' || replace(next_id, '.', '-') AS edge_id, 'ai-node-' || replace(section_id, '.', '-') AS source_id, 'ai-node-' || replace(next_id, '.', '-') AS target_id FROM sec WHERE next_id IS NOT NULL"),
    "node_info": _f(f"""SELECT file_id, 'chapter-' || chapter_no AS raw_id, 'lane' AS kind, title, md5('') AS content_md5, '' AS role, '' AS duty, '泳道,AI 导入' AS tags, '章节序号=' || chapter_no AS metric FROM chap
        UNION ALL SELECT file_id, section_id, 'node', title, md5({_CUT}), coalesce(role, ''), coalesce(duty, ''), '活动,AI 导入', CASE WHEN duty <> '' THEN '职责=' || duty END FROM sec"""),
    "last_n_events": _LAST("true", 50),
    "trace_metrics_stream": sql("SELECT CAST(met.user_id AS VARCHAR) AS session_id, epoch_us(ts) AS seq, empty_steps, repeated_actions FROM met", **_AFTER_PAUSES),
    "last_n_stream": f"""WITH p AS ({_PAUSES}), last AS (SELECT * FROM p QUALIFY pause = max(pause) OVER (PARTITION BY user_id)), back AS (SELECT * FROM last QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50)
        SELECT CAST(user_id AS VARCHAR) AS key, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS pos, event_id AS seq, event_type AS value FROM back""",
    "assembly_stream": sql("""SELECT stream_id, NOT ends_with(stream_id, '0') AS finished, CAST(NULL AS INTEGER) AS index, CAST(NULL AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS name, md5(string_agg(delta, '' ORDER BY seq)) AS body_md5 FROM dl WHERE seq % 4 <> 3 GROUP BY stream_id
        UNION ALL SELECT stream_id, NOT ends_with(stream_id, '0'), CAST(i AS INTEGER), arg_max(id, seq) FILTER (WHERE id IS NOT NULL), nullif(string_agg(CASE WHEN seq < 3 THEN 'f' ELSE '' END, '' ORDER BY seq), ''), md5(string_agg(left(delta, 2), '' ORDER BY seq)) FROM
        (SELECT *, CASE seq % 3 WHEN 1 THEN 1 ELSE 0 END AS i, CASE WHEN seq % 2 = 0 THEN 'id' || seq END AS id FROM dl) GROUP BY stream_id, i""", dl=_DELTAS),
    "short_memory": _LAST("event_type <> 'view'", 5),
    "assemble_deltas": sql("SELECT stream_id, count(*) AS n_deltas, md5(string_agg(delta, '' ORDER BY seq)) AS text_md5 FROM dl GROUP BY stream_id", dl=_DELTAS),
    "assemble_calls": sql("SELECT stream_id, CAST(i AS INTEGER) AS index, arg_max(id, seq) FILTER (WHERE id IS NOT NULL) AS id, nullif(string_agg(CASE WHEN seq < 3 THEN 'f' ELSE '' END, '' ORDER BY seq), '') AS name, md5(string_agg(left(delta, 2), '' ORDER BY seq)) AS arguments_md5 FROM (SELECT *, CASE WHEN seq % 3 = 2 THEN 0 ELSE seq % 3 END AS i, CASE WHEN seq % 2 = 0 THEN 'id' || seq END AS id FROM dl) GROUP BY stream_id, i", dl=_DELTAS),
    "visible_deltas": sql("SELECT stream_id, count(*) AS n FROM dl WHERE seq % 5 NOT IN (1, 2) AND trim(delta) <> '' GROUP BY stream_id", dl=_DELTAS),
    "parse_sse": sql("SELECT stream_id, seq AS event_no, CASE seq % 5 WHEN 0 THEN 'assistant_delta' WHEN 1 THEN 'debug' WHEN 3 THEN 'message' ELSE 'assistant_done' END AS event, seq % 5 = 1 AS bad FROM dl WHERE seq % 5 <> 2", dl=_DELTAS),
    "check_events": sql("SELECT stream_id, count(*) FILTER (WHERE seq % 5 <> 2) AS n_events, count(*) FILTER (WHERE seq % 5 = 1) AS n_ignored, 0::BIGINT AS n_errors, bool_or(seq % 5 = 4) AS valid FROM dl GROUP BY stream_id", dl=_DELTAS),
}
