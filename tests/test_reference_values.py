"""Hand-checked values for the retrieval, ingest and record operators."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions import vectors as vec
from corpusloom.operators import catalog, chunk, clean, conversation, embed, flow, retrieve, trace

SEGMENTS = "file_id long, seg_no int, text string, page_start int, page_end int, source_type string"


def segments(spark, *rows):
    return spark.createDataFrame([(1, i, t, p, p, "pdf_text") for i, (t, p) in enumerate(rows)], SEGMENTS)


def test_cleaning_drops_markup_page_breaks_and_repeated_edges(spark):
    df = segments(spark, ("统一页眉\n<div>第一段\f内容一</div>\n统一页脚", 1), ("统一页眉\n<p>第二段</p>\n内容二\n统一页脚", 2))
    assert [r.text for r in clean.clean_segments(df).sort("seg_no").collect()] == ["第一段 内容一", "第二段 内容二"]
    assert clean.clean_segments(segments(spark, ("   \f   ", None))).count() == 0
    assert [r.text for r in clean.clean_segments(segments(spark, ("系统概览", 1), ("系统概览", 2))).collect()] == ["系统概览"] * 2


def test_chunks_overlap_and_pack(spark):
    df = segments(spark, ("甲" * 90 + "乙" * 90, 1))
    small = chunk.small_chunks(df, 80, 20)
    rows = chunk.pack_large(small, 160).sort("small_chunk_index").collect()
    assert [len(r.small_chunk_text) for r in rows] == [80, 80, 60]
    assert rows[0].large_chunk_id == rows[1].large_chunk_id != rows[2].large_chunk_id and len(rows[0].large_chunk_text) == 160
    assert chunk.small_chunks(df.where("false")).count() == 0


def test_ocr_fills_blank_pages_and_table_rows_join(spark):
    native = spark.createDataFrame([(1, 1, ""), (1, 2, "第二页原生文本")], "file_id long, page int, text string")
    ocr = spark.createDataFrame([(1, 1, "第一页OCR文本")], "file_id long, page int, text string")
    assert {(r.page, r.text, r.source_type) for r in clean.coalesce_ocr(native, ocr).collect()} == {(1, "第一页OCR文本", "pdf_ocr"), (2, "第二页原生文本", "pdf_text")}
    cells = spark.createDataFrame([(1, 1, 2, "L1"), (1, 1, 0, " 流程名称 "), (1, 1, 1, "流程名称"), (1, 1, 3, "")], "file_id long, row_no int, col_no int, text string")
    assert clean.table_rows_to_segments(cells).first().text == "流程名称 | L1"


def test_vectors_normalise_and_truncate(spark):
    df = spark.createDataFrame([([3.0, 4.0, 0.0],), ([0.0, 3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    got = [r[0] for r in df.select(vec.l2_normalize(vec.truncate(F.col("v"), 2))).collect()]
    assert got == [[0.6, 0.8], [0.0, 1.0], [0.0, 0.0]]
    bad = spark.createDataFrame([([1.0],), ([1.0, float("nan")],), ([1.0, float("inf")],), ([1.0, 2.0],), (None,)], "v array<double>")
    assert [r[0] for r in bad.select(vec.problem(F.col("v"), 2)).collect()] == ["dimension", "not finite", "not finite", None, "missing"]


def test_embedding_calls_retry_and_fall_back_to_single_items():
    waits, calls = [], []

    def flaky(texts):
        calls.append(len(texts))
        if len(calls) == 1:
            raise OSError("down")
        return [[1.0]]

    assert embed.call(flaky, ["a", "b"], sleep=waits.append) == [[1.0], [1.0]] and waits == [0.5] and calls == [2, 2, 1, 1]
    with pytest.raises(ValueError):
        embed.call(lambda t: [[1.0]] * 3, ["a", "b"])


def test_query_features(spark):
    q = spark.createDataFrame([(1, "最近的PDF 报错ERR-42 怎么办"), (2, "理赔流程如何申请"), (3, " renew Photos ")], "query_id int, text string")
    got = {r.query_id: r for r in tx.query_features(q).collect()}
    assert got[1].wants_recent and got[1].wants_pdf and got[1].identifiers == ["pdf", "err-42"] and "报错" in got[1].keywords and "怎么办" not in got[1].keywords
    assert got[2].keywords[0] == "理赔流程如何申请" and {"理赔流程", "理赔", "流程", "申请"} <= set(got[2].keywords)
    assert got[3].wants_recent and got[3].wants_image and got[3].normalized == "renew photos"


def test_top_k_limits(spark):
    for k in (0, 1001):
        with pytest.raises(ValueError):
            retrieve.check_k(k)


def test_rule_route_keeps_like_wildcards(spark):
    chunks = spark.createDataFrame([(1, "u", "aXb.pdf", i, 5, "t") for i in range(4)] + [(2, "v", "a_b.pdf", 0, 5, "t")], "file_id long, user_id string, file_name string, small_chunk_index int, created_epoch long, small_chunk_text string")
    q = spark.createDataFrame([(9, "u", ["a_b"])], "query_id long, user_id string, rule_tokens array<string>")
    assert [(r.file_id, r.small_chunk_index) for r in retrieve.rule_topk(q, chunks).sort("rank").collect()] == [(1, 0), (1, 1)]


def test_minmax_and_answers(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 7.0), (2, 3.0), (3, 4.0), (3, 4.0)], "query_id int, s double")
    assert sorted((r.query_id, r.t) for r in retrieve.minmax(df, ["query_id"], "s", "t").collect()) == [(1, 0.0), (1, 1.0), (2, 1.0), (3, 0.0), (3, 0.0)]


def test_fulltext_phrases_and_exclusions(spark):
    chunks = spark.createDataFrame([(1, "u", 0, "red fast car", "n.pdf"), (2, "u", 0, "fast red car", "n.pdf"), (3, "u", 0, "red fast bus", "n.pdf")], "file_id long, user_id string, small_chunk_index int, small_chunk_text string, file_name string")
    q = spark.createDataFrame([(1, "u", '"red fast" -bus'), (2, "u", "car red"), (3, "u", " ")], "query_id long, user_id string, text string")
    got = {(r.query_id, r.file_id) for r in retrieve.fulltext_topk(q, chunks).collect()}
    assert got == {(1, 1), (2, 1), (2, 2)}


def test_status_table(spark):
    rows = [("docx", "FAILED", "e", None, None, "FAILED", "e"), ("png", "VECTORIZED", None, "VECTORIZED", None, "VECTORIZED", None), ("png", "VECTORIZED", None, "PENDING", None, "PROCESSING", None), ("png", "PENDING", None, "FAILED", "i", "FAILED", "i"), ("pdf", "PROCESSING", None, "FAILED", "x", "PROCESSING", None)]
    df = spark.createDataFrame(rows, "file_ext string, text_status string, text_error string, image_status string, image_error string, want string, want_error string")
    assert all(r.status == r.want and r.error == r.want_error for r in catalog.aggregate_status(df).collect())


def test_repeats_and_empties(spark):
    steps = [(1, i, t is not None, t, "{}") for i, t in enumerate(["a", "a", None, "a", "b", None, None])]
    df = spark.createDataFrame(steps, "session_id int, step_index int, has_activity boolean, tool_name string, tool_args string")
    got = trace.step_metrics(df).sort("step_index").collect()
    assert [r.empty_steps for r in got] == [0, 0, 1, 0, 0, 1, 2]
    assert [r.repeated_actions for r in got] == [0, 1, 1, 2, 0, 0, 0]


def test_import_ids_number_duplicates(spark):
    df = spark.createDataFrame([(1, "Chapter 1", 1), (1, "chapter-1", 2), (1, "!!", 3), (1, "chapter 1!", 4)], "file_id int, raw_id string, pos int")
    assert [r.canvas_id for r in flow.import_ids(df, "ai-lane-").sort("pos").collect()] == ["ai-lane-chapter-1", "ai-lane-chapter-1-2", "ai-lane-item", "ai-lane-chapter-1-3"]


def test_sections_before_any_chapter(spark):
    lines = [(1, 0, "标题"), (1, 1, "1.1 甲"), (1, 2, "岗位：理赔员"), (1, 3, "职责：a；b"), (1, 4, "正文。后面"), (1, 5, "第一章 总则"), (1, 6, "1.2 乙"), (1, 7, "  ")]
    rows = flow.assign(flow.classify(spark.createDataFrame(lines, "file_id int, line_no int, line string")))
    s = {r.title: r for r in flow.sections(rows).collect()}
    assert s["甲"].chapter_no == 0 and s["甲"].role == "理赔员" and s["甲"].responsibilities == ["a", "b"] and s["甲"].summary == "正文。"
    assert s["乙"].chapter_no == 2 and s["乙"].content == ""
    assert {(r.chapter_id, r.title) for r in flow.chapters(rows).collect()} == {("chapter-0", "未分章内容"), ("chapter-2", "第一章 总则")}


def test_match_terms(spark):
    q = spark.createDataFrame([(1, "请根据 理赔手册 文件生成流程图"), (2, "请生成流程图"), (3, "从Claims_Guide用文档")], "query_id long, text string")
    got = {r.query_id: r.terms for r in flow.match_terms(q).collect()}
    assert got[1] == ["理赔手册", "请根据", "文件生成流程图"]
    assert got[2] == ["请生成流程图"]
    assert got[3] == ["claimsguide", "从claims", "guide用文档"]


def test_chapter_pattern_and_summary(spark):
    df = spark.createDataFrame([(1, 0, "1. 第十二章 总则"), (1, 1, "第X章 不是"), (1, 2, "1.1 甲"), (1, 3, "  先做。 后做！"), (1, 4, "内容：")], "file_id long, line_no int, line string")
    rows = flow.assign(flow.classify(df))
    assert [(r.kind, r.title) for r in rows.sort("line_no").collect()][:3] == [("chapter", "第十二章 总则"), ("text", None), ("section", "甲")]
    got = flow.sections(rows).first()
    assert (got.section_id, got.summary, got.content) == ("1.1", "先做。", "先做。 后做！")
    texts = spark.createDataFrame([("a. b",), ("。x! y",), ("",), ("z" * 90,)], "t string")
    assert [r[0] for r in texts.select(flow.summary(F.col("t"))).collect()] == ["a.", "。x!", "", "z" * 80]


def test_error_categories_and_observation_summaries(spark):
    codes = spark.createDataFrame([(c,) for c in ("INVALID_ARGUMENT", "PERMISSION_DENIED", "MISSING_SESSION_CONTEXT", "UNKNOWN_TOOL", "TIMEOUT", "TOOL_NOT_FOUND")], "code string")
    assert [r[0] for r in codes.select(trace.error_category(F.col("code"))).collect()] == ["validation", "permission", "permission", "unknown", "service", "service"]
    obs = spark.createDataFrame([("t", "ok", "secret payload", None, None), (" ", "error", " r ", "X", None), ("t", "error", "q" * 300, None, "m" * 161)], "tool_name string, status string, result string, error_message string, error_code string")
    obs = obs.withColumns({"error_message": F.col("error_code"), "error_code": F.when(F.col("error_message").isNotNull(), F.col("error_message"))})
    got = trace.observation_summary(obs).collect()
    assert [r.summary for r in got] == ["工具 t 调用成功", "工具 unknown_tool 调用失败: X", "工具 t 调用失败: ERROR (" + "m" * 157 + "...)"]
    assert [r.short for r in got] == ["secret payload", "r", "q" * 255 + "..."]


def test_text_protocol(spark):
    texts = ["Thought: t\nAction: {\"tool_name\": \"rag\", \"tool_args\": {\"query\": \"x\"}}", "Action: rag {\"query\": 1}\nFinal Answer: done\nmore", "Action: {\"tool_name\": \"rag\", \"tool_args\": 1}", "plain"]
    df = spark.createDataFrame(list(enumerate(texts)), "message_id long, text string")
    got = trace.decisions(df).sort("message_id").collect()
    assert [(r.decision_type, r.action, r.final_answer) for r in got] == [("tool_call", "rag", None), ("final_answer", None, "done"), ("final_answer", None, texts[2]), ("final_answer", None, "plain")]
    assert got[0].thought == "t" and got[0].args == '{"query":"x"}'


def test_file_kinds(spark):
    rows = [("a.png", None), ("b.gif", None), ("c", "application/msword"), ("d", "text/word"), (" E.PDF ", None), ("f.xlsx", None), ("g", "image/gif")]
    df = spark.createDataFrame(rows, "file_name string, mime_type string")
    kinds = retrieve.file_kind()
    got = df.select(*[k.alias(n) for n, k in kinds.items()]).collect()
    assert [[n for n in kinds if r[n]] for r in got] == [["image"], [], ["document"], [], ["pdf", "document"], ["document"], ["image"]]


def test_known_tools_and_their_parameters(spark):
    tools = {r.tool_name: (r.params, r.required, r.scopes, r.max_attempts) for r in trace.tool_table(spark).collect()}
    assert tools["get_file_detail"] == (["upload_id"], ["upload_id"], ["uploads:read"], 1)
    assert tools["query_users"] == ([], [], ["workspace:read_users"], 2)
    calls = spark.createDataFrame(
        [(1, "list_recent_files", '{"limit": 0}'), (2, "list_recent_files", '{"file_type": "video"}'), (3, "list_recent_files", '{"limit": 3, "file_type": "pdf"}'), (4, "search_knowledge_base", '{"top_k": 2}'), (5, "get_file_detail", '{"upload_id": "x"}')],
        "call_id long, tool_name string, args string",
    )
    got = {r.call_id: r.problem for r in trace.check_arguments(calls, trace.tool_parameters(spark)).collect()}
    assert got == {1: "limit:minimum", 2: "file_type:enum", 3: None, 4: "query:missing", 5: "upload_id:type"}


def test_images_are_embedded_with_their_prompt(spark):
    df = spark.createDataFrame([(1, "a", "data:x"), (2, None, "data:yy")], "id long, prompt string, url string")
    model = lambda pairs: [[3.0 * len(p), 4.0 * len(u), 9.0] for p, u in pairs]
    got = {r.id: [round(x, 6) for x in r.embedding] for r in embed.embed_images(df, "prompt", "url", model, 2).collect()}
    assert got == {1: [round(3 / 585**0.5, 6), round(24 / 585**0.5, 6)], 2: [0.0, 1.0]}


def test_names_are_found_as_by_like(spark):
    names = ["en_src1_12.pdf", "a.b", "x", "", "报告一.docx", "EN-src1.png", None]
    files = spark.createDataFrame([("u", k, n, k) for k, n in enumerate(names)] + [("v", 99, "en_src1_12.pdf", 1)], "user_id string, file_id long, file_name string, created_epoch long")
    asked = ["en", "en_src", "e_", "_", "__", "a_b", "报告", "src1_12", "pdf", "x", "n-s", "zz", "a%b"]
    got = {(r.token, r.file_id) for r in retrieve.name_hits(spark.createDataFrame([("u", t) for t in asked * 2], "user_id string, token string"), files).collect()}
    rows = spark.createDataFrame([(t,) for t in asked], "token string").crossJoin(files.where("user_id = 'u'")).where("lower(file_name) LIKE concat('%', token, '%')")
    assert got == {(r.token, r.file_id) for r in rows.collect()} and ("a_b", 1) in got


@pytest.mark.parametrize("limit", [1, 5, 7, 100])
def test_packing_is_greedy(spark, limit):
    lengths = [3, 2, 2, 9, 1, 1, 5, 7, 4, 4]
    want, total = [], 0
    for n in lengths:
        new = not want or total + n > limit
        want.append((want[-1] if want else -1) + new)
        total = n if new else total + n
    got = spark.range(1).select(chunk.greedy_groups(F.array(*map(F.lit, lengths)), limit).alias("g")).first().g
    assert got == want


def test_white_space_is_collapsed(spark):
    texts = ["a b", " a  b ", "a\t b", "a \tb", "\u3000a\u3000\u3000b\n", "  ", ""]
    got = [r.t for r in spark.createDataFrame([(t,) for t in texts], "s string").select(tx.collapse(F.col("s")).alias("t")).collect()]
    assert got == [" ".join(t.split()) for t in texts]


def one(spark, column, *values, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"v {kind}").select(column(F.col("v"))).collect()]


def test_white_space_of_every_kind_is_stripped(spark):
    assert one(spark, tx.strip, "\t　a b\x1f\n", "\n", None, "\x85 x\xa0") == ["a b", "", None, "x"]
    cells = spark.createDataFrame([(1, 1, 0, "a\n"), (1, 1, 1, "a"), (1, 1, 2, "\t")], "file_id long, row_no int, col_no int, text string")
    assert [r.text for r in clean.table_rows_to_segments(cells).collect()] == ["a"]
    native = spark.createDataFrame([(1, 1, "\n")], "file_id long, page int, text string")
    ocr = spark.createDataFrame([(1, 1, "seen")], "file_id long, page int, text string")
    assert clean.coalesce_ocr(native, ocr).first().source_type == "pdf_ocr"
    assert tx.query_features(spark.createDataFrame([("\treport.pdf\n",)], "text string")).first().normalized == "report.pdf"
    texts = spark.createDataFrame([(1, "\n", " m\n"), (2, None, "\t")], "id int, answer string, message string")
    assert [r.content for r in conversation.content_fallback(texts).sort("id").collect()] == ["m", "已完成检索。"]


def test_rewrites_keep_strings_only(spark):
    replies = ['{"queries":[1,"a",{"x":2}," b\\n","a"]}', '```json\n{"queries":["c"]}\n```', '```python\n{"queries":["d"]}\n```', '["e"]', '{"queries":"f"}', "", None, '```\n{"queries":["g"]}```']
    rows = spark.createDataFrame([(i, "\tq ", x) for i, x in enumerate(replies)], "query_id int, text string, reply string")
    assert [r.rewrites for r in retrieve.parse_rewrites(rows).sort("query_id").collect()] == [["a", "b"], ["c"], ["q"], ["q"], ["q"], ["q"], ["q"], ["g"]]


def test_content_is_read_at_any_depth(spark):
    got = one(spark, trace.content_text, '[{"content":"abc"}]', '{"text":"x"}', '"s\\n"', '[["a",[["b"]]],{"text":{"value":"c"}},{"text":{"v":1},"content":[{"content":{"text":"d"}}]},null,4]', "plain", None, "null", "[broken", "[" * 5000 + "]" * 5000)
    assert got[:8] == ["abc", "x", "s", "abcd", "plain", "", "", "[broken"] and len(got) == 9


def test_equal_arguments_have_one_key(spark):
    assert one(spark, tx.canonical_json, '{"b":2,"a":{"y":[1.50],"x":"é"}}', '{ "a" : {"x":"é","y":[1.5]}, "b":2}', "no json", None) == ['{"a":{"x":"é","y":[1.5]},"b":2}'] * 2 + ["no json", None]
    calls = spark.createDataFrame([("s", 1, "t", '{"a":1,"b":2}', "ok", True), ("s", 2, "t", '{"b":2,"a":1}', "ok", True), ("s", 3, "t", '{"b":3,"a":1}', "ok", True)], "session_id string, step_index int, tool_name string, tool_args string, status string, has_activity boolean")
    assert [r.reused for r in trace.tool_reuse(calls).sort("step_index").collect()] == [False, True, False]
    assert [r.repeated_actions for r in trace.step_metrics(calls).sort("step_index").collect()] == [0, 1, 0]


def test_arguments_keep_their_types(spark):
    given = {
        '{"query":"q"}': None, '{"query":1}': "query:type", '{"query":"q","top_k":"3"}': "top_k:type", '{"query":"q","top_k":true}': "top_k:type", '{"query":"q","top_k":1.0}': "top_k:type",
        '{"query":"q","top_k":0}': "top_k:minimum", '{"query":null}': "query:null", '{"top_k":1}': "query:missing", '{"query":"q","x":1}': "x:unexpected", '{"query":"q","top_k":null}': None, "[1]": "query:missing",
    }
    calls = spark.createDataFrame([(i, "search_knowledge_base", a) for i, a in enumerate(given)], "call_id int, tool_name string, args string")
    assert [r.problem for r in trace.check_arguments(calls, trace.tool_parameters(spark)).sort("call_id").collect()] == list(given.values())
    enum = spark.createDataFrame([(1, "list_recent_files", '{"file_type":"odd"}')], "call_id int, tool_name string, args string")
    assert trace.check_arguments(enum, trace.tool_parameters(spark)).first().problem == "file_type:enum"


def test_calls_without_a_user_or_with_bad_arguments(spark):
    calls = spark.createDataFrame([(u, "query_users", {}, False) for u in (None, "", "u")], "user_id string, tool_name string, args map<string,string>, confirmed boolean")
    assert sorted(r.verdict for r in trace.guardrails(calls, trace.tool_table(spark)).collect()) == ["UNAUTHENTICATED", "UNAUTHENTICATED", "ok"]
    body = lambda name, args: json.dumps({"tool_calls": [{"id": "i", "function": {"name": name, "arguments": args}}]})
    rows = spark.createDataFrame([(1, body("t", "{bad")), (2, body("t", "[1]")), (3, body("t", " \n")), (4, body(" ", "{}")), (5, body("", "{}"))], "message_id int, completion string")
    got = [(r.message_id, r.tool_name, r.args, r.error) for r in trace.tool_calls(rows).sort("message_id").collect()]
    assert got == [(1, None, None, "Tool arguments must be valid JSON object."), (2, None, None, "Tool arguments must be a JSON object."), (3, "t", "{}", None), (4, " ", "{}", None)]


def test_ids_are_issued_once_and_newest_uploads_come_first(spark):
    nodes = spark.createDataFrame([(1, x, i) for i, x in enumerate(["a", "a", "a-2", "图", "A!", "item"])], "file_id long, raw_id string, pos int")
    assert [r.canvas_id for r in flow.import_ids(nodes, "n-").sort("pos").collect()] == ["n-a", "n-a-2", "n-a-2-2", "n-item", "n-a-3", "n-item-2"]
    links = spark.createDataFrame([(1, "e", "a", "a-2", 2), (1, "e", "a-2", "a", 1), (1, "f", "a", "none", 0)], "file_id long, edge_id string, source string, target string, pos int")
    assert [(r.edge_id, r.source_id) for r in flow.import_edges(links, flow.import_ids(nodes, "n-")).sort("edge_id").collect()] == [("ai-edge-e", "n-a-2-2"), ("ai-edge-e-2", "n-a")]
    files = spark.createDataFrame([(i, "u", "docx" if i < 2 else "pdf", f"plan{i}.docx", i) for i in range(4)], "file_id long, user_id string, file_ext string, file_name string, created_epoch long")
    asked = spark.createDataFrame([(1, "u", ["plan"])], "query_id long, user_id string, terms array<string>")
    assert [r.file_id for r in flow.candidates(asked, files, newest=3).collect()] == [1]
