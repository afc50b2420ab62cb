"""Agent traces: rows, step metrics, terminations, reuse, guardrails, arguments, parsing and call metrics."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import WHITE, canonical_json, strip

MAX_STEPS, MAX_REPEATS, MAX_EMPTY = 6, 3, 2
# Categories of error codes; any other code is a service error.
CATEGORIES = {
    "INVALID_ARGUMENT": "validation", "PERMISSION_DENIED": "permission", "MISSING_USER_CONTEXT": "permission", "MISSING_SESSION_CONTEXT": "permission",
    "UNKNOWN_TOOL": "unknown",
}


def _order() -> Window:
    return Window.partitionBy("session_id").orderBy("step_index")


def trace_rows(steps: DataFrame) -> DataFrame:
    """One trace row for each phase of (conversation_id, session_id, step_index, tool_name, args map, reason, observation, status,
    created_at): reason, action, observation and, where a status ends the session, termination. Steps without a
    conversation are skipped; times are UTC."""
    base = steps.where(strip("conversation_id") != "")
    part = lambda phase, keep, **c: base.where(keep).select("conversation_id", "session_id", "step_index", F.lit(phase).alias("phase"), *[x.alias(n) for n, x in {"tool_name": F.lit(None).cast("string"), "tool_args_json": F.lit(None).cast("string"), "observation_json": F.lit(None).cast("string"), "reason_summary": F.lit(None).cast("string"), **c}.items()], "status", "created_at")
    return (
        part("reason", "true", reason_summary=F.col("reason"))
        .unionByName(part("action", "tool_name is not null", tool_name=F.col("tool_name"), tool_args_json=F.to_json("args")))
        .unionByName(part("observation", "observation is not null", tool_name=F.col("tool_name"), observation_json=F.to_json(F.struct("observation"))))
        .unionByName(part("termination", "status in ('completed', 'failed', 'waiting_input')"))
    )


def step_metrics(steps: DataFrame) -> DataFrame:
    """Adds empty_steps (since the last step with activity) and repeated_actions (run of one (tool, args), less one).

    Gaps and islands: a running count of activity, or of changes, names the island; the rank within it is the figure."""
    island = F.sum(F.col("has_activity").cast("int")).over(_order())
    rows = steps.withColumn("island", island)
    empties = F.sum((~F.col("has_activity")).cast("int")).over(Window.partitionBy("session_id", "island").orderBy("step_index"))
    rows = rows.withColumn("empty_steps", F.when(F.col("has_activity"), 0).otherwise(empties).cast("long")).drop("island")
    key = F.struct("tool_name", "tool_args")
    calls = rows.where("tool_name is not null").select("session_id", "step_index", "tool_name", canonical_json("tool_args").alias("tool_args"))
    changed = F.coalesce((F.lag(key).over(_order()) != key), F.lit(True)).cast("int")
    calls = calls.withColumn("changed", changed).withColumn("run", F.sum("changed").over(_order()))
    repeats = calls.select("session_id", "step_index", (F.row_number().over(Window.partitionBy("session_id", "run").orderBy("step_index")) - 1).alias("r"))
    out = rows.join(repeats, ["session_id", "step_index"], "left")
    carried = F.last("r", ignorenulls=True).over(_order())
    return out.withColumn("repeated_actions", F.coalesce(carried, F.lit(0)).cast("long")).drop("r")


def termination(final: Column, decision: Column) -> Column:
    """Why a step ends its session, the first that holds; else running."""
    step = F.col("step_no")
    return (
        F.when(final.isNotNull(), "completed").when(decision == "waiting_input", "waiting_input").when(decision == "final_answer", "final_answer")
        .when(step >= MAX_STEPS, "max_steps").when(F.col("repeated_actions") >= MAX_REPEATS, "repeated_action").when(F.col("empty_steps") >= MAX_EMPTY, "empty_steps").otherwise("running")
    )


def terminations(metrics: DataFrame) -> DataFrame:
    """(session_id, step_no, reason): the first step at which each session stops."""
    rows = metrics.withColumn("step_no", F.row_number().over(_order())).withColumn("reason", termination(F.col("final_response"), F.col("decision_type")))
    return rows.where("reason <> 'running'").groupBy("session_id").agg(F.min("step_no").alias("step_no"), F.min_by("reason", "step_no").alias("reason"))


def tool_reuse(calls: DataFrame) -> DataFrame:
    """Adds reused: an equal call succeeded in the session before; arguments in JSON are equal whatever the order of their keys."""
    before = Window.partitionBy("session_id", "tool_name", canonical_json("tool_args")).orderBy("step_index").rowsBetween(Window.unboundedPreceding, -1)
    return calls.withColumn("reused", F.coalesce(F.sum((F.col("status") == "ok").cast("int")).over(before), F.lit(0)) > 0)


def session_outcome(trace: DataFrame) -> DataFrame:
    """(session_id, final_status, n_calls, tool_trace): status of the last row, calls in order."""
    item = F.struct("step_index", F.concat_ws(":", "tool_name", "status").alias("t"))
    calls = F.array_sort(F.collect_list(F.when(F.col("tool_name").isNotNull(), item)))
    return trace.groupBy("session_id").agg(F.max_by("status", "step_index").alias("final_status"), F.count("tool_name").alias("n_calls"), F.array_join(F.transform(calls, lambda x: x["t"]), ",").alias("tool_trace"))


def retry_outcome(steps: DataFrame, retries: int = 1) -> DataFrame:
    """(session_id, failed_at): the first error that isn't retryable or comes after the retries are used up."""
    error = F.col("status") == "error"
    used = F.sum(error.cast("int")).over(_order())
    rows = steps.withColumn("used", used).where(error & (~F.col("retryable") | (F.col("used") > retries)))
    return rows.groupBy("session_id").agg(F.min("step_index").alias("failed_at"))


# Tools with scopes, whether errors are retried and how often, and their parameters (name, kind, required, minimum, allowed values).
TOOLS = [
    ("query_users", ["workspace:read_users"], True, 2, []),
    ("list_recent_files", ["uploads:list"], True, 2, [("limit", "integer", False, 1.0, None), ("file_type", "string", False, None, ["pdf", "image", "document"])]),
    ("get_file_detail", ["uploads:read"], True, 1, [("upload_id", "integer", True, None, None)]),
    ("search_knowledge_base", ["rag:search"], True, 2, [("query", "string", True, None, None), ("top_k", "integer", False, 1.0, None)]),
]


def tool_table(spark, rows: list[tuple] | None = None) -> DataFrame:
    """Tools as a table: name, parameter names, required ones, whether confirmation is needed, whether errors are retried,
    attempts, scopes. ``rows`` replaces the known tools."""
    known = [(name, [p[0] for p in params], [p[0] for p in params if p[2]], False, retryable, attempts, scopes) for name, scopes, retryable, attempts, params in TOOLS]
    return spark.createDataFrame(known if rows is None else rows, "tool_name string, params array<string>, required array<string>, confirm boolean, retryable boolean, max_attempts int, scopes array<string>")


def tool_parameters(spark) -> DataFrame:
    """The known tools' parameters, one row each, as ``check_arguments`` takes them."""
    rows = [(name, p, k, kind, required, least, allowed) for name, _, _, _, params in TOOLS for k, (p, kind, required, least, allowed) in enumerate(params, 1)]
    return spark.createDataFrame(rows, "tool_name string, param string, pos int, kind string, required boolean, minimum double, allowed array<string>")


def guardrails(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """Adds verdict for (user_id, tool_name, args map, confirmed): the first problem, or ok."""
    rows = calls.join(tools, "tool_name", "left")
    missing = F.array_except("required", F.coalesce(F.map_keys("args"), F.array().cast("array<string>")))
    verdict = F.when(F.coalesce(F.col("user_id").cast("string"), F.lit("")) == "", "UNAUTHENTICATED").when(F.col("params").isNull(), "TOOL_MISMATCH").when(F.size(missing) > 0, "MISSING_ARGUMENTS").when(F.col("confirm") & ~F.col("confirmed"), "CONFIRMATION_REQUIRED").otherwise("ok")
    return rows.withColumn("verdict", verdict).drop("params", "required", "confirm", "retryable", "max_attempts", "scopes")


def check_arguments(calls: DataFrame, parameters: DataFrame) -> DataFrame:
    """(call_id, problem): a missing required argument, else the first given one that breaks its parameter's rule (unexpected,
    null where required, type, minimum, enum). A null of an optional parameter is fine.

    ``args`` is a JSON object, whose values keep their types: a number is no string, and neither ``true`` nor 1.0 an integer. What
    isn't an object has no arguments. ``parameters``: tool_name, param, pos, kind, required, minimum, allowed; few rows a tool."""
    calls = calls.withColumn("args", F.from_json("args", "map<string,variant>"))
    given = calls.select("call_id", "tool_name", F.posexplode("args").alias("at", "param", "v"))
    given = given.select("call_id", "tool_name", "at", "param", F.coalesce(F.schema_of_variant("v"), F.lit("VOID")).alias("is"), F.try_variant_get("v", "$", "string").alias("value"))
    known = given.join(parameters, ["tool_name", "param"], "left")
    kind, given_as = F.col("kind"), F.col("is")
    bad = (
        F.when(F.col("pos").isNull(), "unexpected").when(given_as == "VOID", F.when(F.col("required"), "null"))
        .when(((kind == "integer") & (given_as != "BIGINT")) | ((kind == "string") & (given_as != "STRING")), "type")
        .when((given_as == "BIGINT") & (F.col("value").try_cast("double") < F.col("minimum")), "minimum").when(F.col("allowed").isNotNull() & ~F.array_contains("allowed", F.col("value")), "enum")
    )
    wrong = known.withColumn("bad", bad).where("bad is not null").select("call_id", F.lit(1).alias("part"), "at", "param", "bad")
    need = calls.join(parameters.where("required"), "tool_name").where(~F.coalesce(F.map_contains_key("args", F.col("param")), F.lit(False))).select("call_id", F.lit(0).alias("part"), F.col("pos").alias("at"), "param", F.lit("missing").alias("bad"))
    first = wrong.unionByName(need).groupBy("call_id").agg(F.min_by(F.concat_ws(":", "param", "bad"), F.struct("part", "at", "param")).alias("problem"))
    return calls.select("call_id").join(first, "call_id", "left")


def error_category(code: Column) -> Column:
    out = F.when(code.isNull(), None)
    for name, kind in CATEGORIES.items():
        out = out.when(code == name, kind)
    return out.otherwise("service")


def call_metrics(calls: DataFrame, by: list[str]) -> DataFrame:
    """Totals, failures, cache hit rate (0 without look-ups) and mean elapsed time."""
    return calls.groupBy(*by).agg(
        F.count("*").alias("calls"), F.count_if(F.col("failed")).alias("failures"), F.count_if(F.col("hit")).alias("hits"),
        F.coalesce(F.try_divide(F.count_if(F.col("hit")).cast("double"), F.count("hit").cast("double")), F.lit(0.0)).alias("hit_rate"), F.avg("elapsed_ms").alias("avg_elapsed_ms"),
    )


def _text_of(content: object) -> str:
    """Texts of a parsed content in order, whatever its depth."""
    out, left = [], [content]
    while left:
        x = left.pop()
        if isinstance(x, str):
            out.append(x)
        elif isinstance(x, list):
            left += reversed(x)
        elif isinstance(x, dict):
            text = x.get("text")
            value = text.get("value") if isinstance(text, dict) else text
            left.append(value if isinstance(value, str) else x.get("content"))
    return "".join(out)


def content_text(content: Column) -> Column:
    """Text of a message's content, stripped. JSON strings, lists and objects (text, text.value or nested content, at any
    depth) are read by a small Arrow-batched function; a text that is no JSON is itself, and a null is empty."""

    @F.pandas_udf("string")
    def parsed(values: pd.Series) -> pd.Series:
        def one(v: str) -> str:
            try:
                return _text_of(json.loads(v))
            except (ValueError, RecursionError):
                return v

        return values.map(one)

    text = F.coalesce(content, F.lit(""))
    return strip(F.when(strip(text).rlike(r'^[\[{"]'), parsed(text)).when(strip(text) == "null", "").otherwise(text))


# What is wrong with a call's arguments.
BAD_JSON, NO_OBJECT = "Tool arguments must be valid JSON object.", "Tool arguments must be a JSON object."


def tool_calls(completions: DataFrame) -> DataFrame:
    """(message_id, call_no, tool_name, args, error): calls in a completion's tool_calls. Calls with an empty name are skipped; one
    with bad arguments turns the whole message into an error without calls, the first call's."""
    kind = "array<struct<id:string,function:struct<name:string,arguments:string>>>"
    rows = completions.select("message_id", F.posexplode(F.from_json(F.get_json_object("completion", "$.tool_calls"), kind)).alias("call_no", "c"))
    rows = rows.where(F.coalesce("c.function.name", F.lit("")) != "")
    args = F.col("c.function.arguments")
    blank = strip(F.coalesce(args, F.lit(""))) == ""
    rows = rows.withColumn("args", F.when(blank, "{}").otherwise(args))
    bad = F.when(F.try_parse_json("args").isNull(), BAD_JSON).when(~strip("args").startswith("{"), NO_OBJECT)
    rows = rows.withColumn("bad", bad)
    broken = F.max(F.col("bad").isNotNull()).over(Window.partitionBy("message_id"))
    rows = rows.withColumn("broken", broken).where(~F.col("broken") | F.col("bad").isNotNull())
    first = F.row_number().over(Window.partitionBy("message_id").orderBy("call_no"))
    rows = rows.withColumn("n", first).where(~F.col("broken") | (F.col("n") == 1))
    return rows.select("message_id", "call_no", F.when(~F.col("broken"), F.col("c.function.name")).alias("tool_name"), F.when(~F.col("broken"), F.col("args")).alias("args"), F.when(F.col("broken"), F.col("bad")).alias("error"))


def decisions(texts: DataFrame) -> DataFrame:
    """(message_id, thought, action, args, final_answer, decision_type) of the text protocol, the first line of each kind:
    ``Thought: ...``, ``Action: {"tool_name": ..., "tool_args": {...}}`` and ``Final Answer: ...``. An action that isn't such an
    object is none; a text without an action or a final answer is itself the final answer."""
    t = strip("text")
    line = lambda name, what: F.nullif(strip(F.regexp_extract(t, rf"(?mi)^\s*{name}:\s*({what})\s*$", 1)), F.lit(""))
    action, final = line("Action", r"\{.*\}"), line("Final Answer", ".+?")
    name, args = strip(F.get_json_object(action, "$.tool_name")), F.get_json_object(action, "$.tool_args")
    call = F.coalesce(F.try_parse_json(action).isNotNull() & (name != "") & args.startswith("{"), F.lit(False))
    return texts.select("message_id", line("Thought", ".+?").alias("thought"), F.when(call, name).alias("action"), F.when(call, args).alias("args"), F.when(~call, F.coalesce(final, t)).alias("final_answer"), F.when(call, "tool_call").otherwise("final_answer").alias("decision_type"))


def observation_summary(obs: DataFrame, white: str = WHITE) -> DataFrame:
    """Adds summary (success, or failure with code and message cut at 157 characters; never the payload) and short (result
    cut at 255 and '...' when over 256). The characters of ``white`` go from the ends of message and result, and from a cut end."""
    name = F.coalesce(F.nullif(strip("tool_name"), F.lit("")), F.lit("unknown_tool"))
    message = F.btrim(F.coalesce("error_message", F.lit("")), F.lit(white))
    message = F.when(F.length(message) > 160, F.concat(F.substring(message, 1, 157), F.lit("..."))).otherwise(message)
    code = F.coalesce(F.nullif("error_code", F.lit("")), F.lit("ERROR"))
    failed = F.concat(F.lit("工具 "), name, F.lit(" 调用失败: "), code, F.when(message != "", F.concat(F.lit(" ("), message, F.lit(")"))).otherwise(""))
    body = F.btrim(F.coalesce("result", F.lit("")), F.lit(white))
    short = F.when(F.length(body) > 256, F.concat(F.rtrim(F.substring(body, 1, 255), F.lit(white)), F.lit("..."))).otherwise(body)
    return obs.withColumn("summary", F.when(F.col("status") == "ok", F.concat(F.lit("工具 "), name, F.lit(" 调用成功"))).otherwise(failed)).withColumn("short", short)
