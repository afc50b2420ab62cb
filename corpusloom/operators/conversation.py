"""Conversations, messages, references, prompts and session memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import strip


def latest_conversation(conversations: DataFrame) -> DataFrame:
    """One row a user: the conversation with the last message, ties by age, then id."""
    order = [F.desc_nulls_last("last_message_at"), F.desc_nulls_last("created_at"), F.desc("conversation_id")]
    return conversations.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy(*order))).where("n = 1").drop("n")


def last_activity(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conversation_id").agg(F.max("created_at").alias("last_message_at"))


def messages_of(requests: DataFrame, conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages of requested conversations that the user owns, with their position in time."""
    own = requests.join(conversations.select("conversation_id", "user_id"), ["conversation_id", "user_id"])
    at = F.row_number().over(Window.partitionBy("conversation_id").orderBy("created_at", "message_id"))
    return messages.join(own, "conversation_id").withColumn("pos", at)


def recent_messages(messages: DataFrame, n: int = 6) -> DataFrame:
    """The newest ``n`` messages of each conversation, pos 1 for the oldest of them."""
    by = Window.partitionBy("conversation_id")
    new = messages.withColumn("back", F.row_number().over(by.orderBy(F.desc("created_at"), F.desc("message_id")))).where(F.col("back") <= n)
    return new.withColumn("pos", F.row_number().over(by.orderBy("created_at", "message_id"))).drop("back")


def nest_references(messages: DataFrame, refs: DataFrame) -> DataFrame:
    """Messages with their references as an ordered array; none is an empty array."""
    item = F.struct("ref_no", "reference_type", "upload_id", "file_name")
    nested = refs.groupBy("message_id").agg(F.array_sort(F.collect_list(item)).alias("refs"))
    out = messages.join(nested, "message_id", "left")
    return out.withColumn("refs", F.coalesce("refs", F.array().cast(nested.schema["refs"].dataType)))


def parse_payload(messages: DataFrame, payload: str = "payload_json") -> DataFrame:
    """Adds snippets, related_files and tool_trace of a JSON payload, each parsed alone; anything bad is empty."""
    parts = {"snippets": "array<struct<upload_id:long,file_name:string,score:double>>", "related_files": "array<struct<upload_id:long,file_name:string>>", "tool_trace": "array<struct<tool:string,status:string>>"}
    out = messages
    for name, kind in parts.items():
        text = F.get_json_object(payload, f"$.{name}")
        out = out.withColumn(name, F.coalesce(F.from_json(text, kind, {"mode": "PERMISSIVE"}), F.array().cast(kind)))
    return out


def content_fallback(messages: DataFrame) -> DataFrame:
    blank = lambda c: F.nullif(strip(c), F.lit(""))
    return messages.withColumn("content", F.coalesce(blank("answer"), blank("message"), F.lit("已完成检索。")))


def prompt_rows(messages: DataFrame, queries: DataFrame, memory: DataFrame, system: str, n: int = 4) -> DataFrame:
    """(query_id, pos, role, content): system rules, a memory line if there is one, the last ``n`` messages, trimmed, without blank
    ones (dropped after the cut; any role but assistant is user), then the query."""
    sys_rows = queries.select("query_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("at"), F.lit("system").alias("role"), F.lit(system).alias("content"))
    mem = queries.join(memory, "conversation_id").select("query_id", F.lit(1).alias("part"), F.lit(0).cast("long").alias("at"), F.lit("system").alias("role"), F.concat(F.lit("记住："), "summary").alias("content")).where("content <> '记住：'")
    past = recent_messages(messages, n).where(strip("content") != "")
    hist = queries.select("query_id", "conversation_id").join(past, "conversation_id").select("query_id", F.lit(2).alias("part"), F.col("pos").cast("long").alias("at"), F.when(F.col("role") == "assistant", "assistant").otherwise("user").alias("role"), strip("content").alias("content"))
    ask = queries.select("query_id", F.lit(3).alias("part"), F.lit(0).cast("long").alias("at"), F.lit("user").alias("role"), F.col("text").alias("content"))
    every = sys_rows.unionByName(mem).unionByName(hist).unionByName(ask)
    return every.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("part", "at")).alias("pos"), "role", "content")


def memory_read(memory: DataFrame, n: int = 20) -> DataFrame:
    """The newest ``n`` records of each session, oldest first."""
    if n <= 0:
        raise ValueError("n must be positive")
    by = Window.partitionBy("session_id")
    return memory.withColumn("back", F.row_number().over(by.orderBy(F.desc("at")))).where(F.col("back") <= n).withColumn("pos", F.row_number().over(by.orderBy("at"))).drop("back")


def memory_summary(memory: DataFrame, n: int = 20) -> DataFrame:
    """(session_id, n_items, summary): at most ``n`` contents joined by ' | '."""
    rows = memory_read(memory, n)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]), " | ")
    return rows.groupBy("session_id").agg(F.count("*").alias("n_items"), joined.alias("summary"))
