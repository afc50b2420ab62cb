"""Event rows: last n, delta assembly, SSE text, contract checks and incremental ingest. ``stateful`` has the stream twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import strip

MARKS = ["Thought:", "Action:", "Final Answer:"]
REQUIRED = {"assistant_delta": ["delta"], "assistant_done": ["message"], "error": ["message"], "reasoning": ["text"], "debug": ["text"]}
LENIENT = ("reasoning", "debug")


def last_n_batch(events: DataFrame, key: str, order: list[str], n: int = 50) -> DataFrame:
    """The newest ``n`` rows of each key with their replay position, oldest first."""
    w = Window.partitionBy(key)
    rows = events.withColumn("back", F.row_number().over(w.orderBy(*[F.desc(c) for c in order]))).where(F.col("back") <= n)
    return rows.withColumn("pos", F.row_number().over(w.orderBy(*order))).drop("back")


def visible(delta: Column) -> Column:
    """False for blank deltas and those with protocol marks."""
    out = strip(F.coalesce(delta, F.lit(""))) != ""
    for m in MARKS:
        out = out & ~delta.contains(m)
    return out


def assemble_text(deltas: DataFrame) -> DataFrame:
    """(stream_id, n_deltas, text): text deltas in order of seq."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "delta")))
    return deltas.groupBy("stream_id").agg(F.count("*").alias("n_deltas"), F.array_join(F.transform(parts, lambda x: x["delta"]), "").alias("text"))


def assemble_calls(fragments: DataFrame) -> DataFrame:
    """(stream_id, index, id, name, arguments) of (stream_id, seq, index, id, name, arguments) fragments: ids overwrite, names
    and arguments append; a missing or negative index is 0."""
    idx = F.when(F.col("index") >= 0, F.col("index")).otherwise(0)
    rows = fragments.withColumn("index", F.coalesce(idx, F.lit(0)))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce(c, F.lit("")).alias("t")))), lambda x: x["t"]), "")
    last = F.max_by("id", F.when(F.col("id").isNotNull(), F.col("seq")))
    return rows.groupBy("stream_id", "index").agg(last.alias("id"), F.nullif(joined("name"), F.lit("")).alias("name"), joined("arguments").alias("arguments"))


def parse_sse(raw: DataFrame) -> DataFrame:
    """(stream_id, event_no, event, data, bad): blocks between blank lines; the name defaults to message, blocks without data
    go, data that isn't JSON is marked."""
    blocks = F.split(F.regexp_replace("raw", "\r\n", "\n"), "\n\n+")
    rows = raw.select("stream_id", F.posexplode(blocks).alias("event_no", "block")).withColumn("lines", F.split("block", "\n"))
    of = lambda p: F.transform(F.filter("lines", lambda x: x.startswith(p)), lambda x: strip(F.substring(x, len(p) + 1, 1 << 30)))
    rows = rows.withColumn("data", F.array_join(of("data:"), "\n")).where(F.size(of("data:")) > 0)
    name = F.coalesce(F.get(of("event:"), -1 + F.size(of("event:"))), F.lit("message"))
    return rows.select("stream_id", "event_no", name.alias("event"), "data", F.try_parse_json("data").isNull().alias("bad"))


def check_events(events: DataFrame) -> DataFrame:
    """(stream_id, n_events, n_ignored, n_errors, valid): required fields by event type; malformed debug and reasoning events
    are ignored, others are errors; a stream needs assistant_done or error."""
    missing = F.lit(False)
    for name, fields in REQUIRED.items():
        for f in fields:
            missing = missing | ((F.col("event") == name) & F.get_json_object("data", f"$.{f}").isNull())
    wrong = F.col("bad") | missing
    lenient = F.col("event").isin(*LENIENT)
    ends = F.col("event").isin("assistant_done", "error") & ~wrong
    out = events.groupBy("stream_id").agg(F.count("*").alias("n_events"), F.count_if(wrong & lenient).alias("n_ignored"), F.count_if(wrong & ~lenient).alias("n_errors"), F.max(ends).alias("ended"))
    return out.select("stream_id", "n_events", "n_ignored", "n_errors", (F.col("ended") & (F.col("n_errors") == 0)).alias("valid"))


def ingest_stream(uploads: DataFrame, transform: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame], None], checkpoint: str):
    """Runs the ingest over what is new in ``uploads`` and hands every batch's rows to ``sink`` (a keyed replace, so a
    batch that runs twice writes the same rows)."""
    return uploads.writeStream.foreachBatch(lambda batch, _: sink(transform(batch))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
