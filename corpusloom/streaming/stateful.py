"""Stateful stream operators in event time: newest n, step metrics and delta assembly.

All are ``transformWithState`` processors, over rows or pandas frames. Rows may come late by up to the watermark's delay and in any order (events
and steps behind the watermark are dropped); a key
that is idle for longer than ``ttl_ms`` of event time starts anew, and a timer drops its state. Timers follow the watermark,
so a run over what is there now ends.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY_MS = 24 * 3600 * 1000


def use_rocksdb(spark: SparkSession) -> None:
    """Processors keep their state in RocksDB; the setting belongs to the session that starts the query."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _timed(rows: DataFrame, delay: str) -> DataFrame:
    return rows.withColumn("us", F.unix_micros(F.col("at").cast("timestamp"))).withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", delay)


class _Processor(StatefulProcessor):
    ttl_ms: int

    def keep_one_timer(self, at_ms: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int(at_ms))

    def close(self) -> None:
        pass


class _LastN(_Processor):
    def __init__(self, n: int, ttl_ms: int):
        self.n, self.ttl_ms = n, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "us long, seq long, value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        new = [(int(us), int(seq), value) for f in rows for us, seq, value in zip(f["us"], f["seq"], f["value"], strict=True) if us // 1000 >= mark]
        if not new:
            return
        found = [*map(tuple, self.rows.get()), *new] if self.rows.exists() else new
        found.sort(key=lambda r: r[:2])
        found = found[-self.n :]
        self.rows.put(found)  # with what is before a pause: a late row may still come into it
        self.keep_one_timer(found[-1][0] // 1000 + self.ttl_ms + 1)
        gaps = [i for i in range(1, len(found)) if found[i][0] - found[i - 1][0] > self.ttl_ms * 1000]
        kept = found[gaps[-1] if gaps else 0 :]
        yield pd.DataFrame({"key": key[0], "pos": range(1, len(kept) + 1), "seq": [r[1] for r in kept], "value": [r[2] for r in kept]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.rows.clear()
        yield from ()


def last_n(events: DataFrame, n: int = 50, ttl_ms: int = DAY_MS, delay: str = "12 hours") -> DataFrame:
    """The current list of each touched key of (key, at, seq, value), in update mode: (key, pos, seq, value), oldest first.

    The list holds the newest ``n`` rows since the key's last pause of more than ``ttl_ms``; ``delay`` must be shorter."""
    rows = _timed(events, delay)
    return rows.groupBy("key").transformWithStateInPandas(_LastN(n, ttl_ms), "key string, pos int, seq long, value string", "Update", "EventTime")


class _StepMetrics(_Processor):
    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, seq long, active boolean, tool string, args string")
        self.last = handle.getValueState("last", "us long, empty long, tool string, args string, repeats long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        text = lambda x: None if pd.isna(x) else x
        mark = timerValues.getCurrentWatermarkInMs()
        new = [(int(us), int(seq), bool(a), text(tool), text(args)) for f in rows for us, seq, a, tool, args in zip(f["us"], f["seq"], f["has_activity"], f["tool_name"], f["tool_args"], strict=True) if us // 1000 >= mark]
        if not new:
            return
        self.waiting.appendList(new)
        self.keep_one_timer(min(r[0] for r in self.waiting.get()) // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Takes the steps that the watermark has passed, in order: none can come before them any more."""
        mark = timerValues.getCurrentWatermarkInMs()
        found = sorted(self.waiting.get(), key=lambda r: r[:2]) if self.waiting.exists() else []
        ready, later = [r for r in found if r[0] // 1000 < mark], [r for r in found if r[0] // 1000 >= mark]
        state = self.last.get() if self.last.exists() else None
        out = []
        for us, seq, active, tool, args in ready:
            before, empty, last_tool, last_args, repeats = state if state and us - state[0] <= self.ttl_ms * 1000 else (us, 0, None, None, 0)
            empty = 0 if active else empty + 1
            if tool is not None:
                repeats = repeats + 1 if (tool, args) == (last_tool, last_args) else 0
                last_tool, last_args = tool, args
            state = (us, empty, last_tool, last_args, repeats)
            out.append((key[0], seq, empty, repeats))
        if later:
            self.waiting.put(later)
            self.keep_one_timer(later[0][0] // 1000 + 1)
        else:
            self.waiting.clear()
        if state and (later or state[0] // 1000 + self.ttl_ms >= mark):
            self.last.update(state)
            if not later:
                self.keep_one_timer(state[0] // 1000 + self.ttl_ms + 1)
        else:
            self.last.clear()
        yield pd.DataFrame(out, columns=["session_id", "seq", "empty_steps", "repeated_actions"])


def step_metrics(trace: DataFrame, ttl_ms: int = DAY_MS, delay: str = "12 hours") -> DataFrame:
    """(session_id, seq, empty_steps, repeated_actions) of each step of (session_id, at, seq, has_activity, tool_name, tool_args),
    in append mode, once the watermark has passed it.

    Steps wait in the state until no earlier one can come, so late and shuffled rows are taken in order. After a pause of
    more than ``ttl_ms`` both counts start anew."""
    rows = _timed(trace, delay)
    return rows.groupBy("session_id").transformWithStateInPandas(_StepMetrics(ttl_ms), "session_id string, seq long, empty_steps long, repeated_actions long", "Append", "EventTime")


#: Streams that are put together share the state of their bucket, since a key costs milliseconds a batch, and their fragments
#: come as one column of text, since every cell costs as well.
BUCKETS = 1024
_REPLY = Row("stream_id", "finished", "index", "id", "name", "body")


class _Assembly(_Processor):
    """The streams of a bucket. The state has counts of each open stream and one text for each batch that brought fragments; the texts are
    only read when a stream ends. The timer is at or before the first stream's time to be given up."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getListState("parts", "fragments string")
        self.open = handle.getValueState("open", "streams string, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state = self.open.get()
        streams, timer = self.streams(state)
        new = []
        for _, packed in rows:
            f = json.loads(packed)
            stream = f.get("stream_id")
            n, size, last = streams.get(stream, (0, -1, 0))
            if not f["done"]:
                new.append(packed)
            streams[stream] = (n, f["seq"], max(last, f["us"])) if f["done"] else (n + 1, size, max(last, f["us"]))
        ended = {stream for stream, (n, size, _) in streams.items() if 0 <= size <= n}
        if ended:
            yield from self.take(ended, True, streams, self.held() if state else [], new)
        elif new:
            self.parts.appendList([("\n".join(new),)])
        self.keep(streams, timer, min(map(self.due, streams.values()), default=None))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        streams, _ = self.streams(self.open.get())
        mark = timerValues.getCurrentWatermarkInMs()
        if late := {stream for stream, s in streams.items() if self.due(s) < mark}:
            yield from self.take(late, False, streams, self.held(), [])
        self.keep(streams, None, min(map(self.due, streams.values()), default=None))

    def due(self, stream: tuple) -> int:
        return stream[2] // 1000 + self.ttl_ms + 1

    def streams(self, state: tuple | None) -> tuple[dict, int | None]:
        return ({stream: tuple(counts) for stream, *counts in json.loads(state[0])}, state[1]) if state else ({}, None)

    def held(self) -> list[str]:
        return [f for (lines,) in self.parts.get() for f in lines.split("\n")] if self.parts.exists() else []

    def keep(self, streams: dict, timer: int | None, first: int | None) -> None:
        """Stores the counts of open streams. A timer is moved only if it would be too late."""
        if first is None or timer is not None and first < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = None
        if first is None:
            self.open.clear()
            return
        if timer is None:
            self.handle.registerTimer(timer := first)
        self.open.update((json.dumps([(stream, *counts) for stream, counts in streams.items()]), timer))

    def take(self, ended: set, finished: bool, streams: dict, held: list, new: list) -> Iterator[Row]:
        """The rows of streams that end; they leave the state."""
        taken, rest = {stream: [] for stream in ended}, []
        for packed in (*held, *new):
            f = json.loads(packed)
            if (stream := f.get("stream_id")) in ended:
                taken[stream].append(f)
            else:
                rest.append(packed)
        for stream, fragments in taken.items():
            yield from self.result(stream, finished, fragments)
            del streams[stream]
        if rest:
            self.parts.put([("\n".join(rest),)])
        elif held:
            self.parts.clear()

    def result(self, stream: str | None, finished: bool, fragments: list[dict]) -> Iterator[Row]:
        """The text and the calls of the fragments."""
        deltas, calls = [], {}
        for f in fragments:
            if f.get("delta"):
                deltas.append((f["seq"], f["delta"]))
            call = f.get("id"), f.get("name"), f.get("arguments")
            if "index" in f or any(call):
                calls.setdefault(max(f.get("index", 0), 0), []).append((f["seq"], *call))
        if deltas:
            yield _REPLY(stream, finished, None, None, None, "".join(d for _, d in sorted(deltas)))
        for index, found in sorted(calls.items()):
            found.sort(key=lambda p: p[0])
            _, last = max([(-1, None), *((seq, i) for seq, i, _, _ in found if i)], key=lambda x: x[0])
            yield _REPLY(stream, finished, index, last, "".join(p[2] or "" for p in found) or None, "".join(p[3] or "" for p in found))


def assemble(fragments: DataFrame, ttl_ms: int = DAY_MS, delay: str = "12 hours") -> DataFrame:
    """Streamed replies put together: (stream_id, finished, index, id, name, body), in append mode.

    ``fragments``: (stream_id, at, seq, done, delta, index, id, name, arguments), in any order. A stream's rows come at its done
    event, whose seq is the number of fragments before it, once all of these are there; without one they come unfinished
    after ``ttl_ms``. The row without an index is the text, the others are tool calls: ids overwrite, names and arguments
    append, a missing or negative index is 0."""
    bucket = F.pmod(F.xxhash64("stream_id"), F.lit(BUCKETS)).alias("bucket")
    packed = F.to_json(F.struct("stream_id", "us", "seq", "done", "delta", "index", "id", "name", "arguments"), {"ignoreNullFields": "true"}).alias("fragment")
    rows = _timed(fragments, delay).select(bucket, packed)
    return rows.groupBy("bucket").transformWithState(_Assembly(ttl_ms), "stream_id string, finished boolean, index int, id string, name string, body string", "Append", "EventTime")

