"""Streams give what their batch twins give."""

from pyspark.sql import functions as F

from corpusloom.sources import files
from corpusloom.streaming import events as ev
from corpusloom.streaming import ingest
from corpusloom.streaming import stateful as st


def test_uploads_are_read_with_their_metadata(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"abc")
    (tmp_path / "b.png").write_bytes(b"x")
    got = {r.file_name: (r.file_ext, r.mime_type, r.file_size) for r in files.read_uploads(spark, str(tmp_path)).select("file_name", "file_ext", "mime_type", "file_size").collect()}
    assert got == {"a.PDF": ("pdf", "application/pdf", 3), "b.png": ("png", "image/png", 1)}


def test_keyed_sink_replaces_whole_keys(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = lambda *x: spark.createDataFrame(list(x), "file_id long, n int")
    files.write_by_bucket(rows((1, 1), (1, 2), (2, 1)), path, buckets=4)
    files.write_by_bucket(rows((1, 9), (3, 1)), path, buckets=4)
    assert sorted((r.file_id, r.n) for r in spark.read.parquet(path).collect()) == [(1, 9), (2, 1), (3, 1)]


def test_incremental_ingest_runs_each_file_once(spark, tmp_path):
    src, sink = str(tmp_path / "src"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (2, "b")], "file_id long, t string").write.parquet(src)
    run = lambda: ev.ingest_stream(spark.readStream.schema("file_id long, t string").parquet(src), lambda b: b.withColumn("t", F.upper("t")), lambda r: files.write_by_bucket(r, sink), str(tmp_path / "cp")).awaitTermination()
    run()
    spark.createDataFrame([(2, "c")], "file_id long, t string").write.mode("append").parquet(src)
    run()
    assert sorted((r.file_id, r.t) for r in spark.read.parquet(sink).collect()) == [(1, "A"), (2, "C")]


HOUR = 3600


def arrivals(spark, path, schema, *parts):
    """A stream of one file after the other, with ``at`` from ``t`` in hours."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path).withColumn("at", F.timestamp_seconds(F.col("t") * HOUR))


def collected(stream, mode, checkpoint, take):
    batches = []
    stream.writeStream.foreachBatch(lambda b, i: batches.append([take(r) for r in b.collect()])).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return batches


def test_step_metrics_take_late_steps_in_order_and_start_anew_after_a_pause(spark, tmp_path):
    st.use_rocksdb(spark)
    schema = "session_id string, t long, seq long, has_activity boolean, tool_name string, tool_args string"
    a = ("a", "{}")
    parts = [("s", 1, 1, True, *a), ("s", 3, 3, False, None, None), ("t", 1, 1, False, None, None)], [("s", 2, 2, True, *a), ("s", 5, 5, True, *a), ("s", 4, 4, False, None, None)], [("s", 60, 6, True, *a)], [("", 400, 0, True, None, None)]
    rows = arrivals(spark, str(tmp_path / "in"), schema, *parts)
    got = collected(st.step_metrics(rows), "append", str(tmp_path / "cp"), lambda r: (r.session_id, r.seq, r.empty_steps, r.repeated_actions))
    want = {("s", 1, 0, 0), ("s", 2, 0, 1), ("s", 3, 1, 1), ("s", 4, 2, 1), ("s", 5, 0, 2), ("s", 6, 0, 0), ("t", 1, 1, 0)}  # step 6 comes after a day
    assert {r for b in got for r in b} == want and sum(map(len, got)) == len(want) and got[0] == []


def test_last_n_over_batches_with_late_rows_and_a_pause(spark, tmp_path):
    st.use_rocksdb(spark)
    rows = arrivals(spark, str(tmp_path / "in"), "key string, t long, seq long, value string", [("k", 1, 1, "a"), ("k", 3, 3, "c"), ("l", 1, 9, "x")], [("k", 2, 2, "b"), ("k", 4, 4, "d")], [("k", 90, 5, "e")], [("k", 70, 6, "late")])
    got = collected(st.last_n(rows, 3), "update", str(tmp_path / "cp"), lambda r: (r.key, r.pos, r.seq, r.value))
    assert set(got[0]) == {("k", 1, 1, "a"), ("k", 2, 3, "c"), ("l", 1, 9, "x")}
    assert got[1] == [("k", 1, 2, "b"), ("k", 2, 3, "c"), ("k", 3, 4, "d")] and got[2] == [("k", 1, 5, "e")]
    assert not any(got[3:])  # twenty hours late: behind the watermark


def test_last_n_takes_up_the_rows_before_a_pause_that_a_late_row_fills(spark, tmp_path):
    st.use_rocksdb(spark)
    rows = arrivals(spark, str(tmp_path / "in"), "key string, t long, seq long, value string", [("k", 1, 1, "a"), ("k", 2, 2, "b"), ("k", 30, 4, "d")], [("k", 20, 3, "c")], [("k", 31, 5, "e")])
    got = collected(st.last_n(rows, 4), "update", str(tmp_path / "cp"), lambda r: (r.pos, r.seq))
    assert got[0] == [(1, 4)] and got[1] == [(1, 1), (2, 2), (3, 3), (4, 4)] and got[2] == [(1, 2), (2, 3), (3, 4), (4, 5)]


def test_assembly_waits_for_every_fragment(spark, tmp_path):
    st.use_rocksdb(spark)
    schema = "stream_id string, t long, seq long, done boolean, delta string, index int, id string, name string, arguments string"
    none = (None,) * 5
    parts = [("x", 1, 1, False, "b", -1, "id1", "f", "1"), ("x", 2, 3, True, *none), ("y", 1, 0, False, "yy", 1, "k", None, "{")], [("x", 1, 0, False, "a", None, None, None, None)], [("x", 2, 2, False, None, 1, None, "g", "2")], [("", 400, 0, False, *none)]
    got = collected(st.assemble(arrivals(spark, str(tmp_path / "in"), schema, *parts)), "append", str(tmp_path / "cp"), lambda r: (r.stream_id, r.finished, r["index"], r.id, r.name, r.body))
    assert got[:2] == [[], []] and set(got[2]) == {("x", True, None, None, None, "ab"), ("x", True, 0, "id1", "f", "1"), ("x", True, 1, None, "g", "2")}
    assert {r for b in got[3:] for r in b} == {("y", False, None, None, None, "yy"), ("y", False, 1, "k", None, "{")}


def test_assembly_keeps_a_bucket_s_streams_under_one_key(spark, tmp_path, monkeypatch):
    """Streams that end in the first, second or no batch, with line ends and quotes; a key for each stream took 12 ms a batch."""
    st.use_rocksdb(spark)
    monkeypatch.setattr(st, "BUCKETS", 16)
    schema = "stream_id string, t long, seq long, done boolean, delta string, index int, id string, name string, arguments string"
    one, two, none = (lambda i: f'{i}\n"a"'), (lambda i: f"\\b{i}\u2028"), (None,) * 5
    parts = [[], [], [("", 400, 0, False, *none)]]
    for i in range(400):
        parts[0] += [(f"s{i}", i % 5, 0, False, one(i), None, None, None, None)]
        parts[i % 2] += [(f"s{i}", 6, 1, False, two(i), 0, "k", None, "{")]
        parts[i % 2] += [(f"s{i}", 7, 2, True, *none)] if i % 3 else []
    rows = arrivals(spark, str(tmp_path / "in"), schema, *parts)
    batches = []
    query = st.assemble(rows).writeStream.foreachBatch(lambda b, _: batches.append({tuple(r) for r in b.collect()})).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    whole = lambda some, finished: {x for i in some for x in ((f"s{i}", finished, None, None, None, one(i) + two(i)), (f"s{i}", finished, 0, "k", None, "{"))}
    assert batches[0] == whole((i for i in range(0, 400, 2) if i % 3), True) and batches[1] == whole((i for i in range(1, 400, 2) if i % 3), True)
    assert set().union(*batches[2:]) == whole(range(0, 400, 3), False)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 16 * 4


def test_ingest_isolates_failures_and_skips_finished_batches(spark, tmp_path):
    path, calls = f"file://{tmp_path}/tables", tmp_path / "calls"
    chunked = lambda rows: rows.where("text <> ''").select("file_id", F.lit(0).alias("small_chunk_index"), F.col("text").alias("small_chunk_text"))

    def model(texts):
        with open(calls, "a") as f:
            f.write(f"{len(texts)}\n")
        if "bad" in texts:
            raise ValueError("x" * 900)
        return [[1.0, 0.0] for _ in texts]

    rows = lambda *x: spark.createDataFrame(list(x), "file_id long, text string")
    run = lambda rows, batch: ingest.run_batch(rows, batch, path, F.when(F.col("text").isNull(), "no content"), chunked, model, 2)
    run(rows((1, "a"), (2, "bad"), (3, None), (4, "")), 0)
    got = {r.file_id: (r.status, r.error, r.n_chunks) for r in ingest.statuses(spark, path).collect()}
    assert got == {1: ("VECTORIZED", None, 1), 2: ("FAILED", "x" * 500, 0), 3: ("FAILED", "no content", 0), 4: ("FAILED", "No text content extracted for vectorization", 0)}
    before = calls.read_text()
    run(rows((1, "again")), 0)
    assert calls.read_text() == before and ingest.finished_batches(spark, path) == {0}
    run(rows((2, "good"), (1, "bad")), 1)
    got = {r.file_id: r.status for r in ingest.statuses(spark, path).collect()}
    assert got == {1: "FAILED", 2: "VECTORIZED", 3: "FAILED", 4: "FAILED"}
    assert sorted((r.file_id, r.small_chunk_text) for r in spark.read.parquet(f"{path}/chunks").collect()) == [(1, "a"), (2, "good")]
