"""Incremental ingest with statuses: every batch of uploads becomes chunks with vectors, and each file ends VECTORIZED or FAILED.

Under one folder lie three tables. ``status`` is a log of (file_id, status, error, n_chunks), one part for each batch and step;
``chunks`` is replaced file by file; ``ledger`` names the finished batches. A batch that runs again overwrites its own parts and
replaces the same files, and one that the ledger has is skipped, so nothing is counted twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import embed
from corpusloom.sources.files import exists, write_by_bucket

STATUSES = ("PENDING", "PROCESSING", "VECTORIZED", "FAILED")
LOG = "file_id long, status string, error string, n_chunks long"
LONGEST_ERROR = 500


def statuses(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, status, error, n_chunks): the last entry of each file."""
    if not exists(spark, f"{path}/status"):
        return spark.createDataFrame([], LOG)
    log = spark.read.option("basePath", f"{path}/status").schema(f"{LOG}, batch long, step int").parquet(f"{path}/status")
    return log.groupBy("file_id").agg(F.max_by(F.struct("status", "error", "n_chunks"), F.struct("batch", "step")).alias("s")).select("file_id", "s.*")


def finished_batches(spark: SparkSession, path: str) -> set[int]:
    return {r.batch for r in spark.read.schema("n_files long, batch long").parquet(f"{path}/ledger").select("batch").distinct().collect()} if exists(spark, f"{path}/ledger") else set()


def run_batch(uploads: DataFrame, batch: int, path: str, problem: Column, chunked: Callable[[DataFrame], DataFrame], model: embed.Embedder, dim: int) -> None:
    """One batch of uploads with a file_id. ``problem`` says why a file can't be read, or null; ``chunked`` gives its rows with
    file_id, small_chunk_index and small_chunk_text. A file with a problem, without text, or with a chunk that the model
    refuses is FAILED and its rows stay as they were; the others of the batch go on."""
    spark = uploads.sparkSession
    if batch in finished_batches(spark, path):
        return

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}/batch={batch}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}/batch={batch}")

    def note(rows: DataFrame, step: int) -> None:
        rows.select("file_id", "status", F.substring("error", 1, LONGEST_ERROR).alias("error"), F.col("n_chunks").cast("long").alias("n_chunks")).write.mode("overwrite").parquet(f"{path}/status/batch={batch}/step={step}")

    whole = kept(uploads, "arrived")
    files = whole.select("file_id", problem.alias("problem")).groupBy("file_id").agg(F.max("problem").alias("problem"))
    plain = files.select("file_id", F.lit(None).cast("string").alias("error"), F.lit(None).alias("n_chunks"))
    for step, status in enumerate(STATUSES[:2]):
        note(plain.withColumn("status", F.lit(status)), step)
    good = whole.join(files.where("problem is null").select("file_id"), "file_id", "left_semi")
    rows = kept(embed.try_embed(chunked(good), "small_chunk_text", model, dim), "embedded")
    found = rows.groupBy("file_id").agg(F.count("*").alias("n"), F.min("error").alias("refused"))
    ends = files.join(found, "file_id", "left").withColumn("error", F.coalesce("problem", "refused", F.when(F.col("n").isNull(), "No text content extracted for vectorization")))
    ends = ends.select("file_id", F.when(F.col("error").isNull(), STATUSES[2]).otherwise(STATUSES[3]).alias("status"), "error", F.when(F.col("error").isNull(), F.col("n")).otherwise(0).alias("n_chunks"))
    ends = kept(ends, "ended")
    write_by_bucket(rows.drop("error").join(ends.where(F.col("status") == STATUSES[2]).select("file_id"), "file_id", "left_semi"), f"{path}/chunks")
    note(ends, 2)
    ends.agg(F.count("*").alias("n_files")).write.mode("overwrite").parquet(f"{path}/ledger/batch={batch}")


def ingest(uploads: DataFrame, path: str, checkpoint: str, problem: Column, chunked: Callable[[DataFrame], DataFrame], model: embed.Embedder, dim: int):
    """Runs ``run_batch`` over what is new in the stream ``uploads``."""
    each = lambda rows, batch: run_batch(rows, batch, path, problem, chunked, model, dim)
    return uploads.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
