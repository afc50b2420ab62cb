"""File source and the keyed chunk-table sink."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.catalog import extension

MIME = {"pdf": "application/pdf", "png": "image/png", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document"}


def _described(df: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return df.select("path", name.alias("file_name"), extension(name).alias("file_ext"), F.coalesce(kind[extension(name)], F.lit("application/octet-stream")).alias("mime_type"), F.col("length").alias("file_size"), F.col("modificationTime").alias("created_at"), "content")


def read_uploads(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Uploaded files as rows; ``content`` is only read where it is used. Spark's source skips files without bytes, which
    validation would reject anyway."""
    return _described(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path))


def stream_uploads(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    schema = "path string, modificationTime timestamp, length long, content binary"
    return _described(spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(path))


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """True if the path is there, asked of the path's own file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def is_folder(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def write_by_bucket(rows: DataFrame, path: str, key: str = "file_id", buckets: int = 16) -> None:
    """Replaces the rows of every incoming key in a table partitioned by key bucket.

    Incoming rows are computed once, into a stage of this call's own; only the touched buckets are read, and what takes their
    place is written beside the table before the first of them is exchanged, so a job that fails before leaves the old rows."""
    spark, stage = rows.sparkSession, f"{path.rstrip('/')}.stage-{uuid.uuid4().hex}"
    rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).write.parquet(f"{stage}/new")
    new = spark.read.parquet(f"{stage}/new")
    if not exists(spark, path):
        new.write.partitionBy("bucket").parquet(path)
        return
    current = spark.read.parquet(path)
    kept = current.join(new.select("bucket").distinct(), "bucket", "left_semi").join(new.select(key).distinct(), key, "left_anti")
    kept.unionByName(new, allowMissingColumns=True).write.parquet(f"{stage}/whole")
    spark.read.parquet(f"{stage}/whole").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("bucket").parquet(path)
