"""Uploads, statuses, trees, tenants, and table maintenance (lookup, upsert, replace, delete, schema)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALLOWED = ("docx", "png", "pdf")
MAX_BYTES = 10 * 1024 * 1024
RECENT = 12


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))


def validate_uploads(files: DataFrame, allowed: tuple[str, ...] = ALLOWED, max_size: int = MAX_BYTES) -> DataFrame:
    """Adds reject_reason (null for accepted files)."""
    ext, size = extension(F.col("file_name")), F.col("file_size")
    return files.withColumn("reject_reason", F.when(~ext.isin(*allowed), "extension").when(F.coalesce(size, F.lit(0)) <= 0, "empty").when(size > max_size, "too large"))


def with_object_key(files: DataFrame, token: Column | None = None) -> DataFrame:
    """Adds object_key uploads/YYYY/MM/DD/<token>.<ext> and its partition column upload_date."""
    at = F.timestamp_seconds("created_epoch")
    key = F.concat(F.lit("uploads/"), F.date_format(at, "yyyy/MM/dd"), F.lit("/"), token if token is not None else F.uuid(), F.lit("."), extension(F.col("file_name")))
    return files.withColumn("object_key", key).withColumn("upload_date", F.to_date(at))


def lookup(requests: DataFrame, files: DataFrame, key: str = "file_id") -> DataFrame:
    """The detail rows of (key, user_id) requests; another user's file is no row."""
    return requests.select(key, "user_id").join(files, [key, "user_id"])


def conform_schema(df: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """Adds every missing column with its (type, default); a default may be a Column. Others stay as they are."""
    for name, (kind, default) in columns.items():
        if name not in df.columns:
            df = df.withColumn(name, (default if isinstance(default, Column) else F.lit(default)).cast(kind))
    return df


def replace_by_key(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """All rows of a key that comes in are replaced by the incoming ones."""
    return current.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Incoming rows replace current rows of the same keys; among several the last by ``order`` stays."""
    every = current.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__new"), F.desc_nulls_last(order)))
    return every.withColumn("__n", last).where("__n = 1").drop("__n", "__new")


def cascade_delete(gone: DataFrame, key: str, *tables: tuple[DataFrame, str, str | None]) -> list[DataFrame]:
    """What stays of each table: (table, its key, the id that the next table's key refers to, if it does)."""
    out, keys = [], gone.select(F.col(key).alias("__k")).distinct()
    for df, own, next_id in tables:
        out.append(df.join(keys, df[own] == F.col("__k"), "left_anti"))
        if next_id:
            keys = df.join(keys, df[own] == F.col("__k"), "left_semi").select(F.col(next_id).alias("__k")).distinct()
    return out


def type_filter(kind: Column) -> Column:
    image = F.lower("mime_type").startswith("image/")
    return F.when(kind == "pdf", F.col("file_ext") == "pdf").when(kind == "image", image).when(kind == "document", ~image).otherwise(F.lit(True))


def recent_uploads(files: DataFrame, requests: DataFrame) -> DataFrame:
    """Newest files of each (user_id, file_type, limit) request: the window of max(12, limit) is cut before the type filter."""
    rows = requests.select("user_id", "file_type", F.col("limit").alias("n")).join(files, "user_id")
    by = Window.partitionBy("user_id", "file_type").orderBy(F.desc_nulls_last("created_epoch"), F.desc("file_id"))
    rows = rows.withColumn("w", F.row_number().over(by)).where(F.col("w") <= F.greatest(F.lit(RECENT), "n")).where(type_filter(F.col("file_type")))
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= F.col("n")).drop("w", "n")


def initial_channels(files: DataFrame) -> DataFrame:
    png = F.col("file_ext") == "png"
    return files.withColumn("text_status", F.lit("PENDING")).withColumn("image_status", F.when(png, "PENDING")).withColumn("aggregate_status", F.lit("PENDING"))


def aggregate_status(df: DataFrame) -> DataFrame:
    """Adds status and error from text_status, text_error, image_status, image_error: only a png has two channels."""
    t, i = F.col("text_status"), F.coalesce("image_status", F.lit("PENDING"))
    both = F.when((t == "FAILED") | (i == "FAILED"), "FAILED").when((t == "VECTORIZED") & (i == "VECTORIZED"), "VECTORIZED").when(t.isin("PROCESSING", "VECTORIZED") | i.isin("PROCESSING", "VECTORIZED"), "PROCESSING").otherwise("PENDING")
    error = F.when(t == "FAILED", F.col("text_error")).when(i == "FAILED", F.col("image_error"))
    png = F.col("file_ext") == "png"
    return df.withColumn("status", F.when(png, both).otherwise(t)).withColumn("error", F.when(png, error).otherwise(F.when(t == "FAILED", F.col("text_error"))))


def apply_ingest_result(files: DataFrame, results: DataFrame, now_epoch: int) -> DataFrame:
    """Files with the outcome of their ingest (file_id, chunk_count, failure): errors are cut to 1024 characters."""
    out = files.join(results, "file_id", "left")
    done = F.col("chunk_count").isNotNull() | F.col("failure").isNotNull()
    status = F.when(~done, F.col("text_vector_status")).when(F.col("failure").isNotNull(), "FAILED").otherwise("VECTORIZED")
    return out.select(*files.columns, status.alias("new_status"), F.substring("failure", 1, 1024).alias("vector_error"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.when(done & F.col("failure").isNull(), F.lit(now_epoch)).alias("vectorized_epoch"))


def tree_nodes(nodes: DataFrame) -> DataFrame:
    """Position of every node in its user's listing: parents ascending with roots last, then sort order, then age."""
    order = [F.asc_nulls_last("parent_id"), F.asc("sort_order"), F.asc("created_epoch"), F.asc("node_id")]
    return nodes.withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy(*order)))


def next_sort_order(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """(user_id, parent_id, next): one more than the largest sibling, 0 without siblings; a null parent is the root."""
    top = nodes.groupBy("user_id", F.col("parent_id").alias("p")).agg((F.max("sort_order") + 1).alias("n"))
    p = parents.withColumnRenamed("user_id", "u")
    return p.join(top, (F.col("u") == top["user_id"]) & F.col("parent_id").eqNullSafe(F.col("p")), "left").select(F.col("u").alias("user_id"), "parent_id", F.coalesce("n", F.lit(0)).alias("next"))


def ensure_roots(nodes: DataFrame, canvases: DataFrame, users: DataFrame, name: str = "默认节点") -> DataFrame:
    """``nodes`` with a root for every user who has none, named by the user's newest canvas, else root-<user>."""
    missing = users.select("user_id").distinct().join(nodes.where("parent_id is null").select("user_id"), "user_id", "left_anti")
    newest = canvases.groupBy("user_id").agg(F.max_by("node_id", F.struct("updated_epoch", "node_id")).alias("canvas_node"))
    root = missing.join(newest, "user_id", "left").select("user_id", F.coalesce("canvas_node", F.concat(F.lit("root-"), "user_id")).alias("node_id"), F.lit(name).alias("name"), F.lit(0).alias("sort_order"))
    return nodes.unionByName(root, allowMissingColumns=True)


def canvas_lookup(requests: DataFrame, canvases: DataFrame) -> DataFrame:
    """(user_id, node_id, exists, name, xml_content): a missing canvas is a row with empty values."""
    found = canvases.select("user_id", "node_id", F.col("name").alias("n"), F.col("xml_content").alias("x"), F.lit(True).alias("e"))
    out = requests.select("user_id", "node_id").join(found, ["user_id", "node_id"], "left")
    return out.select("user_id", "node_id", F.coalesce("e", F.lit(False)).alias("exists"), F.coalesce("n", F.lit("")).alias("name"), F.coalesce("x", F.lit("")).alias("xml_content"))


def list_by_user(df: DataFrame, by: str = "user_id", at: str = "created_epoch", key: str = "file_id") -> DataFrame:
    """Rows with their position in the newest-first list of their user."""
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(by).orderBy(F.desc_nulls_last(at), F.desc(key))))


def list_tenants(tenants: DataFrame) -> DataFrame:
    """Tenants, newest first, with their config parsed (bad JSON: none)."""
    return tenants.withColumn("config", F.from_json("config_json", "map<string,string>")).withColumn("pos", F.row_number().over(Window.partitionBy("enabled").orderBy(F.desc("created_epoch"), F.asc("tenant_id"))))


def route_tenants(requests: DataFrame, tenants: DataFrame, default: str = "default") -> DataFrame:
    """Adds routed and reject_reason: the default tenant or an enabled one passes."""
    known = tenants.select("tenant_id", "enabled")
    out = requests.join(known, "tenant_id", "left")
    ok = (F.col("tenant_id") == default) | F.coalesce("enabled", F.lit(False))
    return out.select(*requests.columns, ok.alias("routed"), F.when(ok, None).when(F.col("enabled").isNull(), "unknown").otherwise("disabled").alias("reject_reason"))
