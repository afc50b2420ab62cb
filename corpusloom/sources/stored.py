"""Derived tables (postings, indexes, ledgers) in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from corpusloom.sources.files import new_folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: what is built on it doesn't compute it again."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
