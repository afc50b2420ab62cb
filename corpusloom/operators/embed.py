"""Batch embedding with a pluggable model."""

from __future__ import annotations

import re
import time
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import vectors as vec

Embedder = Callable[[list[str]], list[list[float]]]


def hashed(texts: list[str], dim: int = 64) -> list[list[float]]:
    """Built-in model without a network: signed counts of hashed words."""
    out = []
    for t in texts:
        h = np.array([zlib.crc32(w.encode()) for w in re.findall(r"[\w-]+", t.lower())], np.int64)
        out.append(np.bincount(h % dim, np.where(h >> 16 & 1, 1.0, -1.0), dim).tolist() if len(h) else [0.0] * dim)
    return out


#: What a model raises for a passing trouble; anything else isn't asked again.
PASSING = (OSError, TimeoutError)


def call(model: Embedder, texts: list[str], retries: int = 2, backoff: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> list[list[float]]:
    """One batch: retried with growing pauses after a passing trouble; a reply with one vector for several texts is asked one by one."""
    for attempt in range(retries + 1):
        try:
            out = model(texts)
            break
        except PASSING:
            if attempt == retries:
                raise
            sleep(backoff * (attempt + 1))
    if len(out) == 1 and len(texts) > 1:
        out = [v for t in texts for v in call(model, [t], retries, backoff, sleep)]
    if len(out) != len(texts):
        raise ValueError(f"{len(out)} vectors for {len(texts)} texts")
    return out


def _batched(df: DataFrame, inputs: Callable[[pd.DataFrame], list], model: Callable, dim: int, batch: int, to: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[list[float]] = []
            for k in range(0, len(frame), batch):
                out += call(model, inputs(frame.iloc[k : k + batch]))
            yield frame.assign(**{to: [list(map(float, v[:dim])) for v in out]})

    schema = T.StructType([*df.schema.fields, T.StructField(to, T.ArrayType(T.DoubleType()))])
    return df.mapInPandas(run, schema).withColumn(to, vec.l2_normalize(F.col(to)))


def embed(df: DataFrame, text: str, model: Embedder, dim: int, batch: int = 16, to: str = "embedding") -> DataFrame:
    """Adds unit vectors of at most ``dim`` components from ``model``, called with ``batch`` texts at a time in the tasks."""
    return _batched(df, lambda part: part[text].fillna("").tolist(), model, dim, batch, to)


def try_embed(df: DataFrame, text: str, model: Embedder, dim: int, batch: int = 16, to: str = "embedding") -> DataFrame:
    """As ``embed``, with a column ``error`` and no vector where the model refuses a text; one refused text costs no other."""

    def tried(texts: list[str]) -> list[tuple]:
        try:
            return [(v, None) for v in call(model, texts)]
        except Exception as e:  # noqa: BLE001  what the model says is the file's error
            return [(None, str(e) or type(e).__name__)] if len(texts) == 1 else [r for t in texts for r in tried([t])]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame[text].fillna("").tolist()
            out = [r for k in range(0, len(texts), batch) for r in tried(texts[k : k + batch])]
            yield frame.assign(**{to: [None if v is None else list(map(float, v[:dim])) for v, _ in out], "error": [e for _, e in out]})

    schema = T.StructType([*df.schema.fields, T.StructField(to, T.ArrayType(T.DoubleType())), T.StructField("error", T.StringType())])
    return df.mapInPandas(run, schema).withColumn(to, vec.l2_normalize(F.col(to)))


def embed_images(df: DataFrame, prompt: str, image: str, model: Callable[[list[tuple[str, str]]], list[list[float]]], dim: int, to: str = "embedding") -> DataFrame:
    """Adds unit vectors of at most ``dim`` components for (prompt, image URL) columns; the model takes one pair a call.
    A missing image is an error of the model's, a missing prompt is empty."""
    return _batched(df, lambda part: list(zip(part[prompt].fillna(""), part[image], strict=True)), model, dim, 1, to)
