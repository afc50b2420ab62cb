"""An index for approximate vector search: two levels of cells, quantised residuals, look-up tables, exact rerank.

A vector's unit form is a coarse center, plus a fine center of what is left, plus a residual of one byte a component. The
index keeps, for each user and cell, blocks of keys and residual codes; full vectors stay in their own table. A query
reads the blocks of its nearest cells, ranks them with a table of 256 products a component, and only the best few have
their full vectors joined and compared exactly.

Centers, residual range, the number of cells, the number of cells to look into and the number of vectors to rerank are
learned from a bounded sample; every vector is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources.stored import stored

#: Rows that the model is learned from at most (those with the smallest hash), queries of the calibration, and rows of a block.
SAMPLE_ROWS, ASKED_ROWS, BLOCK_ROWS = 20_000, 200, 4096
#: Shares of true neighbours that the learned numbers of cells and of reranked vectors must reach on the sample.
PROBE_SHARE, RERANK_SHARE = 0.97, 0.995


class Model(NamedTuple):
    coarse: np.ndarray
    fine: np.ndarray
    low: np.ndarray
    step: np.ndarray
    probes: int
    widen: float

    def centers(self) -> np.ndarray:
        """The center of cell i * len(fine) + j."""
        return (self.coarse[:, None, :] + self.fine[None, :, :]).reshape(-1, self.coarse.shape[1])

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = _nearest(x, self.coarse)
        j = _nearest(x - self.coarse[i], self.fine)
        left = x - self.coarse[i] - self.fine[j]
        return i * len(self.fine) + j, np.clip(np.rint((left - self.low) / self.step), 0, 255).astype(np.uint8)

    def table(self, q: np.ndarray) -> np.ndarray:
        """Product of each component of a query with each of the 256 residual values."""
        return q[:, None] * (self.low[:, None] + self.step[:, None] * np.arange(256))


class Index(NamedTuple):
    model: Model | None
    blocks: DataFrame
    occupied: DataFrame
    vectors: DataFrame


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers**2).sum(1) - 2 * x @ centers.T).argmin(1)


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 15) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = _nearest(x, c)
        n = np.bincount(own, minlength=len(c))[:, None]
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(n > 0, sums / np.maximum(n, 1), c)
    return c


def units(values: pd.Series) -> np.ndarray:
    """Unit vectors as a matrix; a vector without a direction is a row of zeros."""
    x = np.array([np.asarray(v, float) for v in values])
    length = np.sqrt((x**2).sum(1, keepdims=True))
    return np.divide(x, length, out=np.zeros_like(x), where=np.isfinite(length) & (length > 0))


def learn(x: np.ndarray, user: np.ndarray, n_rows: int, k: int, seed: int = 3) -> Model:
    """A model from the sample ``x`` of ``n_rows`` rows; its queries look for their ``k`` nearest among their user's rows."""
    rng = np.random.default_rng(seed)
    side = int(np.clip(round(n_rows**0.25), 2, 256))  # cells grow with the root of the rows
    coarse = _means(x, side, rng)
    left = x - coarse[_nearest(x, coarse)]
    fine = _means(left, side, rng)
    left = left - fine[_nearest(left, fine)]
    low, high = left.min(0), left.max(0)
    model = Model(coarse, fine, low, np.maximum((high - low) / 255, 1e-12), len(coarse) * len(fine), 1.0)
    cell, code = model.encode(x)
    near = x @ model.centers().T - (model.centers() ** 2).sum(1) / 2
    cells_at, codes_at = [], []
    for i in rng.choice(len(x), min(ASKED_ROWS, len(x)), replace=False):
        mine = np.flatnonzero(user == user[i])
        true = mine[np.argsort(-(x[mine] @ x[i]), kind="stable")[:k]]
        rank_of_cell = np.empty(near.shape[1], int)
        rank_of_cell[np.argsort(-near[i], kind="stable")] = np.arange(near.shape[1])
        cells_at += list(rank_of_cell[cell[true]])
        about = model.centers()[cell[mine]] @ x[i] + model.table(x[i])[np.arange(x.shape[1]), code[mine]].sum(1)
        place = {m: p for p, m in enumerate(mine[np.argsort(-about, kind="stable")])}
        codes_at += [place[t] for t in true]
    probes = int(np.quantile(cells_at, PROBE_SHARE)) + 1
    return model._replace(probes=probes, widen=max(1.0, (np.quantile(codes_at, RERANK_SHARE) + 1) / k))


def build(vectors: DataFrame, k: int) -> Index:
    """The index of (file_id, small_chunk_index, user_id, embedding), stored; vectors that are null take no part."""
    rows = stored(vectors.select("file_id", "small_chunk_index", "user_id", F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null"), "vectors")
    n = rows.count()
    if not n:
        return Index(None, rows, rows, rows)
    sample = rows.orderBy(F.xxhash64("file_id", "small_chunk_index"), "file_id", "small_chunk_index").limit(SAMPLE_ROWS)

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames))
        if len(rows):
            m = learn(units(rows["embedding"]), rows["user_id"].to_numpy(), n, k)
            parts = [("coarse", m.coarse), ("fine", m.fine), ("low", m.low[None]), ("step", m.step[None]), ("rest", np.array([[m.probes, m.widen]]))]
            yield pd.DataFrame([(name, i, list(map(float, v))) for name, at in parts for i, v in enumerate(at)], columns=["name", "at", "v"])

    found = sample.repartition(1).mapInPandas(fit, "name string, at int, v array<double>").orderBy("at").collect()  # twice the side, and three rows
    part = {name: np.array([r.v for r in found if r.name == name]) for name in ("coarse", "fine", "low", "step", "rest")}
    model = Model(part["coarse"], part["fine"], part["low"][0], part["step"][0], int(part["rest"][0, 0]), float(part["rest"][0, 1]))

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = units(f["embedding"])
                cell, code = model.encode(x)
                f = f.drop(columns="embedding").assign(cell=np.where(x.any(1), cell, -1), code=[c.tobytes() for c in code])
                yield f

    coded = rows.mapInPandas(encode, "file_id long, small_chunk_index int, user_id string, cell int, code binary")
    part = F.floor((F.row_number().over(Window.partitionBy("user_id", "cell").orderBy("file_id", "small_chunk_index")) - 1) / BLOCK_ROWS)
    blocks = coded.withColumn("block", part).groupBy("user_id", "cell", "block").agg(F.array_sort(F.collect_list(F.struct("file_id", "small_chunk_index", "code"))).alias("rows"))
    blocks = stored(blocks, "vector-blocks")
    occupied = blocks.groupBy("user_id", "cell").agg(F.sum(F.size("rows")).alias("n")).groupBy("user_id").agg(F.collect_list(F.struct("cell", "n")).alias("cells"))
    return Index(model, blocks, stored(occupied, "vector-cells"), rows)


def candidates(queries: DataFrame, index: Index, k: int) -> DataFrame:
    """(query_id, file_id, small_chunk_index): the vectors to compare exactly, best by look-up tables in the nearest cells."""
    model, most = index.model, int(np.ceil(k * index.model.widen))
    centers = model.centers()

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for q, user, v, cells in zip(f["query_id"], f["user_id"], f["query_vector"], f["cells"], strict=True):
                x = units(pd.Series([v]))[0]
                held = {c["cell"]: c["n"] for c in cells}
                # vectors without a direction are in cell -1, behind all others; a query without one finds all cells alike
                order = [*np.argsort((centers**2).sum(1) / 2 - centers @ x, kind="stable"), -1]
                own, got = [], 0
                for rank, cell in enumerate(order):
                    if x.any() and rank >= model.probes and got >= most:
                        break
                    if cell in held:
                        own.append(cell)
                        got += held[cell]
                yield pd.DataFrame({"query_id": q, "user_id": user, "cell": own, "unit": [x] * len(own)})

    kind = queries.schema["query_id"].dataType.simpleString()
    asked = queries.where("query_vector is not null").select("query_id", "user_id", F.col("query_vector").cast("array<double>").alias("query_vector"))
    asked = asked.join(index.occupied, "user_id").mapInPandas(probe, f"query_id {kind}, user_id string, cell int, unit array<double>")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.arange(centers.shape[1])
        for batch in batches:
            out = []
            for q, cell, unit, rows in zip(*(batch.column(n) for n in ("query_id", "cell", "unit", "rows")), strict=True):
                file, chunk, code = rows.values.flatten()
                x = np.array(unit.as_py())
                about = np.full(len(file), np.inf)
                if cell.as_py() >= 0 and x.any():
                    codes = np.frombuffer(b"".join(code.to_pylist()), np.uint8).reshape(len(file), -1)
                    about = -(centers[cell.as_py()] @ x + model.table(x)[at, codes].sum(1))
                best = pa.array(np.argsort(about, kind="stable")[:most])  # rows of a block are in the order of their keys
                out.append(pa.table({"query_id": pa.array([q.as_py()] * len(best), batch.schema.field("query_id").type), "file_id": file.take(best), "small_chunk_index": chunk.take(best), "about": about[best]}))
            if out:
                yield from pa.concat_tables(out).to_batches()

    seen = asked.join(index.blocks, ["user_id", "cell"]).select("query_id", "cell", "unit", "rows").mapInArrow(look, f"query_id {kind}, file_id long, small_chunk_index int, about double")
    order = Window.partitionBy("query_id").orderBy("about", "file_id", "small_chunk_index")
    return seen.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select("query_id", "file_id", "small_chunk_index")
