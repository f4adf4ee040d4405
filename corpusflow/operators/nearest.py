"""Exact nearest vectors of stated queries: blocks of queries against blocks of items, each task keeps its best."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries that a task meets at a time, and rows of a tile where both sides are large.
BLOCK, TILE = 512, 16_384
FOUND = "query_id long, id long, score double"


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column of one length; missing components are NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dim)


def first_of(q: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (query, id, score) the ``k`` of the largest score for each query, ties to the smaller id."""
    order = np.lexsort((ids, -s, q))
    q, ids, s = q[order], ids[order], s[order]
    place = np.arange(q.size) - np.searchsorted(q, q, "left")
    keep = place < k
    return q[keep], ids[keep], s[keep]


def scan(batches: Iterator[tuple[np.ndarray, np.ndarray]], asked: np.ndarray, vectors: np.ndarray, k: int):
    """The best ``k`` items of each query, by its place in ``asked``, over batches (ids, vectors); scores to 6 places."""
    held = {}
    for ids, v in batches:
        for at in range(0, asked.size, BLOCK):
            s = np.round(vectors[at : at + BLOCK] @ v.T, 6) + 0.0
            s[np.isnan(s) | (asked[at : at + BLOCK, None] == ids[None, :])] = -np.inf
            least = np.partition(s, s.shape[1] - k, axis=1)[:, -k] if s.shape[1] > k else np.full(s.shape[0], -np.inf)
            q, i = np.nonzero((s >= least[:, None]) & (s > -np.inf))
            new = (q + at, ids[i], s[q, i])
            old = held.get(at)
            held[at] = first_of(*(np.concatenate(p) for p in zip(old, new)), k) if old else first_of(*new, k)
    return [np.concatenate(p) for p in zip(*held.values())] if held else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]


def nearest(items: DataFrame, queries: DataFrame, k: int, most: int = 20_000) -> DataFrame:
    """Rows (query_id, id, score) that hold each query's ``k`` items of the largest inner product, other than itself.

    ``items`` (id, v), ``queries`` (query_id, qv), vectors of one length; rows without a vector, of another length or with
    missing components take no part.  Up to ``most`` queries travel with the tasks; more are met tile by tile.
    """
    own = queries.where("qv is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("qv").cast("array<double>").alias("qv"))
    sample = own.limit(most + 1).toArrow()
    if not sample.num_rows:
        return queries.sparkSession.createDataFrame([], FOUND)
    dim = len(sample["qv"][0])
    rows = items.where(F.size("v") == dim).select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    if sample.num_rows <= most:
        sample = sample.combine_chunks()
        fits = np.array([len(v) == dim for v in sample["qv"]])
        sample = sample.filter(pa.array(fits)).combine_chunks()
        asked, vectors = sample["query_id"].to_numpy(), matrix(sample["qv"].combine_chunks(), dim)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, ids, s = scan(((b["id"].to_numpy(), matrix(b["v"], dim)) for b in batches if b.num_rows), asked, vectors, k)
            yield pa.RecordBatch.from_arrays([pa.array(asked[q]), pa.array(ids), pa.array(s)], names=["query_id", "id", "score"])

        return rows.mapInArrow(run, FOUND)
    own = own.where(F.size("qv") == dim)
    tiles, blocks = (max(1, -(-df.count() // TILE)) for df in (rows, own))

    def pair(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        asked = right["query_id"].to_numpy()
        q, ids, s = scan(iter([(left["id"].to_numpy(), np.array(left["v"].tolist(), np.float64))]), asked, np.array(right["qv"].tolist(), np.float64), k)
        return pd.DataFrame({"query_id": asked[q], "id": ids, "score": s})

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("tile", F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int")).withColumn("block", every(blocks))
    right = own.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("tile", every(tiles))
    return left.groupBy("tile", "block").cogroup(right.groupBy("tile", "block")).applyInPandas(pair, FOUND)
