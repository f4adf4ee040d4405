"""Approximate nearest neighbours by learned partitions.

A bounded sample of the vectors (``sample`` rows, those whose id hashes lowest) is joined into a graph of exact nearest
neighbours; the graph is cut into balanced parts, about one for ``rows_per_part`` rows of the table and 256 at most, by repeated
majority votes of the neighbours under a size limit; a small classifier (a linear softmax) learns which parts a vector and its
neighbours belong to.  Every row of the table is then indexed under its likeliest part, and a query is routed to several of its
likeliest parts, whose members are ranked by the exact inner product in double precision.  How many parts are probed is measured:
an eighth of the sample is held out of the fit, and as many probes are taken as let it find the share ``recall`` of its exact
neighbours in the sample.  Parts are bundled into cells of about ``rows_per_share`` rows, and larger parts are dealt over several
cells by a salt.  A group compares one cell with one block of queries (``queries_per_block``), each query with the members of the
parts that it probes, so its memory is bounded whatever fills a part; a query goes to a cell once and gets at most ``k`` rows back.

Vectors that are null, zero, of another length than most of the sample's, or that hold a null or non-finite component take
no part.  Products beyond the range of doubles are infinite and tie.  Ties go to the smaller id.  Rows of a repeated id are rows
of their own, as queries (each with its own list) and as candidates, and a query never finds its own id.  Empty tables give
empty results.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _text as T
from ._store import materialize


@dataclass
class Router:
    weights: np.ndarray  # (dim + 1, parts)
    probes: int

    def rank(self, x: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` likeliest parts of each row."""
        logits = np.c_[x, np.ones(len(x))] @ self.weights
        n = min(n, logits.shape[1])
        top = np.argpartition(-logits, n - 1, axis=1)[:, :n]
        return np.take_along_axis(top, np.argsort(-np.take_along_axis(logits, top, 1), axis=1, kind="stable"), 1)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Exact ``k`` nearest rows (largest inner product) of each row of the sample, by blocks."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), max(k, 0)), np.int64)
    for s in range(0, len(x), 1024):
        d = x[s : s + 1024] @ x.T
        d[np.arange(len(d)), np.arange(s, s + len(d))] = -np.inf
        out[s : s + 1024] = np.argpartition(-d, k - 1, axis=1)[:, :k] if k else out[s : s + 1024]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1, seed: int = 7) -> np.ndarray:
    """Cut the graph: rows start with the nearest of ``parts`` spread seeds, then move to the part of most neighbours that has room."""
    rng = np.random.default_rng(seed)
    n, cap = len(x), int(np.ceil(len(x) / parts * slack))
    seeds = x[rng.choice(n, parts, replace=False)]
    for _ in range(5):  # spread the seeds
        own = np.argmax(x @ seeds.T, 1)
        for p in range(parts):
            if (own == p).any():
                seeds[p] = x[own == p].mean(0)
        seeds /= np.maximum(np.linalg.norm(seeds, axis=1, keepdims=True), 1e-12)
    part = place(x @ seeds.T, cap)
    for _ in range(rounds):
        votes = np.zeros((n, parts), np.float32)
        np.add.at(votes, (np.repeat(np.arange(n), graph.shape[1]), part[graph].ravel()), 1)
        np.add.at(votes, (graph.ravel(), np.repeat(part, graph.shape[1])), 1)
        votes[np.arange(n), part] += 0.5
        new = place(votes + 1e-3 * (x @ seeds.T), cap)
        if (new == part).all():
            break
        part = new
    return part


def place(liking: np.ndarray, cap: int) -> np.ndarray:
    """Give each row its best liked part that has room; the most decided rows choose first."""
    n, parts = liking.shape
    order = np.argsort(-liking, axis=1)
    top = np.take_along_axis(liking, order[:, :2], 1)
    part, room = np.full(n, -1), np.full(parts, cap)
    for i in np.argsort(-(top[:, 0] - top[:, -1]), kind="stable").tolist():
        for p in order[i].tolist():
            if room[p] > 0:
                part[i], room[p] = p, room[p] - 1
                break
    return part


def fit_router(x: np.ndarray, part: np.ndarray, graph: np.ndarray, parts: int, steps: int = 300, rate: float = 0.5) -> np.ndarray:
    """Softmax regression by momentum; the target of a row mixes its own part with those of its neighbours."""
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros((a.shape[1], parts))
    want = np.zeros((len(x), parts))
    want[np.arange(len(x)), part] = 0.3
    np.add.at(want, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 0.7 / graph.shape[1])
    for p in range(parts):
        if (part == p).any():
            w[:-1, p] = 4 * x[part == p].mean(0)
    v = np.zeros_like(w)
    for _ in range(steps):
        z = a @ w
        z -= z.max(1, keepdims=True)
        e = np.exp(z)
        e /= e.sum(1, keepdims=True)
        v = 0.9 * v + a.T @ (e - want) / len(x) * parts
        w -= rate * v / max(1.0, np.sqrt(parts))
    return w


def probes_for(router: Router, x: np.ndarray, held: np.ndarray, recall: float, k: int = 20) -> int:
    """Probes with which the held-out rows find ``recall`` of their exact neighbours in the sample."""
    parts = router.weights.shape[1]
    home, order = router.rank(x, 1)[:, 0], router.rank(x[held], parts)
    near = x[held] @ x.T
    near[np.arange(len(held)), held] = -np.inf
    k = min(k, len(x) - 1)
    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
    place_of = np.empty_like(order)
    np.put_along_axis(place_of, order, np.broadcast_to(np.arange(parts), order.shape), 1)
    places = np.sort(np.take_along_axis(place_of, home[top], 1).ravel())
    return int(places[min(len(places) - 1, int(np.ceil(recall * len(places))))]) + 1


def usable(v: Column) -> Column:
    """Neither null nor zero, all components finite."""
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return v.isNotNull() & ~bad & F.exists(v, lambda c: c != 0)


def fit(vectors: DataFrame, sample: int = 8192, rows_per_part: int = 400, neighbours: int = 20, recall: float = 0.94) -> Router | None:
    """Learn from at most ``sample`` rows: the bound of what the driver holds."""
    parts = min(256, vectors.count() // rows_per_part)
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toPandas()["v"]
    if not len(rows):
        return None
    dim = int(pd.Series([len(r) for r in rows]).mode()[0])
    x = np.stack([np.asarray(r, np.float64) for r in rows if len(r) == dim])
    # directions decide the cut; the inner product ranks
    x = directions(x)
    parts = max(1, min(parts, len(x) // 16))
    if parts == 1:
        return Router(np.zeros((dim + 1, 1)), 1)
    held, seen = np.arange(0, len(x), 8), np.setdiff1d(np.arange(len(x)), np.arange(0, len(x), 8))
    graph = neighbour_graph(x[seen], neighbours)
    router = Router(fit_router(x[seen], balanced_parts(x[seen], graph, parts), graph, parts), 1)
    router.probes = probes_for(router, x, held, recall)
    return router


def search(vectors: DataFrame, queries: Column, k: int = 20, recall: float = 0.94, sample: int = 8192, rows_per_part: int = 400, rows_per_share: int = 65536, queries_per_block: int = 4096) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every row for which ``queries`` holds."""
    spark = vectors.sparkSession
    own = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("q"), F.monotonically_increasing_id().alias("row"))
    base = materialize(own.where(F.col("vec_id").isNotNull() & usable(F.col("v"))), "vectors")
    router = fit(base, sample, rows_per_part, recall=recall)
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if router is None:
        return spark.createDataFrame([], schema)
    dim, n_parts = router.weights.shape[0] - 1, router.weights.shape[1]
    sent = spark.sparkContext.broadcast(router)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row with its likeliest part."""
        for batch in batches:
            batch = batch.filter(pa.array(np.diff(batch.column(1).offsets.to_numpy()) == dim))
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.rank(unit(batch.column(1), dim), 1)[:, 0], pa.int64())], ["vec_id", "v", "q", "row", "part"])

    placed = materialize(base.mapInArrow(index, "vec_id bigint, v array<double>, q boolean, row bigint, part bigint"), "index")
    sizes, asked = np.zeros(n_parts, np.int64), 0
    for part, n, q in placed.groupBy("part").agg(F.count(F.lit(1)), F.count_if("q")).collect():  # one row a part
        sizes[part] = n
        asked += q
    shares, first, room, cells = np.maximum(1, -(-sizes // rows_per_share)), np.zeros(n_parts, np.int64), 0, 0
    for part, n in enumerate(sizes.tolist()):
        if n > room:  # a new cell, or as many as the part needs
            first[part], cells, room = cells, cells + int(shares[part]), max(0, rows_per_share - n)
        else:
            first[part], room = cells - 1, room - n
    blocks = -(-max(asked, 1) // queries_per_block)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries in all cells of the parts to probe, each in its block."""
        for batch in batches:
            batch = batch.filter(batch.column(2))
            if not batch.num_rows:
                continue
            row = batch.column(3).to_numpy()
            goes = sent.value.rank(unit(batch.column(1), dim), sent.value.probes)
            which, place = T.ragged(shares[goes.ravel()])
            take, cell = np.unique(np.stack([which // goes.shape[1], first[goes.ravel()[which]] + place]), axis=1)
            block = (T.mix(row.view(T.U64)) % T.U64(blocks)).astype(np.int64)
            none = pa.array(np.full(len(take), -1, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(block[take]), none, pa.array(row[take]), batch.column(0).take(pa.array(take)), batch.column(1).take(pa.array(take))], ["cell", "block", "part", "row", "id", "v"])

    def nearest(t: pa.Table) -> pa.Table:
        """The best of a cell for each query of a block: part by part, members of the part with the queries that probe it."""
        t = t.combine_chunks()
        part, ids, row = (t[c].to_numpy() for c in ("part", "id", "row"))
        x = t["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
        asks, members = np.flatnonzero(part < 0), np.flatnonzero(part >= 0)
        goes = sent.value.rank(directions(x[asks]), sent.value.probes) if len(asks) else np.zeros((0, 1), np.int64)
        probed = np.zeros((len(asks), n_parts), bool)
        probed[np.arange(len(asks))[:, None], goes] = True
        big = np.exp2(np.floor(np.log2(np.abs(x).max(1))))  # powers of two: the scaled rows' largest components are from 1 to 2
        x = x / big[:, None]
        found, size = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0
        for p in np.unique(part[members]):
            c = members[part[members] == p]
            c = c[np.argsort(ids[c], kind="stable")]
            own = asks[probed[:, p]]
            for s in range(0, len(own), 256):
                found.append(closest(own[s : s + 256], c, x, big, ids))
                size += len(found[-1][0])
            if size > 1 << 20:
                found = [best(found, ids)]
                size = len(found[0][0])
        i, j, score = best(found, ids)
        return pa.table({"row": pa.array(row[i]), "query_id": pa.array(ids[i]), "vec_id": pa.array(ids[j]), "score": pa.array(score)})

    def closest(q: np.ndarray, c: np.ndarray, x: np.ndarray, big: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # equal vectors may differ in the last bits of a block product: choose by values rounded against the vectors' own scale,
        # smaller ids first, and compute the scores of the chosen one by one
        with np.errstate(over="ignore", under="ignore"):
            d = np.round(x[q] @ x[c].T, 12) * big[c] * big[q][:, None]
        d[ids[q][:, None] == ids[c][None, :]] = -np.inf
        most = min(k + 8, len(c))
        least = np.partition(d, len(c) - most, axis=1)[:, len(c) - most, None]
        above, tied = d > least, (d == least) & (d > -np.inf)
        i, j = np.nonzero(above | (tied & (np.cumsum(tied, 1) <= most - above.sum(1, keepdims=True))))
        i, j = q[i], c[j]
        with np.errstate(over="ignore", under="ignore"):
            return i, j, np.einsum("ij,ij->i", x[i], x[j]) * big[i] * big[j]

    def best(found, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j, score = (np.concatenate(z) for z in zip(*found, strict=True))
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        return i[keep], j[keep], score[keep]

    salt = F.pmod(F.xxhash64("row"), F.element_at(F.array(*[F.lit(int(n)) for n in shares]), (F.col("part") + 1).cast("int")))
    begin = F.element_at(F.array(*[F.lit(int(n)) for n in first]), (F.col("part") + 1).cast("int"))
    members = placed.select((begin + salt).alias("cell"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"), "part", "row", F.col("vec_id").alias("id"), "v")
    asks = placed.mapInArrow(route, "cell bigint, block bigint, part bigint, row bigint, id bigint, v array<double>")
    found = members.unionByName(asks).groupBy("cell", "block").applyInArrow(nearest, "row bigint, query_id bigint, vec_id bigint, score double")
    w = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def directions(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; the largest component first, so that squares don't overflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def unit(v: pa.ListArray, dim: int) -> np.ndarray:
    return directions(v.flatten().to_numpy().reshape(-1, dim))
