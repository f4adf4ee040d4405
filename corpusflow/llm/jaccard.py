"""Exact n-gram Jaccard join by vertical partitioning, and the components of its links.

A document is its set of distinct ``n``-word shingles (64-bit hashes).  Documents of one set are one node.  Shingles have a
global order: first by how often a sketch, whose cells follow the corpus, counts them over all documents, rare ones first, then
by hash; two sets that reach the threshold share a shingle of their prefixes under it.  The order is cut into fragments.  Each
fragment counts, apart from the others, which pairs share prefix shingles; the counts of a pair are summed, and pairs whose
bound can't reach the threshold go.  The candidates' whole sets are then cut into fragments again, each fragment counts its
partial overlaps, and the sums decide exactly.

As rare shingles come first, one that stands in prefixes more often than ``dense`` is shared by groups of near copies.  Their
pairs would be a square, so a task keeps one posting of such a list and sends the others as edges to it; the components of the
edges are clusters.  A cluster gets a pivot, the shingles of most of 32 of its members.  Jaccard distance is a metric: members
within half of the allowed distance of the pivot (the core) all link with each other, which needs no comparison and is counted
by sums.  Only members outside the core are compared, with all of the cluster, in tiles of bounded size, and of these only pairs
that share a shingle of the larger set's prefix and of the smaller one's, which is shorter; documents that share a template but stay below
the threshold have more rare shingles of their own than that, so they don't meet.  Partial overlaps are counted for one slice of
the order after the other and summed.  Tiles give counts of links and spanning edges, not pairs.
Every link is counted in ``n_links``; no list is cut.  The pivot decides what is compared, never what links.

Null and empty texts, and texts without words, have an empty set and are alone.  Repeated rows count as copies.  A null id
stands behind all others and gives a null component where there is no other.  An empty table gives an empty one; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import _repeats as R
from . import _text as T
from ._components import components
from ._store import materialize, parts_for, small_side, text_batches

#: The sketch is summed in segments of this many cells, as a power of two.
SEGMENT_BITS = 16
#: Fragments of the order into which whole sets are cut.
FRAGMENTS = 4
#: Marks the one posting that stands for a long list of a task.
LONG = np.uint32(1 << 31)
#: Shingles of a side of a tile, and members whose majority is a cluster's pivot.
TILE, VOTERS = 1 << 20, 32


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles in the order of their documents, and where each document's begin (one entry more)."""
    start, end, first = T.words(data, off, T.SPACE)
    h = T.span_hashes(data, start, end, T.LOWER_CODE)
    count = np.diff(first)
    hashes = np.concatenate([T.rolling(h[s : s + T.SEGMENT + n - 1], n) for s in range(0, max(1, len(h) - n + 1), T.SEGMENT)])
    doc = np.repeat(np.arange(len(count)), count)
    at = np.flatnonzero(np.arange(len(hashes)) + n <= first[doc[: len(hashes)] + 1]) if len(hashes) else np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < n))
    value, owner = hashes[at], doc[at]
    if len(short):
        whole = np.array([T.mix(np.array([int.from_bytes(b"".join(x.tobytes() for x in h[first[d] : first[d + 1]]), "little") * 0x9E3779B97F4A7C15 % (2**64 - 59)], T.U64) + T.U64(count[d]))[0] for d in short], T.U64)
        value, owner = np.concatenate([value, whole]), np.concatenate([owner, short])
    order = np.argsort(value)
    order = order[np.argsort(owner[order].astype(np.uint16) if len(count) < 65536 else owner[order], kind="stable")]
    value, owner = value[order], owner[order]
    keep = np.r_[True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])] if len(value) else np.zeros(0, bool)
    value, owner = value[keep], owner[keep]
    return value, np.searchsorted(owner, np.arange(len(count) + 1))


def set_ids(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set; 0 for the empty one."""
    total = np.concatenate([np.zeros(1, T.U64), np.cumsum(T.mix(value ^ T.U64(0xA5A5A5A5A5A5A5A5)), dtype=T.U64)])
    size = np.diff(first).astype(T.U64)
    return np.where(size > 0, T.mix((total[first[1:]] - total[first[:-1]]) * T.U64(T.BASE) + size) >> T.U64(1), 0).astype(np.int64)


def batches_of_sets(batch: pa.RecordBatch, column: int, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    data, off = T.column(batch.column(column))
    for i, j in T.runs(off):
        value, first = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], n)
        yield i, j, value, first, set_ids(value, first)


def sketch_bits(text_bytes: int, most: int = 26) -> int:
    """Cells of the sketch as a power of two: about one for four words, up to 64 MB of classes."""
    return int(np.clip(round(np.log2(text_bytes / 24 + 1)), SEGMENT_BITS, most))


def members(docs: DataFrame, n: int, bits: int) -> DataFrame:
    """Materialized: doc_id, n and the set of each row; and parts of the sketch of shingle counts (``part``, ``cells``)."""
    names = ["doc_id", "text_hash", "n", "node", "part", "cells"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, none_yet = [], 0, np.zeros(0, np.int64)
        for batch in batches:
            ids, sizes, nodes = R.keys_of(batch.column(0)), [], []
            for _, _, value, first, name in batches_of_sets(batch, 1, n):
                count = np.diff(first)
                sizes.append(count)
                nodes.append(name)
                # copies within a run of documents count once
                v = value[np.repeat(firsts(name), count)]
                held.append((v >> T.U64(64 - bits)).astype(np.uint32))
                size += len(v)
            nulls = pa.nulls(len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids), batch.column(2), pa.array(np.concatenate([*sizes, none_yet]), pa.int64()), pa.array(np.concatenate([*nodes, none_yet]), pa.int64()), nulls.cast(pa.int32()), nulls.cast(pa.binary())], names)
            if size > 1 << 21:
                yield cells(held)
                held, size = [], 0
        if size:
            yield cells(held)

    def cells(held: list[np.ndarray]) -> pa.RecordBatch:
        cell = np.sort(np.concatenate(held))
        at = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        count = np.minimum(np.diff(np.r_[at, len(cell)]), 65535).astype(np.uint16)
        cell = cell[at]
        segment = cell >> np.uint32(SEGMENT_BITS)
        cut = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        place = (cell & np.uint32((1 << SEGMENT_BITS) - 1)).astype(np.uint16)
        blobs = [R.squeeze(np.diff(place[i:j], prepend=np.uint16(0)).tobytes() + count[i:j].tobytes()) for i, j in zip(cut, [*cut[1:], len(cell)], strict=True)]
        none = pa.nulls(len(cut), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(segment[cut], pa.int32()), pa.array(blobs, pa.binary())], names)

    return materialize(docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(run, "doc_id bigint, text_hash bigint, n bigint, node bigint, part int, cells binary"), "members")


def firsts(name: np.ndarray) -> np.ndarray:
    """Whether a set is the first of its name."""
    new = np.zeros(len(name), bool)
    new[np.unique(name, return_index=True)[1]] = True
    return new


def order_classes(table: DataFrame, bits: int) -> np.ndarray:
    """The class of each cell of the sketch in the global order: 0 for what chance makes of rare shingles, then two an octave."""
    total = table.where("part is null").agg(F.sum("n")).first()[0] or 0
    mean = total / 2**bits
    noise = max(8.0, mean + 4 * mean**0.5)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                step, n = np.frombuffer(R.unsqueeze(blob), np.uint16).reshape(2, -1)
                c = counts.setdefault(p, np.zeros(1 << SEGMENT_BITS, np.int64))
                c[np.cumsum(step, dtype=np.uint16)] += n
        for p, c in counts.items():
            own = np.where(c > noise, 1 + np.floor(2 * np.log2(np.maximum(c, 1) / noise)), 0).clip(0, 63).astype(np.uint8)
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([R.squeeze(own.tobytes())], pa.binary())], ["part", "cells"])

    parts = 1 << (bits - SEGMENT_BITS)
    rows = table.where("part is not null").select("part", "cells").repartition(parts, "part").mapInArrow(add, "part int, cells binary").collect()  # 64 MB at most before compression
    out = np.zeros((parts, 1 << SEGMENT_BITS), np.uint8)
    for p, blob in rows:
        out[p] = np.frombuffer(R.unsqueeze(pa.scalar(blob, pa.binary())), np.uint8)
    return out.ravel()


def ranked(value: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Shingles as numbers in the global order: class, then hash."""
    bits = len(classes).bit_length() - 1
    return (classes[(value >> T.U64(64 - bits)).astype(np.int64)].astype(T.U64) << T.U64(58)) | (value >> T.U64(6))


def need(na, nb, percent: int):
    """The least overlap of sets of these sizes that reaches the threshold."""
    return -(-percent * (na + nb) // (100 + percent))


def prefix(n, percent: int):
    return n - -(-percent * n // 100) + 1


PAIRS = "a bigint, b bigint, na bigint, nb bigint, shared bigint"


def pair_batch(a, b, na, nb, shared=None) -> pa.RecordBatch:
    """Distinct pairs, the lesser node first, with how often each was given."""
    swap = a > b
    a, b, na, nb = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, nb, na), np.where(swap, na, nb)
    order = np.lexsort((b, a))
    a, b, na, nb = a[order], b[order], na[order], nb[order]
    at = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a[at], b[at], na[at], nb[at], np.diff(np.r_[at, len(a)]))], ["a", "b", "na", "nb", "shared"])


def star_batch(pairs: np.ndarray) -> pa.RecordBatch:
    """Distinct edges of long lists; ``shared`` is 0."""
    order = np.lexsort(pairs[::-1])
    a, b = pairs[:, order]
    keep = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    zero = pa.array(np.zeros(int(keep.sum()), np.int64))
    return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), zero, zero, zero], ["a", "b", "na", "nb", "shared"])


def lists(token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each list of sorted postings begins, and its length."""
    at = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, np.int64)
    return at, np.diff(np.r_[at, len(token)])


def prefix_pairs(docs: DataFrame, classes: np.ndarray, n: int, percent: int, dense: int, parts: int) -> DataFrame:
    """Materialized: pairs that share prefix shingles, with their number by fragment; and star edges (``shared`` 0) of long lists."""
    sent = docs.sparkSession.sparkContext.broadcast(classes)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, size = [], 0
        for batch in batches:
            for _, _, value, first, name in batches_of_sets(batch, 0, n):
                sizes = np.diff(first)
                new = firsts(name) & (sizes > 0)
                own = ranked(value[np.repeat(new, sizes)], sent.value)
                sizes, name = sizes[new], name[new]
                row = np.repeat(np.arange(len(sizes)), sizes)
                own = own[np.lexsort((own, row))] if (own >> T.U64(58)).any() else own
                _, place = T.ragged(sizes)
                front = place < prefix(sizes, percent)[row]
                got.append((own[front], name[row[front]], sizes[row[front]].astype(np.uint32), place[front].astype(np.uint32)))
                size += int(front.sum())
            if size > 1 << 19:
                yield send(got)
                got, size = [], 0
        if size:
            yield send(got)

    def send(got) -> pa.RecordBatch:
        token, name, size, place = (np.concatenate(x) for x in zip(*got, strict=True))
        # a list that is long already here goes as one posting, with edges from the others to it
        order = np.lexsort((name, token))
        at, length = lists(token[order])
        long = np.repeat(length > dense, length)
        head = np.repeat(at, length)
        rest = order[long & (np.arange(len(token)) != head)]
        stars = np.stack([name[order[head]][long & (np.arange(len(token)) != head)], name[rest]])
        place[order[at[length > dense]]] |= LONG
        left = np.ones(len(token), bool)
        left[rest] = False
        token, name, size, place = token[left], name[left], size[left], place[left]
        # a fragment holds the same range of hashes of every class of the order; edges are dealt so that equal ones meet
        part = ((token & T.U64((1 << 58) - 1)).astype(np.float64) / 2**58 * parts).astype(np.int64).clip(0, parts - 1)
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(parts + 1))
        stars = np.stack([c.to_numpy() for c in star_batch(stars).columns[:2]])
        spart = (T.mix(stars[1].view(T.U64)) % T.U64(parts)).astype(np.int64)
        numbers, blobs = [], []
        for f in np.union1d(part, spart).tolist():
            o, e = order[cut[f] : cut[f + 1]], stars[:, spart == f] if stars.size else stars
            numbers.append(f)
            # documents stand together, so all columns but the first shrink
            blobs.append(R.squeeze(np.array([len(o)], np.int64).tobytes() + token[o].tobytes() + name[o].tobytes() + np.stack([size[o], place[o]]).tobytes() + e.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], ["fragment", "postings"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, stars = [], [np.zeros((2, 0), np.int64)]
        for batch in batches:
            for blob in batch.column(1):
                b = R.unsqueeze(blob)
                m = int(np.frombuffer(b, np.int64, 1)[0])
                s = np.frombuffer(b, np.uint32, 2 * m, 8 + 16 * m).reshape(2, m)
                got.append((np.frombuffer(b, T.U64, m, 8), np.frombuffer(b, np.int64, m, 8 + 8 * m), s[0], s[1]))
                stars.append(np.frombuffer(b, np.int64, -1, 8 + 24 * m).reshape(2, -1))
        if not got:
            return
        token, name, size, place = (np.concatenate(x) for x in zip(*got, strict=True))
        del got
        order = np.lexsort((place & ~LONG, name, token))
        token, name, size, place = token[order], name[order], size[order], place[order]
        at, length = lists(token)
        flagged = np.repeat(np.maximum.reduceat(place >> np.uint32(31), at), length) > 0 if len(at) else np.zeros(0, bool)
        once = np.r_[True, (token[1:] != token[:-1]) | (name[1:] != name[:-1])]
        token, name, size, place, flagged = token[once], name[once], size[once].astype(np.int64), (place[once] & ~LONG).astype(np.int64), flagged[once]
        at, length = lists(token)
        long = np.repeat(length > dense, length) | flagged
        head = np.repeat(at, length)
        o = np.flatnonzero(long & (np.arange(len(token)) != head))
        stars.append(np.stack([name[head[o]], name[o]]))
        yield star_batch(np.concatenate(stars, axis=1))
        keep = ~long & np.repeat(length > 1, length)
        token, name, size, place = token[keep], name[keep], size[keep], place[keep]
        found = []
        for k in range(1, min(dense, len(token))):
            i = np.flatnonzero(token[k:] == token[:-k])
            if not len(i):
                break
            j = i + k
            least = np.minimum(place[i], place[j]) + np.minimum(size[i] - place[i], size[j] - place[j])
            ok = least >= need(size[i], size[j], percent)
            found.append((i[ok], j[ok]))
        if found:
            i, j = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pair_batch(name[i], name[j], size[i], size[j])

    rows = docs.select("text").mapInArrow(deal, "fragment int, postings binary").repartition(parts, "fragment").mapInArrow(count, PAIRS)
    return materialize(rows, "pairs")


def sets_of(docs: DataFrame, wanted: DataFrame, classes: np.ndarray, n: int, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Materialized: node, n and the ordered set of the wanted nodes (``node, rep``), once each."""
    sent = docs.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, blobs = [], [], []
            for _, _, value, first, name in batches_of_sets(batch, 0, n):
                own = ranked(value, sent.value)
                blobs += [np.sort(own[i:j]).tobytes() for i, j in zip(first[:-1], first[1:], strict=True)]
                nodes.append(name)
                sizes.append(np.diff(first))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes), pa.int64()), pa.array(np.concatenate(sizes), pa.int64()), pa.array(blobs, pa.binary())], ["node", "n", "shingles"])

    ids = small_side(wanted.select("rep.*").distinct(), broadcast_rows)
    own = docs.select(F.coalesce("doc_id", F.lit(int(R.NO_ID))).alias("_id"), F.xxhash64("text").alias("_hash"), "text").join(ids, ["_id", "_hash"], "left_semi").select("text")
    rows = materialize(own.mapInArrow(run, "node bigint, n bigint, shingles binary").where("n > 0"), "sets")
    # a node's document may stand in the table more than once
    if rows.count() != rows.select("node").distinct().count():
        rows = materialize(rows.dropDuplicates(["node"]), "sets")
    return rows


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that reach the threshold: partial overlaps by fragment, summed per pair."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, fragments, blobs = [], [], []
            for node, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = np.frombuffer(blob.as_buffer(), T.U64)
                f = (v >> T.U64(56)) & T.U64(FRAGMENTS - 1)
                for i in range(FRAGMENTS):
                    nodes.append(node)
                    fragments.append(i)
                    blobs.append(v[f == i].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(fragments, pa.int32()), pa.array(blobs, pa.binary())], ["node", "fragment", "shingles"])

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(4), batch.column(5)
            n = [len(np.intersect1d(np.frombuffer(p.as_buffer(), T.U64), np.frombuffer(q.as_buffer(), T.U64), assume_unique=True)) for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(n, pa.int64())], ["a", "b", "na", "nb", "part"])

    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    side = sets.join(small_side(ends), "node", "left_semi").select("node", "shingles").mapInArrow(cut, "node bigint, fragment int, shingles binary")
    left = small_side(pairs).join(side.select(F.col("node").alias("a"), "fragment", F.col("shingles").alias("sa")), "a")
    both = left.join(side.select(F.col("node").alias("b"), "fragment", F.col("shingles").alias("sb")), ["b", "fragment"])
    parts = both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(overlap, "a bigint, b bigint, na bigint, nb bigint, part bigint")
    total = parts.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("both"))
    return total.where(F.col("both") * 100 >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def with_core(table: DataFrame, percent: int) -> DataFrame:
    """Materialized: the sets of clusters (cluster, node, n, copies, shingles) with ``core``: within half of the allowed distance of
    the pivot."""

    def vote(t: pa.Table) -> pa.Table:
        blobs = t["shingles"].combine_chunks()
        token, count = np.unique(np.concatenate([np.frombuffer(b.as_buffer(), T.U64) for b in blobs]), return_counts=True)
        return pa.table({"cluster": t["cluster"].slice(0, 1), "pivot": pa.array([token[2 * count > len(blobs)].tobytes()], pa.binary())})

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            core = []
            for x, p in zip(batch.column(4), batch.column(5), strict=True):
                x, p = np.frombuffer(x.as_buffer(), T.U64), np.frombuffer(p.as_buffer(), T.U64)
                both = len(np.intersect1d(x, p, assume_unique=True))
                union = len(x) + len(p) - both
                core.append(200 * (union - both) <= (100 - percent) * union)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(core, pa.bool_())], [*batch.schema.names[:5], "core"])

    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.xxhash64("node"), "node"))
    pivots = table.select("cluster", "shingles", rank.alias("r")).where(F.col("r") <= VOTERS).groupBy("cluster").applyInArrow(vote, "cluster bigint, pivot binary")
    rows = table.select("cluster", "node", "n", "copies", "shingles").join(small_side(materialize(pivots, "pivots"), 1000), "cluster")
    return materialize(rows.mapInArrow(near, "cluster bigint, node bigint, n bigint, copies bigint, shingles binary, core boolean"), "clusters")


LINKS = "node bigint, other bigint, weight bigint"


def cluster_links(label: DataFrame, sets: DataFrame, percent: int, tile: int = TILE) -> DataFrame:
    """Links within clusters: rows of a node, another that it is connected with, and a number of rows that it links with."""
    table = with_core(materialize(sets.join(small_side(label), "node"), "clusters"), percent)
    inner = table.where("core").groupBy("cluster").agg(F.min("node").alias("other"), F.sum("copies").alias("rows"))
    certain = table.where("core").select("cluster", "node", "copies").join(small_side(inner), "cluster").select("node", "other", (F.col("rows") - F.col("copies")).alias("weight"))
    outside = F.when(~F.col("core"), F.col("n")).otherwise(0)
    cuts = table.groupBy("cluster").agg(F.ceil(F.sum("n") / tile).cast("int").alias("blocks"), F.ceil(F.sum(outside) / tile).cast("int").alias("turns")).where("turns > 0")
    rows = table.join(small_side(cuts), "cluster")
    place = lambda of, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    columns = ["cluster", "block", "turn", "node", "n", "copies", "core", "asks", "shingles"]
    kept = rows.withColumns({"block": place("blocks", 1), "asks": F.lit(False)}).withColumn("turn", each("turns")).select(*columns)
    asked = rows.where("not core").withColumns({"turn": place("turns", 2), "asks": F.lit(True)}).withColumn("block", each("blocks")).select(*columns)

    def compare(t: pa.Table) -> pa.Table:
        node, n, copies, core, asks = (t[c].to_numpy() for c in ("node", "n", "copies", "core", "asks"))
        blobs = t["shingles"].combine_chunks()
        own = [np.frombuffer(b.as_buffer(), T.U64) for b in blobs]
        by_size = np.argsort(n, kind="stable")
        probe, member = by_size[asks[by_size]], by_size[~asks[by_size]]
        heads = [postings([own[i] for i in member], f(n[member], percent)) for f in (prefix, smaller_prefix)]
        weight, edges = np.zeros(len(node), np.int64), [np.zeros((2, 0), np.int64)]
        for s in range(0, len(probe), 256):
            q = probe[s : s + 256]
            # sets whose sizes alone forbid a link are left out
            lo, hi = np.searchsorted(n[member], [-(-percent * n[q[0]] // 100), 100 * n[q[-1]] // percent + 1])
            met = np.zeros((len(q), len(member)), bool)
            for f, head in zip((smaller_prefix, prefix), heads, strict=True):
                meet(met, postings([own[i] for i in q], f(n[q], percent)), head)
            met = met[:, lo:hi]
            q, m = q[met.any(1)], member[lo:hi][met.any(0)]
            if not len(m):
                continue
            shared = overlaps([own[i] for i in q], [own[i] for i in m])
            link = 100 * shared >= percent * (n[q][:, None] + n[m][None, :] - shared)
            # two that are both outside the core meet twice
            link &= core[m][None, :] | (node[q][:, None] < node[m][None, :])
            weight[q] += link @ copies[m]
            weight[m] += copies[q] @ link
            edges.append(spanning(link, node[q], node[m]))
        some = np.flatnonzero(weight)
        a, b = np.concatenate(edges, axis=1)
        rows = np.concatenate([np.stack([a, b, np.zeros_like(a)]), np.stack([node[some], node[some], weight[some]])], axis=1)
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("node", "other", "weight"), rows, strict=True)})

    found = kept.unionByName(asked).groupBy("cluster", "block", "turn").applyInArrow(compare, LINKS)
    return materialize(found.unionByName(certain), "links")


def smaller_prefix(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles of a set of which one is shared with every set that links with it and is not smaller: the overlap is at least that of
    two sets of its own size."""
    return n + (-2 * percent * n // (100 + percent)) + 1


def postings(sets: list[np.ndarray], most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of each set and their owners, by shingle."""
    token, owner = np.concatenate([np.zeros(0, T.U64), *(s[:k] for s, k in zip(sets, most.tolist(), strict=True))]), np.repeat(np.arange(len(sets)), most)
    order = np.argsort(token, kind="stable")
    return token[order], owner[order]


def meet(met: np.ndarray, rows: tuple[np.ndarray, np.ndarray], cols: tuple[np.ndarray, np.ndarray]) -> None:
    """Mark the pairs that share a posting, in slices that bound the memory."""
    lo, hi = np.searchsorted(cols[0], rows[0], "left"), np.searchsorted(cols[0], rows[0], "right")
    has = np.flatnonzero(hi > lo)
    lo, hi, owner = lo[has], hi[has], rows[1][has]
    cut = np.searchsorted(np.cumsum(hi - lo), np.arange(0, int((hi - lo).sum()) + 1, 1 << 21))
    for i, j in zip(cut, [*cut[1:], len(lo)], strict=True):
        row, k = T.ragged(hi[i:j] - lo[i:j])
        met[owner[i:j][row], cols[1][lo[i:j][row] + k]] = True


def spanning(link: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Edges from each linked row and column of a matrix of links to the least node of its component."""
    none = np.iinfo(np.int64).max
    r, c = np.where(link.any(1), rows, none), np.where(link.any(0), cols, none)
    while True:
        r2 = np.minimum(r, np.where(link, c[None, :], none).min(1, initial=none))
        c2 = np.minimum(c, np.where(link, r2[:, None], none).min(0, initial=none))
        if (r2 == r).all() and (c2 == c).all():
            break
        r, c = r2, c2
    a, b = np.r_[rows[r < none], cols[c < none]], np.r_[r[r < none], c[c < none]]
    return np.stack([a[a != b], b[a != b]])


def overlaps(rows: list[np.ndarray], cols: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, counted for one slice of the order of shingles after the other, and summed."""
    out = np.zeros(len(rows) * len(cols), np.int64)
    token, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    order = np.argsort(token)
    token, owner = token[order], owner[order]
    other, place = np.concatenate(cols), np.repeat(np.arange(len(cols)), [len(c) for c in cols])
    order = np.argsort(other)
    other, place = other[order], place[order]
    lo, hi = np.searchsorted(token, other, "left"), np.searchsorted(token, other, "right")
    has = np.flatnonzero(hi > lo)
    lo, hi, place = lo[has], hi[has], place[has]
    # slices of about two million meetings bound the memory
    cut = np.searchsorted(np.cumsum(hi - lo), np.arange(0, int((hi - lo).sum()) + 1, 1 << 21))
    for i, j in zip(cut, [*cut[1:], len(lo)], strict=True):
        row, k = T.ragged(hi[i:j] - lo[i:j])
        out += np.bincount(owner[lo[i:j][row] + k] * len(cols) + place[i:j][row], minlength=len(out))
    return out.reshape(len(rows), len(cols))


def link_components(docs: DataFrame, n: int = 5, percent: int = 75, dense: int = 24, tile: int = TILE) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of each row of ``docs``: ``n_links`` is the number of other rows that reach the
    threshold with the row, copies included; ``group`` is the component's least node, null without words."""
    text_batches(docs.sparkSession)
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = sketch_bits(size)
    table = members(docs, n, bits)
    classes = order_classes(table, bits)
    rows = table.where("part is null").select("doc_id", "text_hash", "n", "node")
    pairs = prefix_pairs(docs, classes, n, percent, dense, parts_for(docs.sparkSession, size))
    slack = F.greatest(F.col("na") - prefix_column("na", percent), F.col("nb") - prefix_column("nb", percent))
    likely = pairs.where("shared > 0").groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.sum("shared").alias("shared"))
    likely = likely.where((F.col("shared") + slack) * (100 + percent) >= percent * (F.col("na") + F.col("nb")))
    clusters = components(pairs.where("shared = 0").select("a", "b"))
    # pairs within a cluster are its tiles' to compare
    for c in ("a", "b"):
        likely = likely.join(small_side(clusters.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))), c, "left")
    likely = materialize(likely.where("ca is null or cb is null or ca != cb").drop("ca", "cb"), "candidates")
    nodes = likely.select(F.explode(F.array("a", "b")).alias("node")).unionByName(clusters.select("node")).distinct()
    rep = F.min(F.struct(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))).alias("rep")
    wanted = materialize(rows.join(small_side(nodes), "node", "left_semi").groupBy("node").agg(rep, F.count(F.lit(1)).alias("copies")), "wanted")
    sets = sets_of(docs, wanted, classes, n)
    ends = verified(likely.select("a", "b", "na", "nb"), sets, percent)
    ends = ends.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(ends.select(F.col("b").alias("node"), F.col("a").alias("other")))
    weights = small_side(wanted.select(F.col("node").alias("other"), F.col("copies").alias("weight")))
    links = materialize(ends.join(weights, "other").select("node", "other", "weight"), "links")
    if not clusters.isEmpty():
        label = clusters.withColumnRenamed("component", "cluster").join(small_side(wanted.select("node", "copies")), "node")
        links = links.unionByName(cluster_links(label, sets, percent, tile))
    joined = components(links.select(F.col("node").alias("a"), F.col("other").alias("b")))
    linked = materialize(joined.join(links.groupBy("node").agg(F.sum("weight").alias("linked")), "node", "left"), "linked")
    # nodes without links are alone but for their copies
    copies = rows.where("n > 0").groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first")).join(small_side(linked), "node", "left")
    copies = materialize(copies.withColumn("group", F.coalesce("component", "node")), "nodes")
    least = copies.where("component is not null").groupBy("group").agg(F.min("first").alias("least"))
    named = copies.join(small_side(least), "group", "left").select("node", "group", F.coalesce("least", "first").alias("least"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("links"))
    out = rows.join(named, "node", "left")
    null = lambda c: F.when(c != int(R.NO_ID), c)
    return out.select(null(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), null(F.coalesce("least", "doc_id")).alias("component_id"), "group", "text_hash", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def prefix_column(n: str, percent: int) -> Column:
    return F.expr(f"{n} - ceil({percent} * {n} / 100.0D) + 1")


def keep_one(docs: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs`` without the copies and near copies of others: of each component that of the least id (then of the
    least hash of its text) stays, once; rows without words all stay."""
    groups = materialize(link_components(docs, **kw), "groups")
    key = F.coalesce("doc_id", F.lit(int(R.NO_ID)))
    name = F.struct(key.alias("_id"), F.col("text_hash").alias("_hash"))
    kept = groups.where("group is not null").groupBy("group").agg(F.min(name).alias("one")).select("one.*")
    kept = kept.unionByName(groups.where("group is null").select("*", name.alias("one")).select("one.*")).distinct()
    own = docs.select(key.alias("_id"), F.xxhash64("text").alias("_hash"), F.struct(*docs.columns).alias("row"))
    own = own.join(small_side(materialize(kept, "kept")), ["_id", "_hash"], "left_semi")
    again = groups.where("group is not null").groupBy(name.alias("one")).count().where("count > 1").select("one.*")
    again = materialize(again, "again")
    if not again.isEmpty():  # rows that repeat id and text
        again = small_side(again)
        own = own.join(again, ["_id", "_hash"], "left_anti").unionByName(own.join(again, ["_id", "_hash"], "left_semi").dropDuplicates(["_id", "_hash"]))
    return own.select("row.*")
