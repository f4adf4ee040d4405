"""What the two operators on repeated windows share: anchors, which of them repeat, and the way back to the texts.

Each window of ``width`` items (words or bytes) is represented by its anchor, the k-gram of least hash in it, which depends
on the window's content alone: equal windows have equal anchors at the same place, and the count of a window is at most the
count of its anchor.  Neighbouring windows share an anchor, so there are about ``2 / (width - k)`` anchors an item.

Words have few anchors, and a count-min sketch of them is broadcast.  Bytes have many: their counts stay spread over the
tasks, which answer to the buckets of documents that asked (``shared_anchors``), and texts meet the answers there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._store import free_shuffles, materialize, partitions

NO_ID = np.iinfo(np.int64).max
#: Cells of a segment of the sketch; a cell's place and whether it was met twice fit 16 bits.
SEGMENT_BITS = 15


@dataclass
class Runs:
    """Windows that share an anchor: all starts from ``lo`` to ``hi``, the anchor's place ``at`` and hash; items of one run of documents."""

    at: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    doc: np.ndarray
    hash: np.ndarray

    def take(self, keep: np.ndarray) -> Runs:
        return Runs(self.at[keep], self.lo[keep], self.hi[keep], self.doc[keep], self.hash[keep])


def anchor_runs(codes: np.ndarray, first: np.ndarray, width: int, k: int) -> Runs:
    """``first`` has the index of each document's first item and the number of items."""
    parts = []
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for s in range(0, max(1, len(codes)), T.SEGMENT):
        own = codes[s : s + T.SEGMENT + width - 1]
        gram = T.rolling(own, k)
        a = T.anchors(gram, width, k)
        if not len(a):
            continue
        start = np.arange(len(a)) + s
        doc = owner[start]
        keep = np.flatnonzero(start + width <= first[doc + 1])
        a, start, doc = a[keep], start[keep], doc[keep]
        if not len(a):
            continue
        new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])])
        last = np.r_[new[1:], len(a)] - 1
        parts.append(Runs(a[new] + s, start[new], start[last], doc[new], gram[a[new]]))
    if not parts:
        e = np.zeros(0, np.int64)
        return Runs(e, e, e, e, np.zeros(0, T.U64))
    return Runs(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("at", "lo", "hi", "doc", "hash")))


def items_of(data: np.ndarray, off: np.ndarray, by_words: bool) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the items and the index of each document's first item."""
    if not by_words:
        return T.CODE[data], off
    start, end, first = T.words(data, off, T.SPACE)
    return T.span_hashes(data, start, end, T.CODE), first


def cells(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell of a hash in each of two rows of ``2**bits`` cells."""
    return (h >> T.U64(64 - bits)).astype(np.int64), (T.mix(h) >> T.U64(64 - bits)).astype(np.int64)


def text_bytes(docs: DataFrame) -> int:
    return docs.select(F.sum(F.octet_length("text"))).first()[0] or 0


def sketch_bits(size: int, by_words: bool, width: int, k: int, most: int = 28) -> int:
    """Cells of a row of the sketch, as a power of two: four times the anchors to expect from the corpus's bytes, up to ``2**most``."""
    anchors = size / (6 if by_words else 1) * 2 / (width - k + 2)
    return max(SEGMENT_BITS, min(most, int(np.ceil(np.log2(4 * anchors + 1)))))


def repeated_anchors(docs: DataFrame, by_words: bool, width: int, k: int, bits: int) -> np.ndarray:
    """Count-min sketch of the anchors over all documents, as two packed rows of "counted twice at least".

    Each task counts (up to 2) what its documents hold, once a document, and sends the cells that it touched by segments of
    the sketch; the segments of all tasks are added in parallel.  The result has ``2 * 2**bits / 8`` bytes, 64 MB at most: where
    many more anchors than cells exist it lets more pass, and loses none.
    """
    low = (1 << SEGMENT_BITS) - 1

    def send(touched: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(touched):  # only texts without a window
            return
        seg = touched >> SEGMENT_BITS
        cut = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
        value = ((touched & low) << 1 | (n > 1)).astype(np.uint16)
        blobs = [value[i:j].tobytes() for i, j in zip(cut, np.r_[cut[1:], len(seg)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(seg[cut], pa.int32()), pa.array(blobs, pa.binary())], ["segment", "cells"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            data, off = T.column(batch.column(0))
            for i, j in T.runs(off):
                codes, first = items_of(data[off[i] : off[j]], off[i : j + 1] - off[i], by_words)
                r = anchor_runs(codes, first, width, k)
                order = np.lexsort((r.hash, r.doc))
                h, d = r.hash[order], r.doc[order]
                h = h[np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])]] if len(h) else h
                a, b = cells(h, bits)
                held += [a, b + (1 << bits)]
                size += 2 * len(h)
            if size > 1 << 21:
                yield from send(*np.unique(np.concatenate(held), return_counts=True))
                held, size = [], 0
        if held:
            yield from send(*np.unique(np.concatenate(held), return_counts=True))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for seg, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                c = counts.setdefault(seg, np.zeros(low + 1, np.uint8))
                v = np.frombuffer(blob.as_buffer(), np.uint16)
                at = v >> 1
                c[at] = np.minimum(c[at] + 1 + (v & 1).astype(np.uint8), 2)
        for seg, c in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([seg], pa.int32()), pa.array([np.packbits(c > 1).tobytes()], pa.binary())], ["segment", "twice"])

    segments = 2 << (bits - SEGMENT_BITS)
    rows = docs.select("text").mapInArrow(count, "segment int, cells binary").repartition(min(segments, partitions(docs.sparkSession)), "segment").mapInArrow(add, "segment int, twice binary")
    out = np.zeros((segments, (low + 1) // 8), np.uint8)
    found = rows.collect()  # of bounded size
    del rows
    free_shuffles(docs.sparkSession)
    for seg, twice in found:
        out[seg] = np.frombuffer(twice, np.uint8)
    return out.reshape(2, -1)


def likely(sketch: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """Whether the sketch holds the hash twice or more, in both rows."""
    out = np.ones(len(h), bool)
    for row, at in zip(sketch, cells(h, bits), strict=True):
        out &= (row[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return out


def homes(doc: np.ndarray, text_hash: np.ndarray, parts: int) -> np.ndarray:
    """The bucket in which a document's text meets the answers to its anchors."""
    return (T.mix(doc.view(T.U64) ^ T.mix(text_hash.view(T.U64))) % T.U64(parts)).astype(np.int64)


def shares(h: np.ndarray, parts: int) -> np.ndarray:
    """Of each hash the share that counts it, and below that 32 bits more: as many cells as the corpus has shares, times ``2**32``."""
    return (h % T.U64(parts)) << T.U64(32) | h >> T.U64(32)


def planes(x: np.ndarray) -> bytes:
    """Numbers by planes of their bytes, of which the upper ones shrink well."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def from_planes(raw: memoryview, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def answers(home: np.ndarray, cell: np.ndarray) -> pa.RecordBatch:
    """One blob of distinct cells for each bucket of documents."""
    order = np.lexsort((cell, home))
    home, cell = home[order], cell[order]
    new = np.r_[True, (home[1:] != home[:-1]) | (cell[1:] != cell[:-1])][: len(cell)]
    home, cell = home[new], cell[new]
    at = np.flatnonzero(np.r_[True, home[1:] != home[:-1]][: len(home)])
    blobs = [squeeze(planes(np.diff(cell[i:j], prepend=T.U64(0)))) for i, j in zip(at, np.r_[at[1:], len(cell)], strict=True)] if len(at) else []
    return pa.RecordBatch.from_arrays([pa.array(home[at], pa.int32()), pa.array(blobs, pa.binary()), pa.array(np.ones(len(at), bool))], ["bucket", "blob", "ready"])


def shared_anchors(docs: DataFrame, by_words: bool, width: int, k: int, parts: int) -> DataFrame:
    """Cells of the anchors that two documents hold, as blobs for the buckets (see ``homes``) of these documents.

    Each task asks for the cells of its documents, once a document, at the share that counts them; what two of its own documents
    hold it answers itself and only reports, so that a frequent cell costs its share one number a task.  Nothing is sent to the
    driver or broadcast, and shares follow the corpus: a cell that one document holds passes once in ``2**32 /`` the cells of a share.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, rows = [], 0, 0
        for batch in batches:
            home = homes(keys_of(batch.column(0)), batch.column(1).to_numpy(), parts)
            data, off = T.column(batch.column(2))
            for i, j in T.runs(off):
                codes, first = items_of(data[off[i] : off[j]], off[i : j + 1] - off[i], by_words)
                r = anchor_runs(codes, first, width, k)
                held.append((shares(r.hash, parts), r.doc + rows + i, home[i:j][r.doc]))
                size += len(r.hash)
            rows += len(home)
            if size > 1 << 20:
                yield from send(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, size = [], 0
        if size:
            yield from send(*(np.concatenate(x) for x in zip(*held, strict=True)))

    def send(cell: np.ndarray, doc: np.ndarray, home: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(cell, kind="stable")  # documents stay in order
        cell, doc, home = cell[order], doc[order], home[order]
        new = np.r_[True, (cell[1:] != cell[:-1]) | (doc[1:] != doc[:-1])]
        cell, home = cell[new], home[new]
        at = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        n = np.diff(np.r_[at, len(cell)])
        twice = np.repeat(n > 1, n)
        yield answers(home[twice], cell[twice])
        cell, who = cell[at], np.where(n > 1, 0, home[at] + 1).astype(np.uint32)  # 0: has its answer
        share = (cell >> T.U64(32)).astype(np.int64)
        low = cell.astype(np.uint32)
        cut = np.flatnonzero(np.r_[True, share[1:] != share[:-1]])
        blobs = [squeeze(planes(np.r_[np.diff(low[i:j], prepend=np.uint32(0)), who[i:j]])) for i, j in zip(cut, np.r_[cut[1:], len(cell)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(share[cut], pa.int32()), pa.array(blobs, pa.binary()), pa.array(np.zeros(len(cut), bool))], ["bucket", "blob", "ready"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, list[pa.Scalar]] = {}
        for batch in batches:
            ready = batch.column(2)
            if ready.true_count:
                yield batch.filter(ready).select(["bucket", "blob"])
            rest = batch.filter(pc.invert(ready))
            for share, blob in zip(rest.column(0).to_pylist(), rest.column(1), strict=True):
                asked.setdefault(share, []).append(blob)
        for share in list(asked):
            got = [from_planes(unsqueeze(blob), np.uint32).reshape(2, -1) for blob in asked.pop(share)]
            low, who = np.concatenate([np.cumsum(x, dtype=np.uint32) for x, _ in got]), np.concatenate([x for _, x in got])
            order = np.argsort(low)
            low, who = low[order], who[order]
            at = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
            n = np.diff(np.r_[at, len(low)])
            tell = np.repeat(n > 1, n) & (who > 0)
            yield answers(who[tell].astype(np.int64) - 1, T.U64(share << 32) | low[tell].astype(T.U64)).select(["bucket", "blob"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(ask, "bucket int, blob binary, ready boolean")
    return materialize(rows.repartition(parts, "bucket").mapInArrow(answer, "bucket int, blob binary"), "anchors")


def at_home(docs: DataFrame, told: DataFrame, parts: int) -> DataFrame:
    """The texts of ``docs`` in their buckets, as blobs of at most 4 MB or one text, beside the answers ``told``; ``read_home`` reads a task's share."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes, texts, size = [], [], [], 0
        for batch in batches:
            ids.append(keys_of(batch.column(0)))
            hashes.append(batch.column(1).to_numpy())
            texts.append(pc.fill_null(batch.column(2).cast(pa.large_string()), ""))
            size += batch.column(2).nbytes
            if size > 1 << 24:
                yield send(np.concatenate(ids), np.concatenate(hashes), pa.concat_arrays(texts))
                ids, hashes, texts, size = [], [], [], 0
        if ids:
            yield send(np.concatenate(ids), np.concatenate(hashes), pa.concat_arrays(texts))

    def send(ids: np.ndarray, hashes: np.ndarray, texts: pa.Array) -> pa.RecordBatch:
        bucket = homes(ids, hashes, parts)
        order = np.argsort(bucket, kind="stable")
        ids, hashes, bucket = ids[order], hashes[order], bucket[order]
        data, off = T.column(texts.take(pa.array(order)))
        cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)])
        numbers, blobs = [], []
        for a, b in zip(cut, np.r_[cut[1:], len(bucket)], strict=True) if len(cut) else ():
            for i, j in T.runs(off[a : b + 1], 1 << 22):
                i, j = i + a, j + a
                numbers.append(bucket[a])
                blobs.append(squeeze(b"".join([np.int64(j - i).tobytes(), ids[i:j].tobytes(), hashes[i:j].tobytes(), (off[i : j + 1] - off[i]).tobytes(), data[off[i] : off[j]].tobytes()])))
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary()), pa.array(np.ones(len(numbers), bool))], ["bucket", "blob", "text"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(pack, "bucket int, blob binary, text boolean")
    return rows.union(told.select("bucket", "blob", F.lit(False).alias("text"))).repartition(parts, "bucket")


def read_home(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
    """The sorted cells that repeat, and ids, hashes, bytes and offsets of the texts, blob by blob; none where nothing repeats."""
    cells, blobs = [np.zeros(0, T.U64)], []
    for batch in batches:
        for is_text, blob in zip(batch.column(2).to_pylist(), batch.column(1), strict=True):
            if is_text:
                blobs.append(blob)
            else:
                cells.append(np.cumsum(from_planes(unsqueeze(blob), T.U64), dtype=T.U64))

    def texts() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for blob in blobs:
            raw = unsqueeze(blob)
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            ids, hashes, off = np.split(np.frombuffer(raw, np.int64, 3 * n + 1, 8), [n, 2 * n])
            yield ids, hashes, np.frombuffer(raw, np.uint8, -1, 8 * (3 * n + 2)), off

    found = np.unique(np.concatenate(cells))
    return found, texts() if len(found) else iter(())


def among(found: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Whether the sorted numbers hold each cell."""
    return found[np.minimum(np.searchsorted(found, cell), len(found) - 1)] == cell


def squeeze(raw: bytes) -> bytes:
    """Sorted columns shrink well; the exchange is what fills disks."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueeze(blob: pa.Scalar) -> memoryview:
    b = blob.as_buffer()
    return memoryview(pa.decompress(b.slice(8), int.from_bytes(b.slice(0, 8).to_pybytes(), "little"), codec="zstd"))


def keys_of(ids: pa.Array) -> np.ndarray:
    """Document ids; a null one stands behind all others."""
    return ids.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


#: Rows of the exchange of spans: the bucket of their documents, and columns of (document, hash of its text, start, end).
SPANS = "bucket int, spans binary"


def span_rows(doc: np.ndarray, text_hash: np.ndarray, start: np.ndarray, end: np.ndarray, parts: int) -> pa.RecordBatch:
    """Spans, merged where they touch in order, as one blob for each bucket of documents."""
    bucket = ((T.mix(doc.view(T.U64)) % T.U64(parts)).astype(np.int64)) if len(doc) else np.zeros(0, np.int64)
    order = np.lexsort((start, text_hash, doc, bucket))
    bucket, doc, text_hash, start, end = bucket[order], doc[order], text_hash[order], start[order], end[order]
    numbers, blobs = [], []
    if len(doc):
        # spans that still overlap, where ends don't grow with starts, are joined by merged()
        new = np.r_[True, (doc[1:] != doc[:-1]) | (text_hash[1:] != text_hash[:-1])] | np.r_[True, start[1:] > end[:-1]]
        at = np.flatnonzero(new)
        last = np.r_[at[1:], len(doc)] - 1
        rows = np.stack([doc[at], text_hash[at], start[at], end[last]])
        cut = np.searchsorted(bucket[at], np.arange(parts + 1))
        for b in np.flatnonzero(np.diff(cut)).tolist():
            numbers.append(b)
            blobs.append(squeeze(rows[:, cut[b] : cut[b + 1]].tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "spans"])


def gathered(spans: DataFrame, parts: int) -> DataFrame:
    """One row for each document with spans: doc_id, text_hash and the merged spans as pairs of 64-bit numbers."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [np.frombuffer(unsqueeze(x), np.int64).reshape(4, -1) for b in batches for x in b.column(1)]
        if not got:
            return
        doc, text_hash, start, end = np.concatenate(got, axis=1)
        order = np.lexsort((text_hash, doc))
        doc, text_hash, pairs = doc[order], text_hash[order], np.c_[start[order], end[order]]
        at = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (text_hash[1:] != text_hash[:-1])])
        blobs = [merged(pairs[i:j]).tobytes() for i, j in zip(at, np.r_[at[1:], len(doc)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(text_hash[at]), pa.array(blobs, pa.binary())], ["doc_id", "text_hash", "spans"])

    return spans.repartition(parts, "bucket").mapInArrow(gather, "doc_id bigint, text_hash bigint, spans binary")


def merged(p: np.ndarray) -> np.ndarray:
    """The union of spans as sorted, disjoint, non-touching pairs."""
    if not len(p):
        return np.zeros((0, 2), np.int64)
    p = p[np.lexsort((p[:, 1], p[:, 0]))]
    reach = np.maximum.accumulate(p[:, 1])
    at = np.flatnonzero(np.r_[True, p[1:, 0] > reach[:-1]])
    return np.c_[p[at, 0], reach[np.r_[at[1:], len(p)] - 1]]


def pairs_of(blob: bytes | None) -> np.ndarray:
    return np.frombuffer(blob or b"", np.int64).reshape(-1, 2)


def with_spans(docs: DataFrame, spans: DataFrame, parts: int) -> DataFrame:
    """Each row of ``docs`` as a struct ``row``, with ``spans``, its merged spans; these, short against texts, make the hash table."""
    per = materialize(gathered(spans, parts), "spans").hint("shuffle_hash")
    d = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce("doc_id", F.lit(int(NO_ID))).alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    return d.join(per, ["doc_id", "text_hash"], "left").select("row", "spans")


def with_columns(docs: DataFrame, rows: DataFrame, cut: Column, names: tuple[str, ...]) -> DataFrame:
    """The columns of ``docs`` from ``row`` but those of added names, and the fields of ``cut``."""
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in names]
    return rows.select("row", cut.alias("cut")).select(*own, *[F.col("cut").getField(c).alias(c) for c in names])
