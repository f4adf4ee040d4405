"""Removal of long word passages that an earlier document holds already.

A window is ``width`` consecutive words of one document.  The first pass counts, in sketches of each partition that are
merged, the anchors of the windows (see ``_repeats``): the estimate of a window never lies below its count.  The second pass
groups only the windows estimated to be repeated, by 128 bits of two independent hashes: within a task every window but those of
the least document is marked at once, so a passage that many documents share leaves each task once for each million of windows;
what is left meets by hash.  Marked windows return to their documents as spans.

Words are what ASCII white space parts.  Windows are judged on the input.  Null texts have no words; texts shorter than a
window keep all; rows of one id do not remove each other's words, and a null id stands behind all others; an empty table
gives an empty one; other columns are kept, those of added names replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _repeats as R
from . import _text as T
from ._store import parts_for, text_batches


def repeated_spans(docs: DataFrame, width: int = 50, k: int = 8, bits: int | None = None) -> tuple[DataFrame, int]:
    """Spans of word numbers to remove, as ``_repeats.span_rows`` packs them, and the number of their buckets."""
    text_batches(docs.sparkSession)
    spark = docs.sparkSession
    size = R.text_bytes(docs)
    bits, parts = bits or R.sketch_bits(size, True, width, k), parts_for(spark, size)
    sketch = spark.sparkContext.broadcast(R.repeated_anchors(docs, True, width, k, bits))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, size = [], 0
        for batch in batches:
            ids, th = R.keys_of(batch.column(0)), batch.column(1).to_numpy()
            data, off = T.column(batch.column(2))
            for i, j in T.runs(off):
                own = data[off[i] : off[j]]
                begin, end, first = T.words(own, off[i : j + 1] - off[i], T.SPACE)
                codes = T.span_hashes(own, begin, end, T.CODE)
                r = R.anchor_runs(codes, first, width, k)
                r = r.take(R.likely(sketch.value, r.hash, bits))
                if not len(r.at):
                    continue
                row, place = T.ragged(r.hi - r.lo + 1)
                start = r.lo[row] + place
                doc = r.doc[row]
                second = hashes(T.span_hashes(own, begin, end, T.CODE2), width)[start]
                got.append((hashes(codes, width)[start], second, ids[i:j][doc], th[i:j][doc], start - first[doc], (r.hash[row] % T.U64(parts)).astype(np.int32)))
                size += len(start)
            if size > 1 << 20:
                yield from send(got)
                got, size = [], 0
        if got:
            yield from send(got)

    def send(got: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        wh, second, doc, text_hash, pos, bucket = (np.concatenate(x) for x in zip(*got, strict=True))
        later = doc > least_of(wh, second, doc)
        out = R.span_rows(doc[later], text_hash[later], pos[later], pos[later] + width, parts)
        yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.ones(out.num_rows, bool))], ["bucket", "spans", "ready"])
        wh, second, doc, text_hash, pos, bucket = (x[~later] for x in (wh, second, doc, text_hash, pos, bucket))
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(parts + 1))
        rows, blobs = [], []
        for b in np.flatnonzero(np.diff(cut)).tolist():
            o = order[cut[b] : cut[b + 1]]
            rows.append(b)
            blobs.append(R.squeeze(np.stack([wh[o].view(np.int64), doc[o], text_hash[o], pos[o], second[o].view(np.int64)]).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(blobs, pa.binary()), pa.array(np.zeros(len(rows), bool))], ["bucket", "spans", "ready"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for batch in batches:
            ready = batch.column(2)
            if ready.true_count:
                yield batch.filter(ready).select(["bucket", "spans"])
            for blob in batch.filter(pc.invert(ready)).column(1):
                b = R.unsqueeze(blob)
                got.append(np.frombuffer(b, np.int64).reshape(5, -1))
        if not got:
            return
        wh, doc, text_hash, pos, second = np.concatenate(got, axis=1)
        del got
        later = doc > least_of(wh, second, doc)
        yield R.span_rows(doc[later], text_hash[later], pos[later], pos[later] + width, parts)

    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(deal, f"{R.SPANS}, ready boolean")
    return rows.repartition(parts, "bucket").mapInArrow(settle, R.SPANS), parts


def hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows, in segments where the text is very long."""
    n = len(codes) - width + 1
    return np.concatenate([T.rolling(codes[s : s + T.SEGMENT + width - 1], width) for s in range(0, max(n, 1), T.SEGMENT)])


def least_of(key: np.ndarray, second: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The least document of each row's pair of keys."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    if len(k) and ((k[1:] == k[:-1]) & (second[order][1:] != second[order][:-1])).any():  # one hash, two windows
        order = np.lexsort((second, key))
        k = key[order]
    s = second[order]
    at = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (s[1:] != s[:-1])]) if len(k) else np.zeros(0, np.int64)
    out = np.empty_like(doc)
    if len(k):
        out[order] = np.repeat(np.minimum.reduceat(doc[order], at), np.diff(np.r_[at, len(k)]))
    return out


def remove(docs: DataFrame, width: int = 50, k: int = 8, bits: int | None = None) -> DataFrame:
    """``docs`` with ``kept_text`` (words joined by one space), ``n_words``, ``n_removed`` and ``removed_spans`` (of words)."""
    pairs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    @F.arrow_udf("struct<kept_text:string,n_words:bigint,n_removed:bigint,removed_spans:array<struct<start:bigint,end:bigint>>>")
    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        kept, n, gone, out = [], [], [], []
        for t, s in zip(text.to_pylist(), spans.to_pylist(), strict=True):
            w = (t or "").encode().split()  # bytes split at ASCII white space only
            p = R.pairs_of(s)
            n.append(len(w))
            gone.append(int((p[:, 1] - p[:, 0]).sum()))
            for a, b in p[::-1].tolist():
                del w[a:b]
            kept.append(b" ".join(w).decode())
            out.append([{"start": a, "end": b} for a, b in p.tolist()])
        return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pairs)], ["kept_text", "n_words", "n_removed", "removed_spans"])

    rows = R.with_spans(docs, *repeated_spans(docs, width, k, bits))
    return R.with_columns(docs, rows, cut("row.text", "spans"), ("kept_text", "n_words", "n_removed", "removed_spans"))


def brute_force(texts: list[tuple[int | None, str | None]], width: int = 50) -> list[list[str]]:
    """Kept words of each row, by comparing all windows; for tests."""
    words = [[w.decode() for w in (t or "").encode().split()] for _, t in texts]
    least: dict[tuple[str, ...], int] = {}
    ids = [R.NO_ID if i is None else i for i, _ in texts]
    for i, w in zip(ids, words, strict=True):
        for s in range(len(w) - width + 1):
            key = tuple(w[s : s + width])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, w in zip(ids, words, strict=True):
        gone = {p for s in range(len(w) - width + 1) if least[tuple(w[s : s + width])] < i for p in range(s, s + width)}
        out.append([x for p, x in enumerate(w) if p not in gone])
    return out
