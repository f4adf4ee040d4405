"""Removal of repeated byte strings by a distributed merge sort of suffixes that heeds common prefixes.

A 50-byte window that also starts in an earlier document is found where both hold the same anchor (see ``_repeats``), so only
the suffixes that start at anchors are sorted, as far as the windows of the anchor reach, with the bytes before the anchor
beside them.  Anchors that occur in one document only are left out: their counts are spread over the tasks and answered to
buckets of documents, where the texts meet them, so no table of them has to fit one machine.  Equal stretches within a task leave it
once.  Each task sorts its suffixes into runs, dealt by the hash of their first ``k`` bytes so that equal prefixes meet, and
sends the runs front-coded: the length of the prefix common with the suffix before, and the rest.  A loser tree merges the
runs of a partition: it knows for each run how many bytes its next suffix shares with the last one given out, the longer
share wins without a look at the bytes, and only equal shares are compared, from that place on.  The merged sequence with
its common prefix lengths groups the suffixes for every window exactly to the right of the anchor; the bytes to the left are
compared by 64-bit hash.

Null texts are empty.  Windows are judged on the input and never cross documents.  Rows of one id do not remove each other's
bytes, and a null id stands behind all others.  Texts shorter than a window keep all; an empty table gives an empty one;
other columns are kept, those of added names replaced.
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


def loser_tree(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int]]:
    """Merge sorted runs of (suffixes, lengths of the prefix common with the suffix before in the run).

    Gives the number of the run of each suffix in order, and the prefix that it shares with the one given out before.
    """
    k = 1
    while k < len(runs):
        k *= 2
    keys = [r[0] for r in runs] + [[]] * (k - len(runs))
    lcps = [r[1] for r in runs] + [[]] * (k - len(runs))
    sizes = [len(x) for x in keys]
    at = [0] * k
    # an inner node holds the run that lost there and its share with the run that won; -1 stands for a run at its end
    node, share = [0] * (2 * k), [0] * (2 * k)
    winner, won = list(range(2 * k)), [0] * (2 * k)
    for i in range(k):
        winner[k + i], won[k + i] = i, (0 if sizes[i] else -1)

    def beats(a: int, sa: int, b: int, sb: int) -> tuple[bool, int]:
        """Whether run a goes first, and the share of the loser with the winner."""
        if sa != sb:
            return (sa > sb), (sb if sa > sb else sa)
        if sa < 0:
            return True, -1
        x, y = keys[a][at[a]], keys[b][at[b]]
        n = min(len(x), len(y))
        if x[sa:n] == y[sa:n]:
            return len(x) <= len(y), n
        while x[sa] == y[sa]:
            sa += 1
        return x[sa] < y[sa], sa

    for n in range(k - 1, 0, -1):
        a, b = 2 * n, 2 * n + 1
        first, s = beats(winner[a], won[a], winner[b], won[b])
        w, lo = (a, b) if first else (b, a)
        winner[n], won[n], node[n], share[n] = winner[w], won[w], winner[lo], s
    r, s = (winner[1], won[1])
    while s >= 0:
        yield r, s
        i = at[r] = at[r] + 1
        s = lcps[r][i] if i < sizes[r] else -1
        n = (k + r) >> 1
        while n:
            other = share[n]
            if other > s:
                r, node[n] = node[n], r
                share[n], s = s, other
            elif other == s and s >= 0:
                # both share as much with the last one: compare from there on
                q = node[n]
                x, y = keys[r][at[r]], keys[q][at[q]]
                m = len(x) if len(x) < len(y) else len(y)
                if x[s:m] == y[s:m]:
                    j, first = m, len(x) <= len(y)
                else:
                    j = s
                    while x[j] == y[j]:
                        j += 1
                    first = x[j] < y[j]
                share[n] = j
                if not first:
                    r, node[n] = q, r
            n >>= 1


def front_code(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The prefix that each of the sorted, zero-padded rows shares with the one before."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        first = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
        out[1:] = np.minimum(first, np.minimum(lengths[1:], lengths[:-1]))
    return out


def gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of spans, one after another."""
    row, place = T.ragged(length)
    return data[start[row] + place]


def pad(data: np.ndarray, start: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
    """Spans as rows of zero-padded bytes."""
    if not len(start):
        return np.zeros((0, width), np.uint8)
    cols = np.arange(width)
    at = np.minimum(start[:, None] + cols, len(data) - 1)
    return np.where(cols < length[:, None], data[at], 0).astype(np.uint8)


class _Run:
    """A sorted run for the exchange: numbers of each suffix, then the bytes that it doesn't share, then those to its left."""

    @staticmethod
    def pack(doc, text_hash, at, left, length, share, rest: np.ndarray, before: np.ndarray) -> bytes:
        # documents are named once
        docs, own = np.unique(np.stack([doc, text_hash]), axis=1, return_inverse=True)
        head = np.array([len(at), docs.shape[1], len(rest), len(before)], np.int64)
        small = np.stack([left, length, share]).astype(np.uint8)
        return R.squeeze(b"".join([head.tobytes(), R.planes(docs.ravel()), R.planes(own.astype(np.uint32)), R.planes(at), *(x.tobytes() for x in (small, rest, before))]))

    def __init__(self, blob: memoryview) -> None:
        n, d, r, b = np.frombuffer(blob, np.int64, 4).tolist()
        p = 32
        docs = R.from_planes(blob[p : p + 16 * d], np.int64).reshape(2, d)
        p += 16 * d
        own = R.from_planes(blob[p : p + 4 * n], np.uint32)
        p += 4 * n
        self.at = R.from_planes(blob[p : p + 8 * n], np.int64)
        p += 8 * n
        self.left, self.length, self.share = np.frombuffer(blob, np.uint8, 3 * n, p).reshape(3, n).astype(np.int64)
        p += 3 * n
        rest, self.before = np.frombuffer(blob, np.uint8, r, p), np.frombuffer(blob, np.uint8, b, p + r)
        self.doc, self.text_hash = docs[0][own], docs[1][own]
        keys, last, p, raw = [], b"", 0, rest.tobytes()
        for s, size in zip(self.share.tolist(), self.length.tolist(), strict=True):
            q = p + size - s
            last = last[:s] + raw[p:q]
            keys.append(last)
            p = q
        self.keys = keys


def repeated_spans(docs: DataFrame, width: int = 50, k: int = 20) -> tuple[DataFrame, int]:
    """Spans of bytes to remove, as ``_repeats.span_rows`` packs them, and the number of their buckets."""
    text_batches(docs.sparkSession)
    parts = parts_for(docs.sparkSession, R.text_bytes(docs))
    told = R.shared_anchors(docs, False, width, k, parts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, stored = R.read_home(batches)
        ids, hashes, texts, size = [], [], [], 0
        for own, text_hash, data, off in stored:
            ids.append(own)
            hashes.append(text_hash)
            texts.append((data, off))
            size += len(data)
            if size > 1 << 25:  # one sorted run for each 32 MB of text
                yield from sort(found, ids, hashes, texts)
                ids, hashes, texts, size = [], [], [], 0
        if ids:
            yield from sort(found, ids, hashes, texts)

    def sort(found, ids, hashes, texts) -> Iterator[pa.RecordBatch]:
        got, base, rows = [], 0, 0
        for data, off in texts:
            for i, j in T.runs(off):
                own = data[off[i] : off[j]]
                r = R.anchor_runs(T.CODE[own], off[i : j + 1] - off[i], width, k)
                r = r.take(R.among(found, R.shares(r.hash, parts)))
                if len(r.at):
                    whole = T.span_hashes_apart(own, r.lo, r.hi + width)
                    at = base + off[i]
                    got.append((r.at + at, r.lo + at, r.hi + at, r.doc + rows + i, r.hash, whole))
            base += len(data)
            rows += len(off) - 1
        if not got:
            return
        data = np.concatenate([d for d, _ in texts])
        first = np.concatenate([o[:-1] + b for (_, o), b in zip(texts, np.cumsum([0, *(len(d) for d, _ in texts[:-1])]), strict=True)])
        at, lo, hi, row, gram, whole = (np.concatenate(x) for x in zip(*got, strict=True))
        doc, text_hash, start = np.concatenate(ids)[row], np.concatenate(hashes)[row], first[row]
        # of equal stretches that share an anchor only those of the least document go on
        key = whole ^ T.mix(gram + (at - lo).astype(T.U64))
        later = doc > least_of(key, doc)
        out = R.span_rows(doc[later], text_hash[later], (lo - start)[later], (hi + width - start)[later], parts)
        yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.ones(out.num_rows, bool))], ["bucket", "spans", "ready"])
        at, lo, hi, doc, text_hash, start, gram = (x[~later] for x in (at, lo, hi, doc, text_hash, start, gram))
        bucket = (gram % T.U64(parts)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[by], np.arange(parts + 1))
        numbers, blobs = [], []
        for b in range(parts):
            o = by[cut[b] : cut[b + 1]]
            if not len(o):
                continue
            length = hi[o] + width - at[o]
            suffix = pad(data, at[o], length, width)
            order = np.argsort(length, kind="stable")
            order = order[np.argsort(suffix.view(f"S{width}").ravel()[order], kind="stable")]
            o, suffix, length = o[order], suffix[order], length[order]
            # a suffix that ends in zero bytes ties with its shorter prefix, which lengths put first
            share = front_code(suffix, length)
            left = at[o] - lo[o]
            numbers.append(b)
            blobs.append(_Run.pack(doc[o], text_hash[o], at[o] - start[o], left, length, share, gather(data, at[o] + share, length - share), gather(data, lo[o], left)))
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary()), pa.array(np.zeros(len(numbers), bool))], ["bucket", "spans", "ready"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[int, list[pa.Scalar]] = {}
        for batch in batches:
            ready = batch.column(2)
            if ready.true_count:
                yield batch.filter(ready).select(["bucket", "spans"])
            rest = batch.filter(pc.invert(ready))
            for b, blob in zip(rest.column(0).to_pylist(), rest.column(1), strict=True):
                runs.setdefault(b, []).append(blob)
        for b in list(runs):  # one is unpacked at a time
            yield from judged([_Run(R.unsqueeze(blob)) for blob in runs.pop(b)])

    def judged(own: list[_Run]) -> Iterator[pa.RecordBatch]:
        merged = np.fromiter((x for pair in loser_tree([(r.keys, r.share.tolist()) for r in own]) for x in pair), np.int64).reshape(-1, 2)
        which, share = merged[:, 0], merged[:, 1]
        # the n-th time that a run is named is its n-th suffix
        base = np.cumsum([0, *(len(r.at) for r in own[:-1])])
        order = np.argsort(which, kind="stable")
        place = np.empty(len(which), np.int64)
        place[order] = np.arange(len(which))
        doc, text_hash, at, left, length = (np.concatenate([getattr(r, f) for r in own])[place] for f in ("doc", "text_hash", "at", "left", "length"))
        before, ends = np.concatenate([r.before for r in own]), np.cumsum(np.concatenate([r.left for r in own]))[place]
        del base, order
        # a suffix alone under its first k bytes is in one document only
        near = np.r_[share[1:], 0]
        keep = np.maximum(share, near) >= k
        hit = np.zeros((len(at), width - k + 1), np.int8)
        back = np.zeros(len(at), T.U64)
        for o in range(width - k + 1):  # windows that start o bytes before the anchor
            if o:
                reach = left >= o
                back[reach] = T.mix(back[reach] * T.U64(T.BASE) + T.CODE[before[ends[reach] - o]])
            group = np.cumsum(share < width - o)
            has = np.flatnonzero(keep & (left >= o) & (length >= width - o))
            if not len(has):
                continue
            alone = np.bincount(group[has], minlength=group[-1] + 1)[group[has]] < 2
            has = has[~alone]
            key = T.mix(back[has] ^ T.mix(group[has].astype(T.U64)))
            hit[has[doc[has] > least_of(key, doc[has])], o] = 1
        # neighbouring windows of a suffix are one span
        edge = np.diff(hit, axis=1, prepend=np.int8(0), append=np.int8(0))
        row, first = np.nonzero(edge == 1)
        last = np.nonzero(edge == -1)[1] - 1
        if len(row):
            yield R.span_rows(doc[row], text_hash[row], at[row] - last, at[row] - first + width, parts)

    rows = R.at_home(docs, told, parts).mapInArrow(deal, f"{R.SPANS}, ready boolean")
    return rows.repartition(parts, "bucket").mapInArrow(settle, R.SPANS), parts


def least_of(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The least document of each row's key."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    out = np.empty_like(doc)
    if len(k):
        out[order] = np.repeat(np.minimum.reduceat(doc[order], at), np.diff(np.r_[at, len(k)]))
    return out


def remove(docs: DataFrame, width: int = 50, k: int = 20) -> DataFrame:
    """``docs`` with ``kept_bytes``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``removed_spans``."""
    pairs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    @F.arrow_udf("struct<kept_bytes:binary,n_bytes:bigint,n_removed:bigint,n_spans:bigint,removed_spans:array<struct<start:bigint,end:bigint>>>")
    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        kept, n, gone, count, out = [], [], [], [], []
        for t, s in zip(text.to_pylist(), spans.to_pylist(), strict=True):
            raw, p, last, own = (t or "").encode(), R.pairs_of(s).tolist(), 0, []
            for a, b in p:
                own.append(raw[last:a])
                last = b
            kept.append(b"".join([*own, raw[last:]]))
            n.append(len(raw))
            gone.append(len(raw) - len(kept[-1]))
            count.append(len(p))
            out.append([{"start": a, "end": b} for a, b in p])
        cols = [pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (n, gone, count)), pa.array(out, pairs)]
        return pa.StructArray.from_arrays(cols, ["kept_bytes", "n_bytes", "n_removed", "n_spans", "removed_spans"])

    rows = R.with_spans(docs, *repeated_spans(docs, width, k))
    return R.with_columns(docs, rows, cut("row.text", "spans"), ("kept_bytes", "n_bytes", "n_removed", "n_spans", "removed_spans"))


def brute_force(texts: list[tuple[int | None, str | None]], width: int = 50) -> list[tuple[bytes, int]]:
    """Kept bytes and number of removed runs of each row, by comparing all windows; for tests."""
    least: dict[bytes, int] = {}
    rows = [(R.NO_ID if i is None else i, (t or "").encode()) for i, t in texts]
    for i, b in rows:
        for s in range(len(b) - width + 1):
            w = b[s : s + width]
            least[w] = min(least.get(w, i), i)
    out = []
    for i, b in rows:
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - width + 1):
            if least[b[s : s + width]] < i:
                gone[s : s + width] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((kept, int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())))
    return out
