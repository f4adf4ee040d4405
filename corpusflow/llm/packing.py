"""Packing of tokenized documents by hierarchical residual best fit.

Texts are tokenized by a file of a public tokenizer, closed by an end token and cut into pieces of ``size`` tokens where
they are longer; only the first piece of a document may be shorter.  Full pieces are sequences of their own.  The others
are dealt over partitions that pack them by best fit, longest first; sequences that are nearly full are final, and the
underfull ones travel up a tree as items, each level packing them again with a ``fan_in``-th of the partitions.  Of two
underfull sequences of at most half the size one would have taken the other, so each partition sends up at most one of
those, and besides them only as many larger ones as those could go to (``open_bins`` at most a partition; the rest are
final as they are): what meets at the top does not grow with the corpus.

Null texts are empty and give one piece, the end token.  Repeated rows are packed each.  An empty table gives an empty one.
Other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import json
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import materialize, partitions, text_batches

PIECES = "doc_id bigint, row bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


@functools.lru_cache(2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` tokens; the first may be shorter."""
    first = n % size or min(n, size)
    return [(0, first), *((s, size) for s in range(first, n, size))]


def pieces(docs: DataFrame, tokenizer_path: str, size: int = 1024, end_id: int = 2) -> DataFrame:
    """A row for each piece, with the checksum of its ids."""

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = fast_encode(tokenizer_path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = id_bytes(encode(text or "")) + end_id.to_bytes(4, "little")
                for k, (start, length) in enumerate(cut(len(ids) // 4, size)):
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(tokenize, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def fast_encode(path: str):
    """``encode(text) -> ids``: for a plain byte-level BPE file by tiktoken over the file's own vocabulary (the same ids), else by tokenizers."""
    t = tokenizer(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not spec.get("normalizer"):
        import tiktoken

        # fixed rule of byte-level BPE: printable bytes are themselves, the others come from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        special = {x["content"] for x in spec.get("added_tokens", [])}
        ranks = {bytes(byte[c] for c in w): i for w, i in model["vocab"].items() if w not in special}
        fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        probe = "It's 12 tests,  of\n\nthe öäé ©2² end.\t"
        if fast(probe) == t.encode(probe, add_special_tokens=False).ids:
            return fast
    return lambda text: t.encode(text, add_special_tokens=False).ids


#: Fixed value: the split of byte-level BPE.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def id_bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def best_fit(lengths: np.ndarray, size: int) -> np.ndarray:
    """Bin number of each item: longest first, each into the fullest bin that takes it."""
    bins = np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(size + 1)]  # room -> bins
    rooms: list[int] = []  # sorted rooms that have bins
    n = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        k = bisect.bisect_left(rooms, length)
        if k == len(rooms):
            b, room = n, size
            n += 1
        else:
            room = rooms[k]
            b = by_room[room].pop()
            if not by_room[room]:
                del rooms[k]
        bins[i] = b
        left = room - length
        if left > 0:
            if not by_room[left]:
                bisect.insort(rooms, left)
            by_room[left].append(b)
    return bins


def pack(items: DataFrame, size: int = 1024, fan_in: int = 8, nearly_full: int = 8, open_bins: int = 256, per_partition: int = 4000) -> DataFrame:
    """Pieces (each with a ``row`` number of its own) with ``sequence_id``, the row number of its first piece, and ``offset``; ``nearly_full``
    tokens of room make a sequence final."""
    spark = items.sparkSession
    full = items.where(F.col("length") >= size)
    short = items.where(F.col("length") < size)
    n = short.count()
    parts = max(1, -(-n // per_partition))

    def level(last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = [b for b in batches if b.num_rows]
            if not tables:
                return
            t = pa.Table.from_batches(tables).combine_chunks()
            key, length = t["key"].combine_chunks(), t["length"].to_numpy()
            bins = best_fit(length, size)
            order = np.argsort(bins, kind="stable")
            sizes = np.bincount(bins, weights=length).astype(np.int64)
            first = np.searchsorted(bins[order], bins[order])
            total = np.cumsum(length[order]) - length[order]
            offset = total - total[first]
            name = np.array(key.to_pylist(), object)
            # a sequence has the name of its first item
            head = name[order][first]
            small = np.flatnonzero(sizes * 2 <= size)
            room = size - sizes
            up = np.zeros(len(sizes), bool)
            if not last:
                wide = np.argsort(sizes, kind="stable")[:open_bins]
                up[wide[room[wide] > nearly_full]] = True
                up[small[:open_bins]] = True
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(name[order])), pa.array(list(head)), pa.array(offset), pa.array(sizes[bins[order]]), pa.array(up[bins[order]])],
                ["key", "bin", "offset", "length", "up"],
            )

        return run

    # the items of a level: their name and length; where each went is kept for the way back
    item = short.select(F.concat_ws(":", "doc_id", "piece", "row").alias("key"), F.col("length"))
    levels = []
    while True:
        last = parts == 1
        dealt = item.repartition(parts, F.xxhash64("key", F.lit(len(levels)))) if parts > 1 else item.coalesce(1)
        went = materialize(dealt.mapInArrow(level(last), "key string, bin string, offset bigint, length bigint, up boolean"), f"pack{len(levels)}")
        levels.append(went)
        if last:
            break
        item = went.where("up").groupBy(F.col("bin").alias("key")).agg(F.max("length").alias("length"))
        parts = -(-parts // fan_in)
    placed = levels[-1].select("key", "bin", F.col("offset").alias("at"))
    for went in reversed(levels[:-1]):
        above = placed.select(F.col("key").alias("_key"), F.col("bin").alias("_bin"), "at")
        placed = went.join(above, F.col("bin") == F.col("_key"), "left").select("key", F.coalesce("_bin", "bin").alias("bin"), (F.coalesce("at", F.lit(0)) + F.col("offset")).alias("at"))
    out = short.withColumn("key", F.concat_ws(":", "doc_id", "piece", "row")).join(placed, "key")
    columns = [c for c in items.columns if c != "row"]
    return out.select(*columns, F.substring_index("bin", ":", -1).cast("long").alias("sequence_id"), F.col("at").cast("long").alias("offset")).unionByName(
        full.select(*columns, F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = 1024, end_id: int = 2, **kw) -> DataFrame:
    """Tokenize once, number the rows (so that repeated ids stay apart), and pack."""
    text_batches(docs.sparkSession)
    cut_up = pieces(docs, tokenizer_path, size, end_id).withColumn("row", F.monotonically_increasing_id())
    return pack(materialize(cut_up, "pieces"), size, **kw)
