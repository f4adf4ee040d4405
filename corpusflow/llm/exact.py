"""Exact duplicates by a minimal perfect hash over the digests of a history.

``build_index`` makes, for each shard of the history's distinct SHA-256 digests, a minimal perfect hash: levels of bit arrays
in which a key that meets no other is settled, and whose set bits before a key's own are its slot.  A slot holds the full digest,
the locator of the winner (the largest id of that text) and the number of rows.  A lookup computes the slot and compares all
32 bytes: a perfect hash sends strangers to slots too.  Digests that are found join the group of the slot, the others are grouped
by themselves.  Rows of one task are summed before they are exchanged, so a text that a third of the rows share crosses the
exchange once a task; each shard holds about ``EACH`` digests, whatever the size of the history.

Texts are equal if all bytes are; a null text is an empty one.  The row of the largest id stays, a null id stands below all
others; rows of one text and one id are one document and share its fate.  An empty table or an empty history is fine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import materialize, small_side
from ._text import U64, mix

#: Digests of a shard, on average.
EACH = 1 << 16
#: Bits of a level for each key that is left.
GAMMA = 2
#: Keys that are left after so many levels are listed; their number is about ``EACH * 0.4**LEVELS``.
LEVELS = 24
WIDTH = 32
NONE = np.iinfo(np.int64).min
GROUPS = "digest binary, keep_id bigint, group_size bigint, known boolean"


def digest_of(text: str | Column = "text") -> Column:
    """The 32 bytes of the text's SHA-256."""
    return F.unhex(F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256))


def spot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """The bit of each digest (a row of four 64-bit numbers) on a level of ``size`` bits."""
    seed = mix(np.array([level + 1], U64))[0]
    return (mix(mix(keys[:, 1] ^ seed) ^ keys[:, 2]) % U64(size)).astype(np.int64)


def perfect_hash(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The levels' bits, and the digests that no level settles."""
    levels = []
    for level in range(LEVELS):
        if not len(keys):
            break
        size = max(64, GAMMA * len(keys))
        at = spot(keys, level, size)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        keys = keys[~alone[at]]
    return levels, keys[np.lexsort(keys.T[::-1])]


def slots(keys: np.ndarray, levels: list[np.ndarray], rest: np.ndarray) -> np.ndarray:
    """The slot of each digest: for members all different and below their number; for others any, or -1."""
    out, left, before = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, bits in enumerate(levels):
        at = spot(keys[left], level, len(bits))
        hit = bits[at]
        rank = np.cumsum(bits)
        out[left[hit]] = before + rank[at[hit]] - 1
        before += int(rank[-1])
        left = left[~hit]
    listed = {k.tobytes(): before + i for i, k in enumerate(rest)}
    if listed:
        for i in left.tolist():
            out[i] = listed.get(keys[i].tobytes(), -1)
    return out


def keys_of(column: pa.ChunkedArray) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, U64).reshape(-1, WIDTH // 8)


def winners_of(column: pa.ChunkedArray) -> np.ndarray:
    """Locators; ``NONE`` where all ids are null."""
    return column.fill_null(NONE).to_numpy().astype(np.int64)


def summed(rows: DataFrame, id_col: str) -> DataFrame:
    """One row for each digest: the largest id and the number of rows."""
    return rows.groupBy("digest").agg(F.max(F.col(id_col).cast("long")).alias("winner"), F.count(F.lit(1)).alias("n"))


def _pack(levels: list[np.ndarray]) -> tuple[list[int], bytes]:
    return [len(x) for x in levels], b"".join(np.packbits(x).tobytes() for x in levels)


def _unpack(sizes: list[int], blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    for n in sizes:
        step = -(-n // 8)
        out.append(np.unpackbits(np.frombuffer(blob, np.uint8, step, at), count=n).astype(bool))
        at += step
    return out


INDEX = "shard int, shards int, sizes array<int>, bits binary, rest binary, digests binary, winners binary, counts binary"


def index_of(history: DataFrame, each: int = EACH) -> DataFrame:
    """The index over ``digest, winner, n`` (distinct digests): a row a shard."""
    shards = max(1, -(-history.count() // each))

    def build(rows: pa.Table) -> pa.Table:
        keys = keys_of(rows["digest"])
        levels, rest = perfect_hash(keys)
        at = slots(keys, levels, rest)
        order = np.empty(len(keys), np.int64)
        order[at] = np.arange(len(keys))
        sizes, bits = _pack(levels)
        columns = keys[order], winners_of(rows["winner"])[order], rows["n"].to_numpy().astype(np.int64)[order]
        one = [rows["shard"][0].as_py(), shards, sizes, bits, rest.tobytes(), *(c.tobytes() for c in columns)]
        types = [pa.int32(), pa.int32(), pa.list_(pa.int32()), *[pa.binary()] * 5]
        return pa.table([pa.array([v], t) for v, t in zip(one, types, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])

    return history.select(shard_of("digest", shards), "digest", "winner", "n").groupBy("shard").applyInArrow(build, INDEX)


def shard_of(digest: str, shards: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(shards)).cast("int").alias("shard")


def build_index(history: DataFrame, text: str = "text", id_col: str = "doc_id", each: int = EACH) -> DataFrame:
    """The index of a table of documents, written to the shared folder; a caller may keep it as a table of its own."""
    rows = materialize(summed(history.select(digest_of(text).alias("digest"), F.col(id_col).alias("_winner")), "_winner"), "history")
    return materialize(index_of(rows, each), "digest_index")


def look_up(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Groups of ``digest, winner, n`` (distinct digests) with those of the index: digest, keep_id, group_size, known (to the history)."""
    first = index.select("shards").first()
    shards = first[0] if first else max(1, -(-rows.count() // EACH))

    def meet(held: pa.Table, new: pa.Table) -> pa.Table:
        keys, winners, counts = keys_of(new["digest"]), winners_of(new["winner"]), new["n"].to_numpy().astype(np.int64)
        stranger, old = np.ones(len(keys), bool), []
        if held.num_rows:
            one = held.to_pylist()[0]
            own = np.frombuffer(one["digests"], U64).reshape(-1, WIDTH // 8)
            top, n = np.frombuffer(one["winners"], np.int64).copy(), np.frombuffer(one["counts"], np.int64).copy()
            at = slots(keys, _unpack(one["sizes"], one["bits"]), np.frombuffer(one["rest"], U64).reshape(-1, WIDTH // 8))
            stranger = (at < 0) | (own[at] != keys).any(axis=1)
            at = at[~stranger]
            top[at] = np.maximum(top[at], winners[~stranger])
            n[at] += counts[~stranger]
            old = [(own, top, n, True)]
        return pa.concat_tables(_rows(*x) for x in [*old, (keys[stranger], winners[stranger], counts[stranger], False)])

    new = rows.select(shard_of("digest", shards), "digest", "winner", "n")
    return index.groupBy("shard").cogroup(new.groupBy("shard")).applyInArrow(meet, GROUPS)


def _rows(keys: np.ndarray, winners: np.ndarray, counts: np.ndarray, known: bool) -> pa.Table:
    digests = pa.Array.from_buffers(pa.binary(WIDTH), len(keys), [None, pa.py_buffer(np.ascontiguousarray(keys).tobytes())]).cast(pa.binary())
    return pa.table([digests, pa.array(winners, mask=winners == NONE), pa.array(counts), pa.array(np.full(len(keys), known))], names=["digest", "keep_id", "group_size", "known"])


def mark(docs: DataFrame, old: Column | None = None, index: DataFrame | None = None, text: str = "text", id_col: str = "doc_id", each: int = EACH) -> DataFrame:
    """One row for each row of ``docs``: the id, keep_id, group_size, kept, known and text_sha256.

    The history is ``index``, or the rows of ``docs`` that satisfy ``old`` (none: no history).  keep_id may be the id of a row of
    the history; where an ``index`` is given, the rows of its table are counted in group_size.
    """
    flag = F.coalesce(old, F.lit(False)) if old is not None else F.lit(False)
    rows = materialize(docs.select(F.col(id_col).cast("long").alias("id"), digest_of(text).alias("digest"), flag.alias("old")), "digests")
    if index is None:
        index = materialize(index_of(materialize(summed(rows.where("old"), "id"), "history"), each), "digest_index")
    groups = materialize(look_up(summed(rows.where("not old"), "id"), index), "groups")
    # a text that stands alone needs no partner: only groups of several rows are joined
    several = small_side(groups.where("group_size > 1"))
    alone = F.col("group_size").isNull()
    return rows.join(several, "digest", "left").select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.coalesce("known", F.col("old")).alias("known"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def remove(docs: DataFrame, old: Column | None = None, index: DataFrame | None = None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    gone = mark(docs, old, index, text, id_col).where("not kept").select(F.col(id_col).alias("_gone_id"), F.unhex("text_sha256").alias("_gone_digest")).distinct()
    here = docs.select(F.struct(*docs.columns).alias("row"))
    same = F.col(f"row.{id_col}").cast("long").eqNullSafe(F.col("_gone_id")) & (digest_of(F.col(f"row.{text}")) == F.col("_gone_digest"))
    return here.join(small_side(gone), same, "left_anti").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def middle(docs: DataFrame, id_col: str = "doc_id") -> Column:
    """Whether a row's id lies in the lower half of the range of ids: what a corpus held before its last load, where ids grow."""
    low, high = docs.agg(F.min(id_col), F.max(id_col)).first()
    return F.lit(False) if low is None else F.col(id_col) <= (low + high) // 2


def brute_force(rows: Iterator[tuple[int | None, str | None]]) -> list[tuple[int | None, int, bool]]:
    """keep_id, group_size and kept of each row; for tests."""
    rows = [(i, t or "") for i, t in rows]
    groups: dict[str, list[int | None]] = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    top = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return [(top[t], len(groups[t]), i == top[t]) for i, t in rows]
