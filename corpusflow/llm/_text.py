"""Vectorised words, n-gram hashes and anchors over Arrow string columns.

A rolling sum ``sum(code[b_j] * BASE**j)`` modulo 2**64, divided by ``BASE**start`` (BASE is odd, hence invertible),
gives the hash of any span from two look-ups, so no Python statement runs per word.  Hashes are 64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_rng = np.random.default_rng(20240601)
#: One random odd code for each byte value.
CODE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
BASE = 0x9E3779B97F4A7C15 | 1
WORD_BASE = 0xC2B2AE3D27D4EB4F | 1
#: Texts are handled in runs of about this many bytes.
RUN_BYTES = 1 << 20
#: A text longer than that is hashed in segments.
SEGMENT = 1 << 22


def _table(base: int) -> list[np.ndarray]:
    return [np.ones(1, U64), np.ones(1, U64), np.array([base, pow(base, -1, 2**64)], dtype=U64)]


_POWERS = {BASE: _table(BASE), WORD_BASE: _table(WORD_BASE)}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**j`` and ``base**-j`` for j < n at least."""
    up, down, steps = _POWERS[base]
    if len(up) < n:
        n = max(n + n // 4, 1 << 16)
        up, down = (np.cumprod(np.concatenate([np.ones(1, U64), np.full(n - 1, s, U64)]), dtype=U64) for s in steps)
        _POWERS[base][:2] = [up, down]
    return up, down


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def separators(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


#: The white space of ``[^\x20\x09-\x0D]+``.
SPACE = separators(b" \t\n\x0b\x0c\r")
#: Other codes, for a second hash that is independent of the first.
CODE2 = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
#: Codes under which A-Z equal a-z.
LOWER_CODE = CODE.copy()
LOWER_CODE[65:91] = CODE[97:123]


def column(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is an empty text."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    _, off, data = arr.buffers()
    off = np.frombuffer(off, np.int64)[arr.offset : arr.offset + len(arr) + 1] if off is not None and len(arr) else np.zeros(len(arr) + 1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def runs(off: np.ndarray, most: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents that hold about ``most`` bytes together."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, off: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the index of the first word of each document (with one entry more)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~sep[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edge = off[(off > 0) & (off < n)]
    before[edge], after[edge - 1] = False, False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, off)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, code: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes; spans are in order and apart."""
    if len(data) > SEGMENT and len(start) > 1:
        cut = np.unique(np.searchsorted(start, np.arange(0, len(data), SEGMENT // 2)))
        cut = [*cut[cut < len(start)].tolist(), len(start)]
        return np.concatenate([span_hashes(data[start[i] : end[j - 1]], start[i:j] - start[i], end[i:j] - start[i], code) if j - i < len(start) else _spans(data, start, end, code) for i, j in zip(cut, cut[1:], strict=False)])
    return _spans(data, start, end, code)


def _spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, code: np.ndarray) -> np.ndarray:
    up, down = powers(BASE, len(data) + 1)
    total = np.empty(len(data) + 1, U64)
    total[0] = 0
    np.cumsum(code[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U64))


def span_hashes_apart(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes; spans are in order of their starts and may overlap, and are short against a segment."""
    if len(data) <= 2 * SEGMENT:
        return _spans(data, start, end, CODE)
    cut = [*np.unique(np.searchsorted(start, np.arange(0, len(data), SEGMENT))).tolist(), len(start)]
    return np.concatenate([np.zeros(0, U64), *(_spans(data[start[i] : end[i:j].max()], start[i:j] - start[i], end[i:j] - start[i], CODE) for i, j in zip(cut, cut[1:], strict=False) if j > i)])


def rolling(items: np.ndarray, k: int) -> np.ndarray:
    """Hash of ``items[i:i+k]`` for each i, of at most a segment of items; callers mask those that cross documents."""
    n = len(items)
    if n < k:
        return np.zeros(0, U64)
    up, down = powers(WORD_BASE, n + 1)
    total = np.empty(n + 1, U64)
    total[0] = 0
    np.cumsum(items * up[:n], out=total[1:])
    return mix((total[k:] - total[: n - k + 1]) * down[: n - k + 1] + U64(k))


def sliding_min(keys: np.ndarray, w: int) -> np.ndarray:
    """``min(keys[i:i+w])`` for each i, by doubling."""
    out, have = keys, 1
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = w - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


IDX_BITS = 24


def anchors(gram: np.ndarray, width: int, k: int) -> np.ndarray:
    """For each window of ``width`` items, the position of its least k-gram (the leftmost of equals).

    ``gram`` holds the k-gram hashes of one run of items.  The choice depends on what stands in the window alone, so
    equal windows choose the same place in themselves.
    """
    w = width - k + 1
    if len(gram) < w:
        return np.zeros(0, np.int64)
    low = U64((1 << IDX_BITS) - 1)
    keys = (gram & ~low) | np.arange(len(gram), dtype=U64)
    return (sliding_min(keys, w) & low).astype(np.int64)


def ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and place in the row of each of ``sum(lengths)`` cells."""
    total = int(lengths.sum())
    row = np.repeat(np.arange(len(lengths)), lengths)
    first = np.cumsum(lengths) - lengths
    return row, np.arange(total) - first[row]
