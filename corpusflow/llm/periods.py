"""Periodic runs of words: stretches that repeat themselves with a smallest period, found by suffix trees.

In a stretch of words, Ukkonen's suffix trees of the words and of their reversal answer in constant time how far two places
agree to the right and to the left: the string depth of the lowest common ancestor of two leaves is the minimum of the tour of
the tree between them, read from a sparse table.  The order of the leaves gives the longest Lyndon word that starts at each
place, under the order of the words and under its inverse; each run holds one of these as its root.  All candidates (a place and
the length of its Lyndon word) are extended in both directions at once in NumPy.

Only stretches that can hold a run are given to the trees: the words of a run of at least ``LEAST`` words and three periods
are all covered by sequences of ``LEAST - LEAST // 3`` words that occur again in the run.  Words that no such repeated sequence of
their stretch covers are cut away until nothing changes; sequences are compared by 64-bit hashes here, which can only keep more.
The trees work on the words themselves.  A task holds one batch of texts, and for the repetitive stretch at hand about 500 bytes a word.

Words are what ASCII white space parts; null texts have none.  Rows are judged one by one, so repeated rows give equal
results and an empty table an empty one; other columns are kept, those of added names replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._store import text_batches

#: Fewest words and fewest periods of a run.
LEAST, PERIODS = 24, 3
#: Words of the sequences that recur in any run: a run of period q has max(24, 3q) - q >= 16 places that equal those q further on.
GRAM = LEAST - LEAST // PERIODS
Run = tuple[int, int, int]


def suffix_tree(s: list[int], symbols: int) -> tuple[list[int], list[int], dict[int, int]]:
    """Ukkonen's tree of ``s``, whose last symbol occurs nowhere else: where each node's edge label starts and ends in ``s``, and
    the child of ``node * symbols + symbol``; node 0 is the root, leaves' labels end at ``len(s)``."""
    n = len(s)
    start, end, link, child = [0], [0], [0], {}
    node = edge = length = todo = 0
    for i, c in enumerate(s):
        todo += 1
        inner = -1
        while todo:
            if not length:
                edge = i
            key = node * symbols + s[edge]
            below = child.get(key)
            if below is None:
                child[key] = len(start)
                start.append(i)
                end.append(n)
                link.append(0)
                if inner >= 0:
                    link[inner] = node
                    inner = -1
            else:
                first = start[below]
                size = end[below] - first
                if length >= size:
                    node = below
                    length -= size
                    edge += size
                    continue
                if s[first + length] == c:
                    length += 1
                    if inner >= 0:
                        link[inner] = node
                    break
                split = len(start)
                start += (first, i)
                end += (first + length, n)
                link += (0, 0)
                child[key] = split
                child[split * symbols + c] = split + 1
                child[split * symbols + s[first + length]] = below
                start[below] = first + length
                if inner >= 0:
                    link[inner] = split
                inner = split
            todo -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - todo + 1
    return start, end, child


class Extensions:
    """How far any two places of a sequence agree to the right."""

    def __init__(self, codes: list[int], symbols: int):
        """``codes`` are below ``symbols - 1`` and not negative; 0 is for the end."""
        self.n = n = len(codes)
        start, end, child = suffix_tree([*(c + 1 for c in codes), 0], symbols)
        keys = np.fromiter(child.keys(), np.int64, len(child))
        order = np.argsort(keys)
        kids = np.fromiter(child.values(), np.int64, len(child))[order]
        first = np.searchsorted(keys[order] // symbols, np.arange(len(start) + 1)).tolist()
        kids = kids.tolist()
        # the tour: for each node in order of its first visit, the depth to which the tour came back before it went there
        tour, place = [0], [0] * (n + 1)
        stack = [(kids[k], 0) for k in range(first[1] - 1, first[0] - 1, -1)]
        while stack:
            v, depth = stack.pop()
            own = depth + end[v] - start[v]
            a, b = first[v], first[v + 1]
            if a == b:
                place[n + 1 - own] = len(tour)
            tour.append(depth)
            while b > a:
                b -= 1
                stack.append((kids[b], own))
        #: The visit of each suffix's leaf; the order of the visits is the order of the suffixes.
        self.place = np.array(place, np.int64)
        self.table = [np.array(tour, np.int32)]
        while 2 << (len(self.table) - 1) <= len(tour):
            half, last = 1 << (len(self.table) - 1), self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of pairs of different places, up to ``n``."""
        a, b = self.place[a], self.place[b]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            t = self.table[k]
            out[at] = np.minimum(t[low[at]], t[high[at] - (1 << k)])
        return out


def next_smaller(values: list[int]) -> np.ndarray:
    """The next place of a smaller value; ``len(values)`` where none is."""
    out, stack = [len(values)] * len(values), []
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            out[stack.pop()] = i
        stack.append(i)
    return np.array(out, np.int64)


def runs_of(words: list[bytes], least: int = LEAST, periods: int = PERIODS) -> list[Run]:
    """Start, length and period of all runs, by start, then period."""
    n = len(words)
    if n < least:
        return []
    numbers: dict[bytes, int] = {}
    codes = [numbers.setdefault(w, len(numbers)) for w in words]
    right = Extensions(codes, len(numbers) + 1)
    left = Extensions(codes[::-1], len(numbers) + 1)
    order = right.place[:n]
    found = []
    for rank in (order, -order):
        i = np.arange(n)
        p = next_smaller(rank.tolist()) - i
        i, p = i[i + p < n], p[i + p < n]
        forth, back = right(i, i + p), np.zeros(len(i), np.int64)
        inside = i > 0
        back[inside] = left(n - i[inside], n - i[inside] - p[inside])
        start, length = i - back, back + p + forth
        good = length >= np.maximum(least, periods * p)
        found.append(np.stack([start[good], length[good], p[good]], axis=1))
    return sorted({tuple(r) for r in np.concatenate(found).tolist()}, key=lambda r: (r[0], r[2]))


def stretches(gram: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of words (start, end) that may hold runs, from the hashes of a document's sequences of ``GRAM`` words."""
    out, todo = [], [(0, len(gram) + GRAM - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < LEAST:
            continue
        own = gram[a : b - GRAM + 1]
        s = np.sort(own)
        twice = s[1:][s[1:] == s[:-1]]
        if not len(twice):
            continue
        at = np.flatnonzero(np.isin(own, twice)) + a
        cut = np.flatnonzero(at[1:] > at[:-1] + GRAM)
        parts = list(zip(at[np.r_[0, cut + 1]].tolist(), (at[np.r_[cut, len(at) - 1]] + GRAM).tolist(), strict=True))
        if parts == [(a, b)]:
            out.append((a, b))
        else:
            todo += parts
    return sorted(out)


def repeated(gram: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Documents in which a sequence occurs twice at least."""
    key = T.mix(gram ^ T.mix(owner.astype(T.U64) + T.U64(1)))
    s = np.sort(key)
    twice = s[1:][s[1:] == s[:-1]]
    return np.unique(owner[np.isin(key, twice)]) if len(twice) else np.zeros(0, np.int64)


def runs_of_texts(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, list[Run]]]:
    """Number and runs of each text that has any."""
    for i, j in T.runs(off):
        own = data[off[i] : off[j]]
        begin, end, first = T.words(own, off[i : j + 1] - off[i], T.SPACE)
        codes = T.span_hashes(own, begin, end, T.CODE)
        parts = [T.rolling(codes[s : s + T.SEGMENT + GRAM - 1], GRAM) for s in range(0, max(len(codes) - GRAM + 1, 0), T.SEGMENT)]
        if not parts:
            continue
        gram = np.concatenate(parts)
        owner = np.repeat(np.arange(j - i), np.diff(first))[: len(gram)]
        whole = np.arange(len(gram)) + GRAM <= first[owner + 1]
        for d in repeated(gram[whole], owner[whole]).tolist():
            a, b = int(first[d]), int(first[d + 1])
            found = []
            for x, y in stretches(gram[a : b - GRAM + 1]):
                words = [own[s:e].tobytes() for s, e in zip(begin[a + x : a + y].tolist(), end[a + x : a + y].tolist(), strict=True)]
                found += [(s + x, length, p) for s, length, p in runs_of(words)]
            if found:
                yield i + d, found


def collapse(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """Words without those that a run holds after its first period."""
    gone = bytearray(len(words))
    for s, n, p in runs:
        gone[s + p : s + n] = b"\x01" * (n - p)
    return [w for w, g in zip(words, gone, strict=True) if not g]


def greatest(runs: list[Run]) -> Run | None:
    """The run of greatest length over period; of equal ones the first, then the one of least period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


NAMES = ("runs", "n_runs", "start", "length", "period", "exponent_milli", "n_words", "n_dropped", "collapsed_text")
KIND = "struct<runs:array<struct<start:bigint,length:bigint,period:bigint>>,n_runs:bigint,start:bigint,length:bigint,period:bigint,exponent_milli:bigint,n_words:bigint,n_dropped:bigint,collapsed_text:string>"


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with all ``runs`` (by start, then period), their number, the ``start, length, period, exponent_milli`` of the greatest
    (null if none), ``n_words``, ``n_dropped`` and ``collapsed_text``, in which each run keeps its first period."""
    text_batches(docs.sparkSession)
    run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    @F.arrow_udf(KIND)
    def judge(batch: pa.Array) -> pa.Array:
        data, off = T.column(batch)
        found = dict(runs_of_texts(data, off))
        raw, out = data.tobytes(), []
        for d, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
            words, runs = raw[a:b].split(), found.get(d, [])  # bytes split at ASCII white space only
            n, top = len(words), greatest(runs)
            kept = collapse(words, runs) if runs else words
            rest = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
            out.append(([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], len(runs), *rest, n, n - len(kept), b" ".join(kept).decode()))
        columns = list(zip(*out, strict=True)) or [()] * len(NAMES)
        kinds = [run, *[pa.int64()] * 7, pa.string()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(NAMES))

    rows = docs.select(F.struct(*docs.columns).alias("row"), judge(F.col(text)).alias("found"))
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in NAMES]
    return rows.select(*own, *[F.col("found").getField(c).alias(c) for c in NAMES])


def brute_force(words: list[str], least: int = LEAST, periods: int = PERIODS) -> list[Run]:
    """All runs by trying each period; for tests."""
    n, out = len(words), []
    for p in range(1, n // periods + 1):
        same = [words[k] == words[k + p] for k in range(n - p)]
        i = 0
        while i < n - p:
            j = next((k for k in range(i, n - p) if not same[k]), n - p)
            size = j - i + p
            if j > i and size >= max(least, periods * p) and not any(all(words[k] == words[k + q] for k in range(i, j + p - q)) for q in range(1, p)):
                out.append((i, size, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))
