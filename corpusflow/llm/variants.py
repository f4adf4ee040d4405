"""Spelling variants by bidirectional search in FM-indexes of a delimited vocabulary.

A word of at most one edit keeps one of its halves.  The first search matches the first half exactly and extends to the right over
the second allowing one inserted, deleted or replaced code point; the second matches the second half exactly and extends to the
left over the first.  Both go from a delimiter to the next one, so each needs one direction of the bidirectional index alone: the
FM-index of the reversed text, whose suffix-rank intervals grow to the right, or that of the text, whose intervals grow to the left.
All queries of a shard step together in NumPy, each with its interval.

Each direction has its own shards: ranges of the vocabulary sorted from the exact end, of about ``EACH`` words each, so that no
common beginning or ending grows hot; a word that begins (or ends) like words of several shards is sent to all of these.
Bounds of the ranges come from the ``SAMPLE * shards`` words of least hash; all words are indexed and all are asked.  The
second search reports only what the first doesn't: words that don't share the first half.  A shard's answer is one row a word.

Words are runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lower-cased, counted over all documents; null texts have none.  Equal counts go to the
word that is smaller in code-point order.  Repeated rows count as often as they stand; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import materialize, partitions, small_side

#: Words of a shard, on average, and of the sample a shard.
EACH = 1 << 15
SAMPLE = 32
#: Words whose searches step together.
BLOCK = 1 << 12
#: An interval of at most so many ranks is read itself; a wider one is asked for each symbol.
NARROW = 64
#: Times that a word's form is more frequent than the word.
FACTOR = 5
RUN = r"[A-Za-zÀ-ÿ]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def noise(id_col: Column, word: Column, every: int = 199) -> Column:
    """The word, without one code point where ``every`` divides the CRC-32 of ``<id>:<word>``: its (remainder by length)-th. A null id is empty."""
    h = F.crc32(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), word))
    at = (h % F.char_length(word)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))).otherwise(word)


def vocabulary(docs: DataFrame, text: str = "text", id_col: str = "doc_id", every: int | None = None, shortest: int = 6, fewest: int = 5) -> DataFrame:
    """``word, n`` of all words of at least ``shortest`` code points and ``fewest`` occurrences; ``every``: see ``noise``."""
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    # most runs have no capitals to look for one by one: letters of one byte are lower-cased at once
    small = F.when(F.octet_length("run") == F.char_length("run"), F.lower("run")).otherwise(F.translate("run", CAPITALS, SMALL))
    words = runs.select("id", small.alias("run"))
    word = noise(F.col("id"), F.col("run"), every) if every else F.col("run")
    return words.select(word.alias("word")).where(F.char_length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= fewest)


def flat(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words and where each begins, with one entry more."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return codes, np.r_[0, np.cumsum([len(w) for w in words], dtype=np.int64)]


def spread(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of each of ``size`` cells from ``start`` on."""
    row = np.repeat(np.arange(len(size)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + start[row]


class FMIndex:
    """Suffix ranks of words between delimiters; intervals grow to the left, by one symbol at a time."""

    def __init__(self, codes: np.ndarray, at: np.ndarray):
        """``codes`` hold symbols from 1 on of all words, which are distinct; word ``i`` is ``codes[at[i]:at[i + 1]]``."""
        n, total = len(at) - 1, len(codes) + len(at) - 1
        sizes = np.diff(at)
        row, place = spread(at[:-1] + np.arange(n), sizes)
        text = np.zeros(total, np.int64)  # each word and the delimiter behind it
        text[place] = codes
        word = np.repeat(np.arange(n), sizes + 1)
        # ranks of suffixes by doubling; delimiters differ, by the number of their words
        rank = np.where(text == 0, word, n + text)
        step = 1
        while True:
            behind = np.full(total, -1, np.int64)
            behind[: total - step] = rank[step:]
            order = np.lexsort((behind, rank))
            a, b = rank[order], behind[order]
            new = np.r_[0, np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))]
            rank = np.empty(total, np.int64)
            rank[order] = new
            if new[-1] == total - 1:
                break
            step *= 2
        before = np.where(order > 0, text[order - 1], 0)
        self.n, self.total, self.before = n, total, before
        #: The word that begins at a rank.
        self.word = word[order]
        #: Ranks in order of the symbol before them: the place of (symbol, rank) is the rank of the longer suffix.
        self.key = np.sort(before * (total + 1) + np.arange(total))
        self.symbols = np.unique(before)

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals with ``symbol`` before them; empty ones where ``low == high``."""
        base = symbol * (self.total + 1)
        return np.searchsorted(self.key, base + low), np.searchsorted(self.key, base + high)

    def children(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and symbol of all letters that stand before the ranks of each interval."""
        size = high - low
        near = np.flatnonzero(size <= NARROW)
        row, at = spread(low[near], size[near])
        most = int(self.symbols[-1]) + 1
        seen = np.unique(near[row] * most + self.before[at])
        far = np.flatnonzero(size > NARROW)
        letters = self.symbols[self.symbols > 0]
        r, c = np.repeat(far, len(letters)), np.tile(letters, len(far))
        a, b = self.extend(low[r], high[r], c)
        row, symbol = np.r_[seen // most, r[b > a]], np.r_[seen % most, c[b > a]]
        return row[symbol > 0], symbol[symbol > 0]

    def words_at(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and number of the word of each interval that a delimiter precedes: whole words."""
        a, b = self.extend(low, high, np.zeros(len(low), np.int64))
        row, at = spread(a, b - a)
        return row, self.word[self.key[at]]


def search(index: FMIndex, codes: np.ndarray, at: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, word) of words one edit away whose last ``exact`` symbols are those of the query; edits lie before these.

    Symbols that no word has are -1.
    """
    n = np.diff(at)
    low, high, left = np.zeros(len(n), np.int64), np.full(len(n), index.n, np.int64), n.copy()
    who = np.arange(len(n))
    todo = who[exact > 0]
    while len(todo):
        c = codes[at[todo] + left[todo] - 1]
        low[todo], high[todo] = index.extend(low[todo], high[todo], np.maximum(c, 0))
        high[todo[c < 0]] = low[todo[c < 0]]
        left[todo] -= 1
        todo = todo[(n[todo] - left[todo] < exact[todo]) & (high[todo] > low[todo])]
    q = who[high > low]
    low, high, left = low[q], high[q], left[q]
    found, none = [], np.zeros(0, np.int64)
    off = (none, none, none, none)  # states behind their edit: query, interval, symbols left
    while len(q) or len(off[0]):
        row, symbol = index.children(low, high)
        a, b = index.extend(low[row], high[row], symbol)
        next_symbol = np.where(left > 0, codes[np.maximum(at[q] + left - 1, 0)], -2)
        other = np.flatnonzero((left[row] > 0) & (symbol != next_symbol[row]))
        gone = np.flatnonzero(left > 0)
        grown = [(q[row], a, b, left[row]), (q[row[other]], a[other], b[other], left[row[other]] - 1), (q[gone], low[gone], high[gone], left[gone] - 1)]
        off = tuple(np.concatenate(x) for x in zip(off, *grown, strict=True))
        done = off[3] == 0
        r, w = index.words_at(off[1][done], off[2][done])
        found.append(np.stack([off[0][done][r], w]))
        off = _step(index, codes, at, *(x[~done] for x in off))
        q, low, high, left = _step(index, codes, at, *(x[left > 0] for x in (q, low, high, left)))
    pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    one = np.unique(pairs[0] * max(index.n, 1) + pairs[1])
    return one // max(index.n, 1), one % max(index.n, 1)


def _step(index: FMIndex, codes: np.ndarray, at: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, ...]:
    """States one symbol of their query further, without those that end."""
    c = codes[at[q] + left - 1]
    a, b = index.extend(low, high, np.maximum(c, 0))
    ok = (b > a) & (c >= 0)
    return q[ok], a[ok], b[ok], left[ok] - 1


def neighbours(items: list[str], queries: list[str], halves: np.ndarray, rightwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, item) one edit apart; ``halves`` is the length of each query's first half.

    ``rightwards``: the first half is exact. Else the second is, and pairs that share the first half are left out.
    """
    turn = (lambda words: [w[::-1] for w in words]) if rightwards else (lambda words: words)
    codes, at = flat(turn(items))
    symbols = np.unique(codes)
    index = FMIndex(np.searchsorted(symbols, codes) + 1, at)
    asked, place = flat(turn(queries))
    number = np.minimum(np.searchsorted(symbols, asked), len(symbols) - 1)
    number = np.where(symbols[number] == asked, number + 1, -1)
    sizes = np.diff(place)
    exact = halves if rightwards else sizes - halves
    found = []
    for i in range(0, len(queries), BLOCK):
        j = min(i + BLOCK, len(queries))
        q, w = search(index, number[place[i] : place[j]], place[i : j + 1] - place[i], exact[i:j])
        found.append(np.stack([q + i, w]))
    q, w = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    if not rightwards and len(q):
        # the first halves differ, or the word is shorter than it
        row, cell = spread(place[q], halves[q])
        mate = cell - place[q][row] + at[w][row]
        inside = mate < at[w + 1][row]
        unlike = ~inside | (codes[np.minimum(mate, len(codes) - 1)] != asked[cell])
        keep = np.zeros(len(q), bool)
        keep[row[unlike]] = True
        q, w = q[keep], w[keep]
    return q, w


ROW = "shard int, right boolean, item boolean, asks boolean, word string, n bigint"


def deal(words: DataFrame, shards: int, bounds: tuple[list[str], list[str]]) -> DataFrame:
    """Rows for both searches: a word in the shard of its place as an item, and in all shards whose words may share its half."""

    @F.arrow_udf("array<struct<shard:int,right:boolean,item:boolean,asks:boolean>>")
    def place(column: pa.Array) -> pa.Array:
        import bisect

        out = []
        for w in column.to_pylist():
            rows = []
            for right, cuts in zip((True, False), bounds, strict=True):
                own = w if right else w[::-1]
                half = own[: len(w) // 2 if right else len(w) - len(w) // 2]
                first, last, mine = bisect.bisect_right(cuts, half), bisect.bisect_right(cuts, half + "\U0010ffff"), bisect.bisect_right(cuts, own)
                rows += [{"shard": s + (0 if right else shards), "right": right, "item": s == mine, "asks": True} for s in range(first, last + 1)]
            out.append(rows)
        return pa.array(out, pa.list_(pa.struct([("shard", pa.int32()), ("right", pa.bool_()), ("item", pa.bool_()), ("asks", pa.bool_())])))

    return words.select(F.explode(place("word")).alias("at"), "word", "n").select("at.*", "word", "n")


def near(words: DataFrame, each: int = EACH) -> DataFrame:
    """For each of the distinct ``word, n`` that has any word at one edit: n_near, and the most frequent such word with its n."""
    spark = words.sparkSession
    shards = max(1, -(-words.count() // each))
    sample = [r.word for r in words.select("word").orderBy(F.xxhash64("word"), "word").limit(SAMPLE * shards).collect()] if shards > 1 else []  # bounded
    cut = lambda own: sorted(own)[SAMPLE // 2 :: SAMPLE][1:] if shards > 1 else []
    bounds = cut(sample), cut([w[::-1] for w in sample])

    def meet(rows: pa.Table) -> pa.Table:
        word, n, item = rows["word"].to_pylist(), rows["n"].to_numpy(), rows["item"].to_numpy()
        right = rows["right"][0].as_py()
        held = np.flatnonzero(item)
        if not len(held):
            return pa.table([pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64(), pa.string())], names=["word", "n_near", "form_n", "form"])
        halves = np.array([len(w) // 2 for w in word], np.int64)
        q, w = neighbours([word[i] for i in held.tolist()], word, halves, right)
        # the best of each query: largest count, then the smallest word
        of = held[w]
        rank = np.empty(len(word), np.int64)
        rank[sorted(range(len(word)), key=word.__getitem__)] = np.arange(len(word))
        order = np.lexsort((rank[of], -n[of], q))
        q, of = q[order], of[order]
        at = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
        count = np.diff(np.r_[at, len(q)])
        return pa.table([pa.array([word[i] for i in q[at].tolist()], pa.string()), pa.array(count.astype(np.int64)), pa.array(n[of[at]].astype(np.int64)), pa.array([word[i] for i in of[at].tolist()], pa.string())], names=["word", "n_near", "form_n", "form"])

    rows = deal(words, shards, bounds).repartition(max(partitions(spark), 2 * shards), "shard").groupBy("shard").applyInArrow(meet, "word string, n_near bigint, form_n bigint, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return rows.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``word, form`` (no nulls), by following forms to the last; counts grow along them, so they end.

    Each step doubles what is followed: a chain of ``FACTOR``-fold counts is short, so a few joins do.
    """
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = materialize(now.join(small_side(ahead), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def group(words: DataFrame, each: int = EACH, factor: int = FACTOR) -> DataFrame:
    """One row for each of the distinct ``word, n``: word, form, root, n, n_near, form_n.

    The form is the near word of largest n if that is at least ``factor`` times the word's own, else null; the root is the last
    form, the word itself where it has none.
    """
    words = materialize(words.select("word", F.col("n").cast("long").alias("n")), "words")
    best = materialize(near(words, each), "near")
    rows = words.join(best, "word", "left").withColumn("ok", F.col("form_n") >= factor * F.col("n"))
    rows = rows.select("word", F.when(F.col("ok"), F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("ok"), F.col("form_n")).alias("form_n"))
    rows = materialize(rows, "forms")
    last = roots(rows.where("form IS NOT NULL").select("word", "form"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def brute_force(counts: dict[str, int], factor: int = FACTOR) -> list[tuple]:
    """word, form, root, n, n_near, form_n by trying all edits; for tests."""
    letters = sorted({c for w in counts for c in w})

    def edits(w: str) -> set[str]:
        cut = [(w[:i], w[i:]) for i in range(len(w) + 1)]
        out = {a + b[1:] for a, b in cut if b} | {a + c + b[1:] for a, b in cut if b for c in letters} | {a + c + b for a, b in cut for c in letters}
        return (out - {w}) & counts.keys()

    found = {w: edits(w) for w in counts}
    form = {}
    for w, others in found.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= factor * counts[w] else None

    def root(w: str) -> str:
        while form[w] is not None:
            w = form[w]
        return w

    return [(w, form[w], root(w), n, len(found[w]), counts[form[w]] if form[w] else None) for w, n in counts.items()]
