"""Exact duplicates, spelling variants and periodic runs against brute force and on odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import _text, exact, periods, queries, variants

ROWS = [(3, "same"), (9, "same"), (None, "same"), (5, "Same"), (1, None), (2, ""), (None, None), (7, "x" * 70_000), (8, "x" * 70_000), (4, "once"), (6, "twice"), (6, "twice"), (None, "lonely"), (-5, "\0"), (11, "same ")]
SCHEMA = "doc_id long, text string, keep_id string, old int"


def docs_of(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "k", 1) for i, t in rows], SCHEMA)


def sha(t):
    return hashlib.sha256((t or "").encode()).hexdigest()


@pytest.mark.parametrize("old", [None, "doc_id % 2 = 0", "true", "false"])
def test_exact_marks_every_row(spark, old):
    got = exact.mark(docs_of(spark, ROWS).repartition(3), old=F.expr(old) if old else None, each=2).collect()
    want = [(i, k, n, kept, sha(t)) for (i, t), (k, n, kept) in zip(ROWS, exact.brute_force(ROWS), strict=True)]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)) for r in got)


def test_exact_history_is_a_table(spark):
    """Repeats of a history that was indexed before go, unless a new row has a larger id; strangers are grouped by themselves."""
    index = exact.build_index(docs_of(spark, [(100, "old"), (101, "old"), (1, "low"), (None, "null id")]), each=1)
    assert index.select(F.sum(F.length("digests") / 32)).first()[0] == 3
    new = [(5, "old"), (6, "low"), (7, "new"), (8, "new"), (None, "null id"), (9, "null id")]
    got = {(r.doc_id, r.text_sha256): (r.keep_id, r.group_size, r.kept, r.known) for r in exact.mark(docs_of(spark, new), index=index).collect()}
    assert got[5, sha("old")] == (101, 3, False, True) and got[6, sha("low")] == (6, 2, True, True)
    assert got[7, sha("new")] == (8, 2, False, False) and got[8, sha("new")] == (8, 2, True, False)
    assert got[None, sha("null id")] == (9, 3, False, True) and got[9, sha("null id")][2]


def test_exact_remove(spark):
    got = exact.remove(docs_of(spark, ROWS)).collect()
    keep = [r for r, (_, _, kept) in zip(ROWS, exact.brute_force(ROWS), strict=True) if kept]
    assert sorted(map(str, keep)) == sorted(str((r.doc_id, r.text)) for r in got) and got[0].keep_id == "k"


def test_exact_empty(spark):
    empty = docs_of(spark, [])
    assert exact.mark(empty, old=exact.middle(empty)).count() == 0 and exact.remove(empty).count() == 0
    assert exact.mark(docs_of(spark, [(1, "a")]), index=exact.build_index(empty)).first().kept


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 30_000])
def test_perfect_hash(n):
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(2 * n)]
    keys = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 4)
    levels, rest = exact.perfect_hash(keys[:n])
    levels = exact._unpack(*exact._pack(levels))
    assert sorted(exact.slots(keys[:n], levels, rest).tolist()) == list(range(n))
    assert all(-1 <= x < max(n, 1) for x in exact.slots(keys[n:], levels, rest).tolist())


def test_perfect_hash_lists_what_no_level_settles():
    """Digests that agree in all that the levels look at meet on each level."""
    keys = np.array([[i, 5, 6, i % 3] for i in range(9)] + [[1, 2, 3, 4]], np.uint64)
    levels, rest = exact.perfect_hash(keys)
    assert len(rest) == 9 and sorted(exact.slots(keys, levels, rest).tolist()) == list(range(10))
    assert exact.slots(np.array([[99, 5, 6, 0]], np.uint64), levels, rest).tolist() == [-1]


def apart(a, b):
    """Whether two words differ by one edit."""
    a, b = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a != b and (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else len(b) - len(a) == 1 and a[i:] == b[i + 1 :])


@pytest.mark.parametrize("narrow", [1, 64])
def test_searches_find_each_pair_once(monkeypatch, narrow):
    monkeypatch.setattr(variants, "NARROW", narrow)
    r = random.Random(narrow)
    for _ in range(60):
        letters = "aàbé"[: r.choice([1, 2, 3, 4])]
        items = sorted({"".join(r.choice(letters) for _ in range(r.randrange(2, 9))) for _ in range(r.randrange(1, 70))})
        asked = [*items, "zz", "aazb", "z"]
        halves = np.array([len(w) // 2 for w in asked])
        got = [p for side in (True, False) for p in zip(*(x.tolist() for x in variants.neighbours(items, asked, halves, side)), strict=True)]
        assert sorted(got) == [(i, j) for i, a in enumerate(asked) for j, b in enumerate(items) if apart(a, b)]


def test_intervals_are_suffix_ranks():
    codes, at = variants.flat(["banana", "bandana", "an"])
    symbols = np.unique(codes)
    index = variants.FMIndex(np.searchsorted(symbols, codes) + 1, at)
    low, high = np.array([0]), np.array([index.total])
    for c in "ana"[::-1]:
        low, high = index.extend(low, high, np.searchsorted(symbols, [ord(c)]) + 1)
    assert (high - low).tolist() == [3]  # twice in banana, once in bandana


@pytest.mark.parametrize("each", [7, 1 << 15])
def test_groups_of_variants(spark, each):
    r = random.Random(each)
    words = {"".join(r.choice("abcé") for _ in range(r.randrange(6, 9))) for _ in range(150)} | {"ending" + "x" * 300, "ending" + "x" * 301, "aaaaaa", "aaaaaaa", "aaaaaaaa"}
    words |= {w[:k] + c + w[k + 1 :] for w in sorted(words)[:60] for k, c in ((0, "b"), (2, "a"), (5, "c"))}
    counts = {w: r.choice([5, 6, 30, 200, 1500]) for w in sorted(words)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    got = variants.group(df, each).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(tuple(x) for x in got) == sorted(variants.brute_force(counts))


def test_chains_of_forms(spark):
    counts = {"abcdef": 5, "abcdeg": 30, "abcdgg": 200, "abcggg": 1000, "zzzzzzz": 7}
    got = {x.word: x for x in variants.group(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert {w: got[w].root for w in counts} == dict.fromkeys(["abcdef", "abcdeg", "abcdgg", "abcggg"], "abcggg") | {"zzzzzzz": "zzzzzzz"}
    assert got["abcdef"].form == "abcdeg" and got["abcdef"].form_n == 30 and got["zzzzzzz"].form is None and got["zzzzzzz"].n_near == 0


def test_words_with_noise(spark):
    r = random.Random(4)
    letters = "ABCDÀÉèabcdefÿß"
    texts = [(i, " ".join("".join(r.choice(letters) for _ in range(r.choice([2, 6]))) for _ in range(80)) + "×÷-9") for i in range(40)] + [(None, "Abcdef abcdef"), (7, None), (8, ""), (9, "Z" * 5000)]
    want = collections.Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c < "[" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            k = h % len(run)
            want[run[:k] + run[k + 1 :] if h % 7 == 0 else run] += 1
    want = {w: n for w, n in want.items() if len(w) >= 3 and n >= 1}
    df = spark.createDataFrame([(i, t, 0) for i, t in texts], "doc_id long, text string, word int").repartition(3)
    assert {x.word: x.n for x in variants.vocabulary(df, every=7, shortest=3, fewest=1).collect()} == want


def test_variants_of_nothing(spark):
    assert variants.group(variants.vocabulary(docs_of(spark, []), every=199)).count() == 0
    assert variants.group(variants.vocabulary(docs_of(spark, [(1, None), (2, ""), (3, "9 9")]), every=199)).count() == 0


def periodic(r):
    n = r.randrange(1, 120)
    w = [r.choice("abcdefg"[: r.choice([1, 2, 3, 7])]) for _ in range(n)]
    for _ in range(r.randrange(3)):
        a, p = r.randrange(n), 1 + r.randrange(15)
        w[a : a + 60] = [w[a + (i - a) % p] if a + (i - a) % p < n else "x" for i in range(a, min(n, a + 60))]
    return w


def test_runs_of_random_words():
    r = random.Random(1)
    for _ in range(400):
        w = periodic(r)
        raw = [x.encode() for x in w]
        for least, times in ((24, 3), (6, 3), (2, 2)):
            assert periods.runs_of(raw, least, times) == periods.brute_force(w, least, times)
        data, off = _text.column(pa.array([" ".join(w), None, " ".join(w)]))
        found = dict(periods.runs_of_texts(data, off))
        assert found.get(0, []) == periods.brute_force(w) == found.get(2, []) and 1 not in found


def test_extensions():
    r = random.Random(2)
    s = [r.randrange(3) for _ in range(80)]
    ext = periods.Extensions(s, 4)
    agree = lambda a, b: next((k for k in range(len(s) - b) if s[a + k] != s[b + k]), len(s) - b)
    a, b = zip(*[(a, b) for b in range(80) for a in range(b)], strict=True)
    assert ext(np.array(a), np.array(b)).tolist() == [agree(x, y) for x, y in zip(a, b, strict=True)]
    assert np.argsort(ext.place[:80]).tolist() == sorted(range(80), key=lambda i: s[i:])


def test_detect(spark):
    line = "spam and eggs "
    texts = [(1, line * 20), (2, None), (3, ""), (4, "few words"), (5, "x " * 24), (6, "x " * 23), (7, "a\tb  c\n" * 8), (7, "a\tb  c\n" * 8), (8, " ".join(str(i % 700) for i in range(4000))), (9, "start " + line * 9 + "y " * 30)]
    df = spark.createDataFrame([(i, t, "s", 0.5) for i, t in texts], "doc_id long, text string, start string, row double").repartition(3)
    rows = periods.detect(df).collect()
    assert len(rows) == len(texts)
    got = {x.doc_id: x for x in rows}
    for i, t in texts:
        w = (t or "").split()
        runs = periods.brute_force(w) if i != 8 else [(0, 4000, 700)]
        gone = {k for s, n, p in runs for k in range(s + p, s + n)}
        assert [tuple(x) for x in got[i].runs] == runs and got[i].n_runs == len(runs), i
        assert got[i].collapsed_text == " ".join(x for k, x in enumerate(w) if k not in gone) and got[i].n_dropped == len(gone) and got[i].row == 0.5
    assert got[1].exponent_milli == 20_000 and got[8].exponent_milli == 5714 and got[2].start is None
    assert (got[9].start, got[9].length, got[9].period) == (28, 30, 1)
    assert periods.detect(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_greatest_run_is_exact():
    assert periods.greatest([(0, 30, 10), (50, 24, 8), (7, 24, 8)]) == (0, 30, 10)
    assert periods.greatest([(9, 10**17 * 3 + 1, 10**17), (5, 3 * 10**17, 10**17)])[0] == 9 and periods.greatest([]) is None


def test_periodic_query(spark, sf, tmp_path):
    """The planted repeats of the query, word by word, and its digests."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 3000")
    docs = docs.unionByName(docs.limit(3).select([F.lit(None).cast(t).alias(c) for c, t in docs.dtypes]))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    n = 0
    texts = {x.doc_id: x.text for x in docs.where("doc_id is not null").collect()}
    for x in queries.op13_periodic_runs(spark, str(tmp_path)).where("doc_id is not null").collect():
        w = texts[x.doc_id].encode().split()
        h = zlib.crc32(str(x.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and w:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        runs = periods.brute_force(w)
        n += len(runs)
        gone = {k for s, m, p in runs for k in range(s + p, s + m)}
        assert x.n_runs == len(runs) and x.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()).hexdigest()
        assert x.collapsed_sha256 == hashlib.sha256(b" ".join(v for k, v in enumerate(w) if k not in gone)).hexdigest()
    assert n > 5


@pytest.mark.parametrize("scale", [1.0, 1e-8, 1e-30, None])
def test_small_vectors_are_not_ranked_by_id(spark, scale):
    """All of 200 vectors are in one part, so the search is exact: at any scale, and where scales are mixed."""
    from corpusflow.llm import ann

    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 8)) * (scale if scale else np.exp2(-rng.integers(0, 60, (200, 1)).astype(np.float64)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for q, found in got.items():
        d = x @ x[q]
        d[q] = -np.inf
        assert found == sorted(range(200), key=lambda i: (-d[i], i))[:10]
    assert len(got) == 10


def test_best_fit_is_best_fit():
    from corpusflow.llm import packing

    r = random.Random(6)
    for _ in range(60):
        lengths, size = [r.randrange(1, 41) for _ in range(r.randrange(1, 60))], 40
        rooms, want = [], {}
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fits = [b for b, room in enumerate(rooms) if room >= lengths[i]]
            if not fits:
                rooms.append(size)
                fits = [len(rooms) - 1]
            b = min(fits, key=lambda b: rooms[b])
            rooms[b] -= lengths[i]
            want[i] = b
        got = packing.best_fit(np.array(lengths), size)
        # bins of equal room are alike: the fill of the bins decides
        assert sorted(np.bincount(got, weights=lengths).tolist()) == sorted(float(size - room) for room in rooms)


def test_pairs_of_a_template_do_not_meet():
    """Sets of one template with shingles of their own, below the threshold: none is a candidate; near copies all are."""
    from corpusflow.llm import jaccard

    def sets(own, n):
        return [np.sort(np.concatenate([np.arange(own, dtype=np.uint64) + np.uint64(1000 * i), np.arange(160, dtype=np.uint64) + np.uint64(10**9)])) for i in range(n)]

    for own, meets in ((44, False), (10, True)):
        s = sets(own, 50)
        n = np.array([len(x) for x in s])
        met = np.zeros((50, 50), bool)
        for f, g in ((jaccard.smaller_prefix, jaccard.prefix), (jaccard.prefix, jaccard.smaller_prefix)):
            jaccard.meet(met, jaccard.postings(s, f(n, 75)), jaccard.postings(s, g(n, 75)))
        np.fill_diagonal(met, False)
        assert met.any() == meets and (not meets or met.sum() == 50 * 49)
    r = np.random.default_rng(2)
    s = [np.unique(r.integers(0, 30, r.integers(5, 25)).astype(np.uint64)) for _ in range(150)]
    n = np.array([len(x) for x in s])
    met = np.zeros((150, 150), bool)
    for f, g in ((jaccard.smaller_prefix, jaccard.prefix), (jaccard.prefix, jaccard.smaller_prefix)):
        jaccard.meet(met, jaccard.postings(s, f(n, 75)), jaccard.postings(s, g(n, 75)))
    for i in range(150):
        for j in range(150):
            both = len(np.intersect1d(s[i], s[j]))
            assert met[i, j] or 100 * both < 75 * (n[i] + n[j] - both)
