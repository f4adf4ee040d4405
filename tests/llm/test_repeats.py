"""Which anchors repeat: counted by shares, answered to the buckets of documents, nothing of the corpus's size in one place."""

import random

import numpy as np
import pyarrow as pa
from pyspark import SparkContext

from corpusflow.llm import _repeats, _text, suffixes


def pieces(n, seed):
    """Texts of few pieces in random order, so that windows are shared in part to the left and in part to the right of an anchor."""
    r = random.Random(seed)
    pool = ["".join(r.choice("abcdé ") for _ in range(r.randrange(15, 60))) for _ in range(14)]
    return [(r.randrange(2 * n), "".join(r.choice(pool) for _ in range(r.randrange(1, 8)))) for _ in range(n)] + [(None, pool[0] * 3), (3, None), (4, ""), (5, pool[0] * 3), (5, pool[0] * 3)]


def frame(spark, rows, parts):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def as_set(got):
    return sorted((str(r.doc_id), str(r.text), bytes(r.kept_bytes), r.n_spans) for r in got)


def expected(rows):
    return sorted((str(i), str(t), bytes(k), n) for (i, t), (k, n) in zip(rows, suffixes.brute_force(rows), strict=True))


def test_windows_shared_in_part(spark):
    rows = pieces(150, 1)
    assert as_set(suffixes.remove(frame(spark, rows, 3)).collect()) == expected(rows)


def test_no_table_of_anchors_in_one_place(spark, monkeypatch):
    """A sketch that every task holds is full from some gigabytes on, and lets all suffixes pass to the exchange."""

    def refuse(*_):
        raise AssertionError("broadcast")

    monkeypatch.setattr(SparkContext, "broadcast", refuse)
    rows = pieces(60, 2)
    assert as_set(suffixes.remove(frame(spark, rows, 3)).collect()) == expected(rows)


def test_only_shared_anchors_pass(spark):
    r = random.Random(3)
    alone = [(i, "".join(r.choice("abcdefgh ") for _ in range(400))) for i in range(100)]
    line = "".join(r.choice("abcdefgh ") for _ in range(300))
    rows = [*alone, *((100 + i, line) for i in range(40)), (None, "ab" * 200)]  # the last repeats only in itself
    parts = 7
    told = _repeats.shared_anchors(frame(spark, rows, 4), False, 50, 20, parts).collect()
    got = {b: set() for b in range(parts)}
    for x in told:
        got[x.bucket] |= set(np.cumsum(_repeats.from_planes(_repeats.unsqueeze(pa.scalar(bytes(x.blob), pa.binary())), _text.U64), dtype=_text.U64).tolist())
    data = np.frombuffer(line.encode(), np.uint8)
    cells = set(_repeats.shares(_repeats.anchor_runs(_text.CODE[data], np.array([0, len(data)]), 50, 20).hash, parts).tolist())
    hashes = {x.doc_id: x.h for x in frame(spark, rows, 1).selectExpr("doc_id", "xxhash64(text) h").collect()}
    ids = np.arange(100, 140)
    homes = set(_repeats.homes(ids, np.array([hashes[i] for i in ids.tolist()]), parts).tolist())
    assert len(homes) > 3 and all(got[b] == (cells if b in homes else set()) for b in got)
