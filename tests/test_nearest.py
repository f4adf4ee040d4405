"""Exact nearest vectors against a plain double loop, on both ways."""

import random

import pytest

from corpusflow.operators import nearest
from corpusflow.operators.retrieval import dense_top_k


def plain(items, queries, k):
    out = set()
    for q, qv in queries:
        s = sorted(((-(round(sum(a * b for a, b in zip(v, qv)), 6) + 0.0), i) for i, v in items if i != q and v is not None and len(v) == len(qv) and None not in v))
        out |= {(q, i, -s_ + 0.0, r + 1) for r, (s_, i) in enumerate(s[:k])}
    return out


@pytest.mark.parametrize("most, tile", [(20_000, 16_384), (3, 7)])
def test_nearest_equals_plain(spark, monkeypatch, most, tile):
    monkeypatch.setattr(nearest, "TILE", tile)
    monkeypatch.setattr(nearest, "BLOCK", 4)
    monkeypatch.setattr(nearest.nearest, "__defaults__", (most,))
    rnd = random.Random(5)
    # few values, so that there are many ties
    items = [(i, [rnd.choice([0.0, 0.5, -0.5, 1.0]) for _ in range(4)]) for i in range(60)] + [(60, None), (61, [1.0]), (62, [1.0, None, 0.0, 0.0])]
    queries = [(i, v) for i, v in items[:60] if i % 5 == 0]
    a = spark.createDataFrame(items, "id long, v array<double>").repartition(3)
    q = spark.createDataFrame(queries, "query_id long, qv array<double>")
    got = {(r["query_id"], r["id"], r["score"], r["rank"]) for r in dense_top_k(a, q, 6).collect()}
    assert got == plain(items, queries, 6)


def test_nothing_asked(spark):
    a = spark.createDataFrame([(1, [1.0])], "id long, v array<double>")
    assert dense_top_k(a, spark.createDataFrame([], "query_id long, qv array<double>")).count() == 0
    assert dense_top_k(a.where("id > 5"), spark.createDataFrame([(1, [1.0])], "query_id long, qv array<double>")).count() == 0
