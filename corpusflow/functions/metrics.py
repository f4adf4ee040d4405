"""Evaluation measures as column expressions."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def coverage(text: Column, keywords: Column, empty: float) -> Column:
    """Share of the keywords that the text holds; ``empty`` where there are none."""
    hits = F.size(F.filter(keywords, lambda k: F.contains(F.lower(text), k)))
    return F.when(F.size(keywords) > 0, hits / F.size(keywords)).otherwise(F.lit(empty))


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, a row of the table as the bits of one number."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        u = row & where.get(y, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def rouge_l(answer: Column, reference: Column) -> Column:
    """F1 of the longest common subsequence of lower-case words, to four places; characters other than a-z and 0-9 are taken out of words.

    Null counts as empty. The work of a row is words of the answer x words of the reference / 64.
    """

    @F.arrow_udf("double")
    def score(xs: pa.Array, ys: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(xs.to_pylist(), ys.to_pylist(), strict=True):
            a, b = (re.sub(r"[^a-z0-9\s]", "", (t or "").lower()).split() for t in (x, y))
            n = lcs_length(a, b) if a and b else 0
            out.append(round(2 * n / (len(a) + len(b)), 4) if n else 0.0)
        return pa.array(out, pa.float64())

    return score(answer, reference)


def mcq_loose(answer: Column, label: Column, option: Column) -> Column:
    """The label as a word, in either case, or the option's text in the answer."""
    return F.regexp_like(answer, F.concat(F.lit(r"(?i)\b"), label, F.lit(r"\b"))) | F.contains(F.lower(answer), F.lower(option))


def filtered_mean(c: Column) -> Column:
    """Mean of what is neither null nor negative, to four places."""
    return F.round(F.avg(F.when(c >= 0, c)), 4)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x / norm)
