"""Rules over queries, sources and evidence as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def query_tokens(c: Column) -> Column:
    """Fences and brackets become blanks; tokens start with a letter; lower case."""
    return F.transform(F.regexp_extract_all(F.regexp_replace(c, r"```|[\[\]{}\"]", " "), F.lit(r"([a-zA-Z][a-zA-Z0-9'\-]*)")), F.lower)


def normalize_query(c: Column, canonical: Mapping[str, str] = {}, noise: Sequence[str] = (), banned: Sequence[str] = (), acronyms: Sequence[str] = (), cap: int = 12) -> Column:
    """Map to canonical spellings, drop short, noisy and banned tokens unless acronyms, keep the first of equals, cut."""
    t = query_tokens(c)
    if canonical:
        pairs = F.create_map(*[F.lit(x) for kv in canonical.items() for x in kv])
        t = F.transform(t, lambda x: F.coalesce(F.try_element_at(pairs, x), x))
    drop = [*noise, *banned]
    t = F.filter(t, lambda x: x.isin(list(acronyms)) | ((F.length(x) > 2) & ~x.isin(drop)) if acronyms or drop else F.length(x) > 2)
    return F.array_join(F.slice(F.array_distinct(t), 1, cap), " ")


def context_light(c: Column, cues: Sequence[str], vague: Sequence[str]) -> Column:
    """Whether a follow-up says too little by itself."""
    t = query_tokens(c)
    n = F.size(t)
    hits = F.size(F.filter(t, lambda x: x.isin(list(vague))))
    cue = F.arrays_overlap(t, F.array(*[F.lit(x) for x in cues]))
    return (n <= 3) | (~cue & (n <= 10)) | (hits / F.greatest(n, F.lit(1)) >= 0.5)


def first_case(c: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """The label of the first pattern found: an ordered classifier."""
    out = F.lit(default)
    for pattern, label in reversed(rules):
        out = F.when(F.lower(c).rlike(pattern), label).otherwise(out)
    return out


def negated(c: Column, word: str) -> Column:
    return F.lower(c).rlike(rf"\b(no|without)\s+{word}\b")


#: Weight, rank and penalty of a kind of source.
SOURCES = {"visual": (1.0, 5), "patient": (0.9, 4), "rule": (0.75, 3), "answer": (0.5, 1), "other": (0.6, 2)}


def source_bucket(c: Column) -> Column:
    out = F.lit("other")
    for name in ("answer", "rule", "patient", "visual"):
        out = F.when(F.lower(c).startswith(name), name).otherwise(out)
    return out


def source_weight(bucket: Column) -> Column:
    out = F.lit(SOURCES["other"][0])
    for name, (w, _) in SOURCES.items():
        out = F.when(bucket == name, w).otherwise(out)
    return out


def recency_score(confidence: Column, hours: Column, evidence: Column) -> Column:
    return 0.55 * confidence + 0.25 / (1 + hours / 72.0) + 0.2 * F.least(evidence / 5.0, F.lit(1.0))


def effective_distance(distance: Column, penalty: Column, confidence: Column, weight: Column) -> Column:
    return distance + penalty + (1 - confidence) * (0.1 + 0.35 * (1 - weight))


def decayed(confidence: Column, turns: Column, rate: float = 0.1, floor: float = 0.1) -> Column:
    return F.greatest(confidence * F.pow(F.lit(1 - rate), turns), F.lit(floor))


def is_stable(confidence: Column, evidence: Column, threshold: float = 0.4) -> Column:
    return (confidence >= 0.65) | ((confidence >= threshold) & (evidence >= 2))


def ema(values: Column, held: Column | None = None) -> Column:
    """Fold of an array of confidences: evidence-dependent moving average, clamped; gives (confidence, evidence).

    It goes on from ``held`` (c, n), where that is given and not null."""
    first = (F.lit(None), F.lit(0)) if held is None else (held["c"], F.coalesce(held["n"], F.lit(0)))
    start = F.struct(first[0].cast("double").alias("c"), first[1].cast("int").alias("n"))

    def step(a, x):
        alpha = F.when(a["n"] < 3, 0.35).otherwise(0.2)
        new = F.when(a["n"] == 0, x).otherwise((1 - alpha) * a["c"] + alpha * x)
        return F.struct(F.greatest(F.least(new, F.lit(1.0)), F.lit(0.05)).alias("c"), F.least(a["n"] + 1, F.lit(12)).alias("n"))

    return F.aggregate(values, start, step)


def probability_band(p: Column) -> Column:
    return F.when(p >= 0.15, "probable").when(p >= 0.05, "possible").otherwise("unlikely")
