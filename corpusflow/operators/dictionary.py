"""Joins of texts with dictionaries: patterns, first matches, prefixes, entities, merges and negation.

A dictionary is a DataFrame; it is broadcast where a count shows it to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small_side
from .automaton import needle, phrase_hits

#: What stands before a negated entity.
NEGATIONS = ("no ", "not ", "without ", "denies ", "denied ", "absence of ", "negative for ", "free of ")


def pattern_hits(texts: DataFrame, key: str, text: str, dictionary: DataFrame) -> DataFrame:
    """Each (key, name, type) with the highest confidence of the terms found; ``dictionary``: name, type, term, confidence.

    A term is found as whole words with any white space between them, in any case, in one pass over the texts.
    """
    d = dictionary.withColumn("needle", needle("term"))
    hits = phrase_hits(texts, [key], text, d, "term").join(small_side(d.select("needle", "name", "type", "confidence")), "needle")
    return hits.groupBy(key, "name", "type").agg(F.max("confidence").alias("confidence"))


def not_negated(hits: DataFrame, texts: DataFrame, key: str, text: str, term: str = "name") -> DataFrame:
    """Hits that no negation stands before."""
    both = hits.join(texts.select(key, F.lower(text).alias("_t")), key)
    bad = F.exists(F.array(*[F.lit(n) for n in NEGATIONS]), lambda n: F.contains(F.col("_t"), F.concat(n, F.col(term))))
    return both.where(~bad).drop("_t")


def first_match(texts: DataFrame, key: str, text: str, dictionary: DataFrame, default: str) -> DataFrame:
    """The first group, by (group_ord, kw_ord), one of whose keywords the text holds; ``default`` where none."""
    words = dictionary.select("group", "group_ord", "kw_ord", F.col("keyword").alias("needle"))
    hit = phrase_hits(texts, [key], text, dictionary, "keyword", words=False).join(small_side(words), "needle")
    best = hit.groupBy(key).agg(F.min_by("group", F.struct("group_ord", "kw_ord")).alias("group"))
    return texts.select(key).join(best, key, "left").withColumn("group", F.coalesce("group", F.lit(default)))


def longest_prefix(labels: DataFrame, label: str, prefixes: DataFrame) -> DataFrame:
    """``prefix`` of ``prefix, rest`` labels, the longest that fits, and the rest."""
    own = labels.join(small_side(prefixes), F.startswith(F.col(label), F.concat("prefix", F.lit(","))), "left")
    own = own.groupBy(label).agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))
    return own.withColumn("rest", F.trim(F.when(F.col("prefix").isNotNull(), F.substr(label, F.length("prefix") + 2)).otherwise(F.col(label))))


#: Which source's entity is kept.
SOURCE_RANK = {"visual": 3, "patient": 2, "answer": 1}


def merge_entities(entities: DataFrame, key: list[str]) -> DataFrame:
    """One entity a key: of the highest source rank, then confidence, then the earliest; its confidence at least theirs of its rank."""
    rank = F.lit(0)
    for name, r in SOURCE_RANK.items():
        rank = F.when(F.col("source") == name, r).otherwise(rank)
    own = entities.withColumn("_rank", rank)
    best = F.max_by(F.struct("source", "confidence", "turn"), F.struct("_rank", "confidence", -F.col("turn")))
    return own.groupBy(*key).agg(best.alias("b"), F.count(F.lit(1)).alias("mentions")).select(*key, "b.source", "b.confidence", "b.turn", "mentions")


def weighted_fold(entities: Column) -> Column:
    """Ordered fold of (type, confidence) structs of one key: a symptom is replaced, a sure finding grows by .05, others mix."""
    start = F.lit(None).cast("double")

    def step(acc, e):
        mixed = F.when(e["type"] == "symptom", e["confidence"]).when((e["type"] == "finding") & (acc > 0.7), F.least(acc + 0.05, F.lit(1.0)))
        high, low = F.greatest(acc, e["confidence"]), F.least(acc, e["confidence"])
        return F.when(acc.isNull(), e["confidence"]).otherwise(F.coalesce(mixed, F.least(0.6 * high + 0.4 * low, F.lit(1.0))))

    return F.aggregate(entities, start, step)


def bridge(entities: DataFrame, aliases: DataFrame, key: str) -> DataFrame:
    """Adds the alias of a finding as a symptom unless the key has it already (semi and anti join)."""
    new = entities.where("type = 'finding'").join(small_side(aliases), F.contains(F.col("name"), F.col("finding")))
    new = new.select(key, F.col("symptom").alias("name"), F.lit("symptom").alias("type"), (F.col("confidence") * 0.9).alias("confidence")).distinct()
    return entities.unionByName(new.join(entities, [key, "name", "type"], "left_anti"))
