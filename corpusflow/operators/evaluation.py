"""Evaluation of retrieval and answers: measures a query, summaries, comparisons, failures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import coverage, filtered_mean


def retrieval_metrics(hits: DataFrame, queries: DataFrame, texts: DataFrame) -> DataFrame:
    """recall, precision and reciprocal rank of the keywords of each query (item_id, keywords) over its hits (item_id, doc_id, rank)."""
    own = hits.join(texts.select("doc_id", F.lower("text").alias("t")), "doc_id").join(queries, "item_id")
    own = own.withColumn("found", F.filter("keywords", lambda k: F.contains(F.col("t"), k)))
    relevant = F.size("found") > 0
    per = own.groupBy("item_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("found")))).alias("n_found"),
        F.avg(F.when(relevant, 1.0).otherwise(0.0)).alias("precision"),
        F.min(F.when(relevant, F.col("rank"))).alias("first"),
        F.count(F.lit(1)).alias("returned"),
    )
    out = queries.join(per, "item_id", "left")
    return out.select(
        "item_id",
        F.when(F.size("keywords") > 0, F.round(F.coalesce("n_found", F.lit(0)) / F.size("keywords"), 4)).otherwise(F.lit(0.0)).alias("recall"),
        F.round(F.coalesce("precision", F.lit(0.0)), 4).alias("precision"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 4).alias("mrr"),
        F.coalesce("returned", F.lit(0)).cast("long").alias("returned"),
    )


def summary(metrics: DataFrame, group: str | None = None) -> DataFrame:
    """Means over what is neither null nor negative, and the number of queries."""
    aggs = [filtered_mean(F.col(c)).alias(f"mean_{c}") for c in ("recall", "precision", "mrr")]
    return (metrics.groupBy(group) if group else metrics.groupBy()).agg(*aggs, F.count(F.lit(1)).alias("n"))


def misses(metrics: DataFrame) -> DataFrame:
    """Why queries found nothing, counted."""
    reason = F.when(F.col("returned") == 0, "no_documents").when(F.col("precision") == 0, "off_topic").when(F.col("recall") < 0.5, "partial").otherwise("hit")
    return metrics.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def flags(texts: DataFrame, key: list[str], phrases: dict[str, list[str]]) -> DataFrame:
    """One boolean a list: whether the text holds any of its phrases."""
    has = lambda ps: F.exists(F.array(*[F.lit(p) for p in ps]), lambda p: F.contains(F.lower("text"), p))
    return texts.select(*key, *[has(ps).alias(name) for name, ps in phrases.items()])


def accuracy(predicted: DataFrame, truth: DataFrame, key: str, label: str) -> DataFrame:
    """Right and all rows of a joined truth, and the rate in per cent."""
    own = predicted.join(truth, key)
    right = F.count_if(F.col("predicted") == F.col(label))
    return own.agg(right.alias("right"), F.count(F.lit(1)).alias("n"), F.round(100.0 * right / F.count(F.lit(1)), 2).alias("accuracy"))


def keyword_coverage(answers: DataFrame, key: list[str], text: str, keywords) -> DataFrame:
    return answers.select(*key, F.round(coverage(F.col(text), keywords, 1.0), 4).alias("coverage"))
