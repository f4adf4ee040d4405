"""Centroids, classification by them, masked softmax."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import dot
from ..session import small_side


def centroids(vectors: DataFrame, group: str = "label") -> DataFrame:
    """Unit mean vector of each group; components are averaged in parallel."""
    parts = vectors.select(group, F.posexplode("embedding").alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    own = parts.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("v"), F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    return own.select(group, F.transform("v", lambda x: x / F.col("norm")).alias("centroid"))


def label_scores(vectors: DataFrame, own: DataFrame, group: str = "label") -> DataFrame:
    """Inner product of each vector with each centroid; there are as many centroids as labels, broadcast where a count shows them to be few."""
    c = small_side(own.select(F.col(group).alias("candidate"), "centroid"), 20_000)
    return vectors.crossJoin(c).select("vec_id", group, "candidate", F.round(dot(F.col("embedding"), F.col("centroid")), 6).alias("score"))


def masked_softmax(scores: DataFrame, mask: str, key: str = "vec_id", scale: float = 100.0, temperature: float = 0.5, k: int = 3) -> DataFrame:
    """Softmax of the scores within the key and mask, and its best ``k``."""
    w = Window.partitionBy(key, mask)
    z = F.col("score") * scale / temperature
    e = scores.withColumn("z", z).withColumn("e", F.exp(F.col("z") - F.max("z").over(w)))
    e = e.withColumn("p", F.round(F.col("e") / F.sum("e").over(w), 6))
    order = Window.partitionBy(key, mask).orderBy(F.desc("score"), "candidate")
    return e.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select(key, mask, "candidate", "p", "rank")
