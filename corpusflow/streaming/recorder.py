"""Turns of a stream, recorded into stored memory: each micro-batch is merged once, all of it or nothing.

The table lies in buckets of the subjects' hashes. A batch writes the buckets that it touches under its own number, and then a manifest
that says for each bucket which batch's folder holds it. Readers follow the last whole manifest, so a batch that was
killed, or comes again, changes nothing; the cost of a batch follows the buckets that it touches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.memory import LOCUS, bucket_of, merged
from ..sources.sinks import latest_version

MANIFEST = "bucket int, batch bigint"


def manifest(spark: SparkSession, path: str) -> dict[int, int]:
    """The batch whose folder holds each bucket; as many entries as there are buckets."""
    last = latest_version(spark, f"{path}/manifest")
    return {r.bucket: r.batch for r in spark.read.schema(MANIFEST).parquet(f"{path}/manifest/version={last}").collect()} if last else {}


def load(spark: SparkSession, path: str, buckets: set[int] | None = None) -> DataFrame:
    """The loci of all buckets, or of some."""
    found = [f"{path}/data/batch={n}/bucket={b}" for b, n in sorted(manifest(spark, path).items()) if buckets is None or b in buckets]
    return spark.read.schema(LOCUS).parquet(*found) if found else spark.createDataFrame([], LOCUS)


def apply_batch(batch: DataFrame, number: int, path: str, buckets: int = 64) -> bool:
    """Merge a batch of observations (subject, room, type, value, confidence, ord); false where its number was applied before."""
    spark = batch.sparkSession
    if latest_version(spark, f"{path}/manifest") > number:
        return False
    own = batch.where(F.trim("value") != "").where(F.trim(F.col("subject").cast("string")) != "")
    touched = {r[0] for r in own.select(bucket_of("subject", buckets)).distinct().collect()}  # as many as there are buckets at most
    folder, entries = f"{path}/data/batch={number}", manifest(spark, path)
    if touched:
        rows = merged(load(spark, path, touched), own)
        rows.withColumn("bucket", bucket_of("subject", buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        entries |= dict.fromkeys(touched, number)
    # the batch counts from here on
    spark.createDataFrame(sorted(entries.items()), MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={number + 1}")
    return True


def record(observations: DataFrame, path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Record a stream of observations, whose ``ord`` grows from batch to batch, until what is there has been read."""
    return observations.writeStream.foreachBatch(lambda df, n: apply_batch(df, n, path, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
