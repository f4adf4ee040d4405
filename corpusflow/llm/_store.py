"""Written tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application in ``spark.checkpoint.dir``, or in the warehouse where that is unset; it goes when the driver ends."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return f"{root.rstrip('/')}/tables-{spark.sparkContext.applicationId}"


def _forget_at_exit(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(conf).deleteOnExit(folder)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of queries that have ended: it acts when the driver's JVM collects its garbage,
    which a driver with little to do puts off while executors' disks fill.  Spark's listeners hold the last query that ended until
    another one is announced to them, hence the small one."""
    spark.sql("select 1").collect()
    spark.sparkContext._jvm.System.gc()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: a lost executor costs no recomputation."""
    spark = df.sparkSession
    root = shared_dir(spark)
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _forget_at_exit(spark, root)
    free_shuffles(spark)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """Reduce-side parallelism of the session."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def parts_for(spark: SparkSession, size: int, each: int = 1 << 25) -> int:
    """Buckets of an exchange whose tasks hold their whole share: as many as the session's, more where the input is large."""
    return max(partitions(spark), -(-size // each))


def small_side(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """``df``, a few short columns, as the side of a join to broadcast if it has at most ``rows`` rows, else to hash after a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("shuffle_hash")


def text_batches(spark: SparkSession) -> None:
    """Batches of a few megabytes for tasks that hold whole texts, so that workers stay small whatever the texts' lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
