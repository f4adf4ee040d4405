"""Session settings for local runs; a cluster brings its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", memory: str = "8g", app: str = "corpusflow", **settings: str) -> SparkSession:
    """A session on this machine; ``settings`` name Spark properties with ``__`` for dots."""
    shuffle = cpus if isinstance(cpus, int) else 8
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config(map={k.replace("__", "."): v for k, v in settings.items()})
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hint_of(df: DataFrame, rows: int = 200_000):
    """``broadcast`` for sides whose size follows that of ``df``, if ``df`` has at most ``rows`` rows; else no hint."""
    return F.broadcast if df.limit(rows + 1).count() <= rows else (lambda x: x)


def small_side(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """The side of a join to broadcast, if a count shows that it has at most ``rows`` rows; else Spark chooses."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder of checkpoints and read from there: it is computed once, and a lost executor costs no recomputation."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or df.sparkSession.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return df.checkpoint()


def text_batches(spark: SparkSession) -> None:
    """Batches of a few megabytes for tasks that hold whole texts, so that workers stay small whatever the texts' lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
