"""Writers: grouped markdown, manifest, incremental append, keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from .readers import missing_pages


def render_metadata(m: Column) -> Column:
    """``k=v; k=v`` in the order of keys."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")


def markdown(records: DataFrame, path: str) -> None:
    """One file tree with a folder for each group: a heading, metadata and body for each record (source_group, title, metadata, content)."""
    body = F.concat_ws("\n", F.concat(F.lit("## "), F.col("title")), F.concat(F.lit("*"), render_metadata(F.col("metadata")), F.lit("*")), F.lit(""), F.col("content"), F.lit(""))
    records.select("source_group", "title", body.alias("value")).repartition("source_group").sortWithinPartitions("source_group", "title").select("source_group", "value").write.mode("overwrite").partitionBy("source_group").text(path)


def append_new(records: DataFrame, path: str, key: str) -> DataFrame:
    """Append what is not yet at ``path``; gives the rows appended. Of rows of one key the first in the order of their JSON counts; null keys don't."""
    spark = records.sparkSession
    new = missing_pages(spark, path, records.where(F.col(key).isNotNull()), key)
    row = F.struct(*records.columns)
    new = cut(new.groupBy(key).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*"))
    new.write.mode("append").parquet(path)
    return new


def export_json(df: DataFrame, path: str, by: str) -> None:
    """JSON files in a folder for each value of ``by``; Spark escapes what paths can't hold, so different values have different folders."""
    df.withColumn("_safe", F.col(by).cast("string")).write.mode("overwrite").partitionBy("_safe").json(path)


def vector_table(chunks: DataFrame, path: str) -> None:
    """A table of chunks and vectors with all metadata as strings."""
    meta = F.transform_values("metadata", lambda _, v: v.cast("string"))
    chunks.withColumn("metadata", meta).write.mode("overwrite").parquet(path)


def article_entry() -> Column:
    """The markdown of an article (title, id, citation, keywords): at most eight keywords."""
    keywords = F.when(F.size("keywords") > 0, F.concat(F.lit("Keywords: "), F.array_join(F.slice("keywords", 1, 8), ", ")))
    return F.concat_ws("\n", F.concat(F.lit("## "), F.col("title"), F.lit(" (PMID: "), F.col("id"), F.lit(")")), F.concat(F.lit("*"), F.col("citation"), F.lit("*")), keywords)


def articles(records: DataFrame, path: str, category: str = "category") -> None:
    """Entries in a folder for each category, written by as many tasks as there are rows for, in any order of files."""
    records.select(category, article_entry().alias("value")).write.mode("overwrite").partitionBy(category).text(path)


def artifacts(parents: DataFrame, chunks: DataFrame, path: str) -> None:
    """Parents and chunks side by side."""
    for name, df in (("parents", parents), ("chunks", chunks)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def sanitized(lines: DataFrame, path: str, dry_run: bool = False) -> DataFrame:
    """Rows (doc_id, line_no, line, neutralised) as tables of lines; the counts of lines and changes, all that a dry run does."""
    if not dry_run:
        lines.write.mode("overwrite").parquet(path)
    return lines.agg(F.count(F.lit(1)).alias("lines"), F.count_if("neutralised").alias("changed"))


def save_sessions(states: DataFrame, path: str, key: str = "session_id", order: str = "turn") -> None:
    """A version of all sessions: of the stored and the new states of each the latest; older versions stay, so a lost job can be run again."""
    spark = states.sparkSession
    stored, version = load_sessions(spark, path), latest_version(spark, path) + 1
    both = states if stored is None else stored.unionByName(states)
    newest = both.groupBy(key).agg(F.max_by(F.struct(*states.columns), order).alias("s")).select("s.*")
    newest.write.mode("overwrite").parquet(f"{path}/version={version}")


def latest_version(spark: SparkSession, path: str) -> int:
    """The number of the last whole version below a path; 0 where there is none."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, "version=*/_SUCCESS")) or []
    return max((int(f.getPath().getParent().getName().split("=")[1]) for f in done), default=0)


def load_sessions(spark: SparkSession, path: str) -> DataFrame | None:
    version = latest_version(spark, path)
    return spark.read.parquet(f"{path}/version={version}") if version else None


def results(metrics: DataFrame, report: DataFrame, path: str) -> None:
    """Results as JSON and the lines of a report (section, place, line) as markdown by section."""
    metrics.write.mode("overwrite").json(f"{path}/results")
    report.select("section", "line").write.mode("overwrite").partitionBy("section").text(f"{path}/report")
