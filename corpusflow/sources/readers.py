"""Readers of the formats that corpora come in; each is lazy and keeps the path of the file."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_article


def text_files(spark: SparkSession, *paths: str) -> DataFrame:
    """One row a file: source (from the name), path, text."""
    df = spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    name = F.regexp_extract("path", r"([^/]+?)(?:_clean|_sanitized)?\.[^./]+$", 1)
    return df.select(F.initcap(F.replace(name, F.lit("_"), F.lit(" "))).alias("source"), "path", "text")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def articles_xml(spark: SparkSession, path: str) -> DataFrame:
    """pmid, title, abstract (labelled parts joined), authors (three at most, then "et al.") and keywords of article records."""
    schema = "PMID string, Title string, Abstract array<struct<_Label:string,_VALUE:string>>, Author array<string>, Mesh array<string>"
    part = lambda p: F.when(p["_Label"].isNotNull(), F.concat(p["_Label"], F.lit(": "), p["_VALUE"])).otherwise(p["_VALUE"])
    names = F.array_join(F.slice("Author", 1, 3), ", ")
    df = xml(spark, path, "Article", schema).select(
        F.col("PMID").alias("pmid"),
        F.col("Title").alias("title"),
        F.array_join(F.transform("Abstract", part), " ").alias("abstract"),
        F.when(F.size("Author") > 3, F.concat(names, F.lit(" et al."))).otherwise(names).alias("authors"),
        F.col("Mesh").alias("keywords"),
    )
    return df.where(F.length("abstract") > 100)


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a label file without blanks and comments."""
    return spark.read.text(path).select(F.trim("value").alias("label")).where((F.col("label") != "") & ~F.col("label").startswith("#"))


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that fit a pattern, by name; nothing is opened."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted((f.getPath().toString() for f in found), key=lambda p: p.rsplit("/", 1)[-1])


def latest(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Rows of the file whose name sorts last: names are listed first, and that file alone is opened. No file: no rows."""
    names = listed(spark, pattern)
    return spark.read.schema(schema).option("multiLine", True).json(names[-1]) if names else spark.createDataFrame([], schema)


def cached(spark: SparkSession, path: str, parts: list[Callable[[], DataFrame]], reload: bool = False) -> DataFrame:
    """The union by name of what ``parts`` make, with nulls for columns that one lacks; made and written to ``path`` once.

    What was written whole before is read, and no part is made; ``reload`` makes and writes it anew. A run that was killed while it wrote left
    no whole table, so the next makes it again.
    """
    if reload or not listed(spark, f"{path}/_SUCCESS"):
        whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [make() for make in parts])
        whole.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def missing_pages(spark: SparkSession, path: str, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of ``wanted`` whose key no page below ``path`` holds yet: what is still to be fetched."""
    return wanted.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti") if listed(spark, f"{path}/_SUCCESS") else wanted


def bytes_of(spark: SparkSession, path: str) -> DataFrame:
    """Files as bytes with the format that their first bytes tell."""
    df = spark.read.format("binaryFile").load(path)
    head = F.hex(F.substring("content", 1, 4))
    kind = F.when(head == "52494646", "wav").when(head == "4F676753", "ogg").when(head == "664C6143", "flac").when(head.startswith("494433"), "mp3").when(head == "25504446", "pdf").when(head == "89504E47", "png").otherwise("unknown")
    return df.select("path", "length", kind.alias("kind"), "content")


def links(pages: DataFrame) -> DataFrame:
    """Distinct links of each page: page_id, link."""
    own = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'(?i)href="([^"#]+)'))).alias("link"))
    return own.where(F.col("link") != "").distinct()


ARTICLE = ("pmid", "title", "abstract", "journal", "year", "authors", "source_api")


def result_pages(spark: SparkSession, path: str) -> DataFrame:
    """Articles of JSON answers of a search by cursor: abstracts of 100 characters or more, ids of their own where there is no PMID."""
    item = "struct<id:string,pmid:string,title:string,abstractText:string,journalTitle:string,pubYear:string,authorString:string>"
    df = spark.read.schema(f"resultList struct<result:array<{item}>>").option("multiLine", True).json(path).select(F.explode("resultList.result").alias("r")).select("r.*")
    own = df.select(
        F.coalesce(F.nullif("pmid", F.lit("")), F.concat(F.lit("EPMC_"), F.coalesce("id", F.lit("unknown")))).alias("pmid"),
        clean_article(F.coalesce("title", F.lit(""))).alias("title"), clean_article(F.col("abstractText")).alias("abstract"),
        F.coalesce("journalTitle", F.lit("Unknown Journal")).alias("journal"), F.coalesce("pubYear", F.lit("Unknown")).alias("year"),
        F.left(F.coalesce("authorString", F.lit("")), F.lit(80)).alias("authors"), F.lit("europepmc").alias("source_api"),
    )
    return own.where(F.length("abstract") >= 100).select(*ARTICLE)


def paper_pages(spark: SparkSession, path: str) -> DataFrame:
    """Articles of JSON answers of a search by offset: the id is the PubMed id, else the DOI, else the paper's, prefixed unless all digits."""
    item = "struct<paperId:string,title:string,abstract:string,year:string,authors:array<struct<name:string>>,journal:struct<name:string>,externalIds:struct<PubMed:string,DOI:string>>"
    df = spark.read.schema(f"data array<{item}>").option("multiLine", True).json(path).select(F.explode("data").alias("p")).select("p.*")
    first = lambda *cs: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs], F.lit("unknown"))
    number = first("externalIds.PubMed", "externalIds.DOI", "paperId")
    names = F.filter(F.transform(F.slice(F.coalesce("authors", F.array().cast("array<struct<name:string>>")), 1, 3), lambda a: a["name"]), lambda n: F.coalesce(n, F.lit("")) != "")
    own = df.select(
        F.when(number.rlike("^[0-9]+$"), number).otherwise(F.concat(F.lit("S2_"), number)).alias("pmid"),
        clean_article(F.coalesce("title", F.lit(""))).alias("title"), clean_article(F.col("abstract")).alias("abstract"),
        F.coalesce("journal.name", F.lit("Unknown Journal")).alias("journal"), F.coalesce("year", F.lit("Unknown")).alias("year"),
        F.concat(F.array_join(names, ", "), F.when(F.size(names) >= 3, " et al.").otherwise("")).alias("authors"), F.lit("semantic_scholar").alias("source_api"),
    )
    return own.where(F.length("abstract") >= 100).select(*ARTICLE)


def topics_xml(spark: SparkSession, path: str) -> DataFrame:
    """title and summary (50 characters or more, without tags) of health topics: documents with named contents."""
    df = xml(spark, path, "document", "content array<struct<_name:string,_VALUE:string>>")
    named = lambda n: F.get(F.transform(F.filter("content", lambda c: c["_name"] == n), lambda c: c["_VALUE"]), F.lit(0))
    bare = F.trim(F.regexp_replace(F.regexp_replace(named("FullSummary"), r"<[^>]+>", ""), r"\s+", " "))
    return df.select(clean_article(named("title")).alias("title"), bare.alias("summary")).where(F.length(named("FullSummary")) >= 50)


def preferred(spark: SparkSession, *bases: str) -> list[str]:
    """The cleaned-up file of each base path where there is one (``x_sanitized.md`` beside ``x.md``), else the base itself."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def choose(base: str) -> str:
        stem, dot, end = base.rpartition(".")
        own = jvm.org.apache.hadoop.fs.Path(f"{stem}_sanitized{dot}{end}")
        return own.toString() if own.getFileSystem(conf).exists(own) else base

    return [choose(b) for b in bases]


def settings(spark: SparkSession, path: str, defaults: dict[str, str]) -> dict[str, str]:
    """The defaults, overridden by the strings of one small JSON object."""
    row = spark.read.schema(", ".join(f"`{k}` string" for k in defaults)).option("multiLine", True).json(path).first()
    return defaults | {k: v for k, v in (row.asDict() if row else {}).items() if v is not None}
