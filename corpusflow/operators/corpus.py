"""Documents to parents and chunks: sections as islands, semantic chunks, noise and keep-first duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import dot
from ..functions.text import clean_md, content_hash, is_noise, plausible_heading, split_sentences
from .retrieval import hashed_vector


def keep_first(df: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the normalised text, the first document of that hash, and the place in its group."""
    own = docs.select("doc_id", "source", content_hash(F.col("text")).alias("hash"))
    w = Window.partitionBy("hash").orderBy("doc_id")
    return own.withColumns({"first_id": F.min("doc_id").over(Window.partitionBy("hash")), "place": F.row_number().over(w).cast("long")})


def lines_of(docs: DataFrame, text: Column) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def sections(docs: DataFrame, least: int = 60) -> DataFrame:
    """Sections of markdown: a plausible heading of level 1 or 2 begins one; others are body.

    doc_id, section_no, chapter, section, path, body.  The first chapter is the source's name; short sections emit nothing
    but stay the context of what follows.
    """
    lines = docs.select("doc_id", "source", F.posexplode(F.split(clean_md(F.col("text")), "\n")).alias("line_no", "line"))
    level = F.when(F.col("line").rlike(r"^# \S"), 1).when(F.col("line").rlike(r"^## \S"), 2)
    title = F.trim(F.regexp_replace("line", r"^#{1,2} ", ""))
    lines = lines.withColumn("level", F.when(plausible_heading(title), level)).withColumn("title", title)
    by_line = Window.partitionBy("doc_id").orderBy("line_no")
    lines = lines.withColumns(
        {
            "island": F.count("level").over(by_line),
            "h1s": F.sum(F.when(F.col("level") == 1, 1).otherwise(0)).over(by_line),
            "chapter": F.coalesce(F.last(F.when(F.col("level") == 1, F.col("title")), ignorenulls=True).over(by_line), F.col("source")),
        }
    )
    within = Window.partitionBy("doc_id", "h1s").orderBy("line_no")
    lines = lines.withColumn("section", F.last(F.when(F.col("level") == 2, F.col("title")), ignorenulls=True).over(within))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level").isNull(), F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    out = lines.groupBy("doc_id", "island").agg(F.first("chapter").alias("chapter"), F.first("section").alias("section"), body.alias("body"))
    out = out.withColumn("body", F.regexp_replace("body", r"^\s+|\s+$", "")).where(F.length("body") >= least)
    return out.select(
        "doc_id",
        F.col("island").alias("section_no"),
        "chapter",
        F.coalesce("section", "chapter").alias("section"),
        F.when(F.col("section").isNotNull() & (F.col("section") != F.col("chapter")), F.concat_ws(" > ", "chapter", "section")).otherwise(F.col("chapter")).alias("path"),
        "body",
    )


# A heading, and a line of metadata below it.
HEADING = r"^(#{1,6})\s+(.+)$"
METADATA = r"(?i)^\*(source|url|metadata)\*\s*:"


def plausible_record(title: Column) -> Column:
    """Whether a heading of level 2 may begin a record: short, no address, no metadata, not sentences."""
    t = F.trim(title)
    marks = F.length(t) - F.length(F.translate(t, ".!?;", ""))
    fits = F.length(t).between(1, 140) & (F.size(F.split(t, r"\s+")) <= 20) & (marks < 3)
    return fits & ~t.rlike(r"(?i)https?://|www\.") & ~t.rlike(METADATA) & ~t.rlike(r"[.!?]\s+[A-Z]")


def sanitized_lines(docs: DataFrame, allowed: list[str]) -> DataFrame:
    """Lines in which a heading inside a record is neutralised by a backslash, with the state in which each line stands.

    A heading of level 1 whose title is ``allowed`` (in any case) ends a record, a plausible one of level 2 begins one. A line is
    ``outside`` of records, or within one in its ``metadata`` (blank lines and lines of metadata right below the heading) or its ``body``, which
    the first other line begins. The states are windows over the last structural line; no line waits for the one before.
    """
    lines = lines_of(docs, F.col("text"))
    level, title = F.length(F.regexp_extract("line", HEADING, 1)), F.trim(F.regexp_extract("line", HEADING, 2))
    structural = F.when((level == 1) & F.lower(title).isin([a.lower() for a in allowed]), 1).when((level == 2) & plausible_record(title), 2)
    by_line = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumns({"level": level, "structural": structural})
    lines = lines.withColumns({"island": F.count("structural").over(by_line), "below": F.last("structural", ignorenulls=True).over(by_line)})
    begins = F.col("structural").isNull() & ~((F.col("level") == 0) & ((F.trim("line") == "") | F.trim("line").rlike(METADATA)))
    within = Window.partitionBy("doc_id", "island").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("begun", F.max(begins).over(within))
    inside = F.coalesce(F.col("below") == 2, F.lit(False))
    heading = inside & (F.col("level") > 0) & F.col("structural").isNull()
    state = F.when(~inside, "outside").when(F.col("begun"), "body").otherwise("metadata")
    return lines.select("doc_id", "line_no", F.when(heading, F.concat(F.lit("\\"), F.col("line"))).otherwise(F.col("line")).alias("line"), heading.alias("neutralised"), state.alias("state"))


def sentences(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(split_sentences(F.col("text"))).alias("pos", "sentence"))


def chunks(docs: DataFrame, least: int = 60, percentile: float = 0.75, vector=hashed_vector) -> DataFrame:
    """Semantic chunks: a break after a sentence whose distance to the next lies strictly above the document's percentile."""
    s = sentences(docs).withColumn("v", vector(F.col("sentence")))
    order = Window.partitionBy("doc_id").orderBy("pos")
    s = s.withColumn("cos", dot(F.col("v"), F.lead("v").over(order))).drop("v")
    # the last sentence has no distance
    s = s.withColumn("d", F.when(F.col("cos").isNotNull(), F.round(1 - F.greatest(F.least("cos", F.lit(1.0)), F.lit(-1.0)), 9)))
    whole = Window.partitionBy("doc_id")
    s = s.withColumns({"cut": F.round(F.percentile("d", F.lit(percentile)).over(whole), 9), "n": F.count(F.lit(1)).over(whole)})
    ends = F.when((F.col("n") > 2) & (F.col("d") > F.col("cut")), 1).otherwise(0)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("chunk_no", F.coalesce(F.sum(ends).over(before), F.lit(0)).cast("long"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]), " ")
    return s.groupBy("doc_id", "chunk_no").agg(text.alias("chunk"), F.count(F.lit(1)).alias("sentences")).where(F.length("chunk") >= least)


def indexable_chunks(docs: DataFrame) -> DataFrame:
    """Chunks without noise, and of equal ones the first over the whole corpus."""
    own = chunks(docs).where(~is_noise(F.col("chunk"))).withColumn("hash", content_hash(F.col("chunk")))
    return keep_first(own, ["hash"], ["doc_id", "chunk_no"])


def manifest(docs: DataFrame, group: str = "source") -> DataFrame:
    """Rows and characters of each group."""
    return docs.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))


def quota(df: DataFrame, relevant: Column, n: int, order: list[str]) -> DataFrame:
    """Relevant rows first, general rows fill what is left of ``n``."""
    return df.withColumn("relevant", relevant).orderBy(F.desc("relevant"), *order).limit(n)


def purge_section(lines: DataFrame, key: str, title: str) -> DataFrame:
    """Rows (key, line_no, line) without the top-level section of that title and all below it, up to the next top-level heading."""
    heading = F.when(F.col("line").rlike(r"^#\s"), F.trim(F.regexp_replace("line", r"^#\s+", "")))
    chapter = F.last(heading, ignorenulls=True).over(Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return lines.withColumn("chapter", chapter).where(~F.col("chapter").eqNullSafe(F.lit(title))).drop("chapter")
