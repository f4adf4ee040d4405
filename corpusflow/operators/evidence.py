"""What an answer is built on: two ranked lists and their parents, memory hits, tags of entities, reports of failures."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import small_side
from .corpus import keep_first
from .dictionary import first_match, merge_entities
from .retrieval import expand_parents, rerank, top_k

# Words by which a text is placed in a region and given a priority, in order.
REGIONS = {
    "anterior": ("cornea", "lens", "conjunctiva", "iris", "anterior chamber", "ciliary body", "sclera", "pupil", "angle", "aqueous"),
    "posterior": ("retina", "macula", "vitreous", "optic nerve", "choroid", "posterior pole", "fovea", "optic disc", "vasculature"),
    "adnexa": ("eyelid", "lacrimal", "orbit", "extraocular muscle", "nasolacrimal"),
}
PRIORITIES = {
    "A": ("acute angle closure", "trauma", "chemical burn", "perforation", "sudden vision loss", "central retinal artery occlusion", "endophthalmitis"),
    "B": ("diabetic retinopathy", "retinal detachment", "uveitis", "corneal ulcer", "macular edema"),
    "C": ("cataract", "pterygium", "refractive error", "dry eye"),
}
#: Kinds of entities that only the person asking can report.
OWNED = ("symptom", "finding", "imaging", "condition")


def keyword_table(spark, groups: Mapping[str, tuple[str, ...]]) -> DataFrame:
    rows = [(g, i, j, k) for i, (g, words) in enumerate(groups.items()) for j, k in enumerate(words)]
    return spark.createDataFrame(rows, "group string, group_ord int, kw_ord int, keyword string")


def tagged(entities: DataFrame, key: str, text: str, parents: DataFrame) -> DataFrame:
    """key, region, priority: by the first group with a keyword in the text; else the region of its parent (text, anatomy)."""
    regions, priorities = keyword_table(entities.sparkSession, REGIONS), keyword_table(entities.sparkSession, PRIORITIES)
    own = first_match(entities, key, text, regions, "unspecified").withColumnRenamed("group", "_own")
    up = entities.select(key, F.lower(text).alias("_t")).join(small_side(parents.select(F.col("text").alias("_t"), "anatomy")), "_t").select(key, "anatomy")
    up = first_match(up, key, "anatomy", regions, "unspecified").withColumnRenamed("group", "_up")
    urgent = first_match(entities, key, text, priorities, "unspecified").withColumnRenamed("group", "priority")
    region = F.when(F.col("_own") != "unspecified", F.col("_own")).otherwise(F.coalesce("_up", F.lit("unspecified")))
    return own.join(up, key, "left").join(urgent, key).select(key, region.alias("region"), "priority")


def merge_hits(lists: DataFrame, docs: DataFrame, parent_of: Column, chars: int = 120) -> DataFrame:
    """Hits (item_id, doc_id, list_no, rank) of several lists, earlier lists first; of equal parent and beginning the first."""
    heads = docs.select("doc_id", F.left("text", F.lit(chars)).alias("_head"))
    own = lists.join(heads, "doc_id").withColumn("_parent", parent_of)
    own = keep_first(own, ["item_id", "_parent", "_head"], ["list_no", "rank"])
    w = Window.partitionBy("item_id").orderBy("list_no", "rank")
    return own.select("item_id", "doc_id", F.row_number().over(w).cast("long").alias("rank"))


def surviving(hits: DataFrame, noisy: Column, key: str = "item_id") -> DataFrame:
    """Hits that are not noisy; all of a key's hits where no other would be left."""
    w = Window.partitionBy(key)
    own = hits.withColumn("_noisy", noisy)
    return own.withColumn("_clean", F.count_if(~F.col("_noisy")).over(w)).where(~F.col("_noisy") | (F.col("_clean") == 0)).drop("_noisy", "_clean")


def ask_context(refined: DataFrame, raw: DataFrame, fallback: DataFrame, docs: DataFrame, queries: DataFrame, parent_of: Column, k: int = 3) -> DataFrame:
    """item_id, parent_id, doc_id, parent_rank: refined hits and then raw ones, reranked, the first of each parent; ``fallback`` for questions without any."""

    def parents(hits: DataFrame) -> DataFrame:
        return expand_parents(rerank(hits, queries, docs, max(2 * k, 4)), parent_of, k)

    both = refined.select("item_id", "doc_id", F.lit(0).alias("list_no"), "rank").unionByName(raw.select("item_id", "doc_id", F.lit(1).alias("list_no"), "rank"))
    found = parents(merge_hits(both, docs, parent_of))
    return found.unionByName(parents(fallback.join(found.select("item_id").distinct(), "item_id", "left_anti")))


def memory_context(hits: DataFrame, n: int = 6) -> DataFrame:
    """subject, terms, block, loci of memory hits (subject, room, type, value, confidence, distance, answer, ord).

    Of a room, type and value the first hit counts; the ``n`` nearest are kept; terms of answers come after all others.
    """
    best = top_k(keep_first(hits.where(F.trim("value") != ""), ["subject", "room", "type", "value"], ["ord"]), "subject", [F.asc("distance"), F.asc("ord")], n)
    line = F.format_string("- %s: %s (%s, conf %.2f)", "type", "value", "room", "confidence")
    rows = best.groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("rank", "value", "answer", line.alias("line")))).alias("h"))
    values = F.transform("h", lambda x: x["value"])
    first = F.filter("h", lambda x, i: F.array_position(values, x["value"]) == i + 1)
    terms = F.concat(F.filter(first, lambda x: ~x["answer"]), F.filter(first, lambda x: x["answer"]))
    block = F.concat(F.lit("PAST CLINICAL RECORDS:\n"), F.array_join(F.transform("h", lambda x: x["line"]), "\n"))
    return rows.select("subject", F.array_join(F.transform(F.slice(terms, 1, n), lambda x: x["value"]), " ").alias("terms"), block.alias("block"), F.size("h").alias("loci"))


def turn_entities(entities: DataFrame, key: list[str], weight: Column) -> DataFrame:
    """Entities of questions and answers (key, name, type, source, confidence, turn) weighted by source and merged; answers don't report what is the person's own."""
    own = entities.where(~((F.col("source") == "answer") & F.col("type").isin(*OWNED)))
    own = own.withColumn("confidence", F.round(F.greatest(F.least(F.col("confidence") * weight, F.lit(1.0)), F.lit(0.0)), 6))
    return merge_entities(own, [*key, "name", "type"])


def capped(items: DataFrame, key: str, kind: str, caps: Mapping[str, int], stable: Column) -> DataFrame:
    """The surest stable rows of each kind, as many as ``caps`` allows."""
    most = F.element_at(F.create_map(*[F.lit(x) for p in caps.items() for x in p]), F.col(kind))
    w = Window.partitionBy(key, kind).orderBy(F.desc("confidence"), "value")
    # the bound that is the same for all kinds lets Spark cut before the shuffle
    own = items.where(stable & F.col(kind).isin(*caps)).withColumn("place", F.row_number().over(w)).where(F.col("place") <= max(caps.values()))
    return own.where(F.col("place") <= most)


def case_report(cases: DataFrame, section: str, order: list[Column], line: Column, most: int = 5) -> DataFrame:
    """section, place, line: the first cases of each section of a report."""
    return top_k(cases.withColumn("_line", line), section, order, most, "place").select(section, F.col("place").cast("long").alias("place"), F.col("_line").alias("line"))
