"""A graph of structures as tables: lay words and aliases in texts, facts, contradictions, rooms and votes of regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import small_side
from .automaton import needle, phrase_hits

#: The room of each structure.
ROOMS = {
    "anterior_segment": "cornea iris pupil lens anterior_chamber conjunctiva sclera anterior_segment aqueous_humor epithelium stroma endothelium bowman_layer descemet_membrane posterior_chamber".split(),
    "posterior_segment": "retina macula fovea optic_disc optic_nerve choroid vitreous vitreous_humor vitreous_chamber posterior_segment rpe photoreceptors".split(),
    "adnexa": "eyelids lacrimal_system extraocular_muscles adnexa".split(),
}
IDENTITY = r"(same as|is the same as|are the same as|equivalent to|identical to|equals?)"
PRIORITIES = ("routine", "soon", "urgent", "emergency")


def structures(texts: DataFrame, key: str, text: str, aliases: DataFrame) -> DataFrame:
    """Distinct ``key, structure`` of the aliases (``phrase, structure``) that a text holds; lay phrases may name several."""
    d = aliases.select("structure", needle("phrase").alias("needle"))
    return phrase_hits(texts, [key], text, aliases, "phrase").join(small_side(d), "needle").select(key, "structure").distinct()


def facts(found: DataFrame, key: str, facts_of: DataFrame, most: int = 8) -> DataFrame:
    """The first facts of the structures found, by structure and order: ``key, rank, fact``."""
    both = found.join(small_side(facts_of), "structure").groupBy(key, "fact").agg(F.min(F.struct("structure", "fact_no")).alias("at"))
    w = Window.partitionBy(key).orderBy("at", "fact")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select(key, "rank", "fact")


def contradictions(texts: DataFrame, key: str, text: str, rules: DataFrame, different: DataFrame) -> DataFrame:
    """Distinct ``key, message``: a rule's pattern fits and its exemption doesn't, or a text calls two different structures the same."""
    own = texts.select(key, F.lower(text).alias("probe"))
    broken = own.join(small_side(rules), F.regexp_like("probe", F.col("pattern"))).where(F.col("exempt").isNull() | ~F.regexp_like("probe", F.col("exempt")))
    pair = lambda a, b: F.concat(F.lit(r"\b"), a, F.lit(rf"\b[^.]{{0,40}}{IDENTITY}[^.]{{0,40}}\b"), b, F.lit(r"\b"))
    a, b = F.col("a"), F.col("b")
    # only texts that hold both names are compared with the pattern of a pair
    pairs = different.select("a", "b", needle("a").alias("needle"), needle("b").alias("other"))
    names = pairs.select(F.explode(F.array("needle", "other")).alias("name"))
    held = phrase_hits(texts, [key], text, names, "name").groupBy(key).agg(F.collect_set("needle").alias("held"))
    both = held.select(key, "held", F.explode("held").alias("needle")).join(small_side(pairs), "needle").where(F.array_contains("held", F.col("other")))
    same = both.select(key, "a", "b").join(own, key).where(F.regexp_like("probe", F.concat_ws("|", pair(a, b), pair(b, a))))
    told = F.concat(F.initcap("a"), F.lit(" is anatomically different from "), F.initcap("b"), F.lit("."))
    return broken.select(key, "message").unionByName(same.select(key, told.alias("message"))).distinct()


def room_of(c):
    """The room of a structure; null for an unknown one."""
    token = F.replace(F.lower(F.trim(c)), F.lit(" "), F.lit("_"))
    out = F.lit(None).cast("string")
    for room, names in ROOMS.items():
        out = F.when(token.isin(names), room).otherwise(out)
    return out


def resolved_room(*candidates):
    """The room of the first candidate (structure, place, focus) that has one."""
    return F.coalesce(*[room_of(c) for c in candidates])


def keep_first_union(*arrays):
    """The distinct items of arrays in the order in which they come."""
    return F.array_distinct(F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays]))


def mismatch(asked, answered):
    """Both name structures and share none."""
    return (F.size(asked) > 0) & (F.size(answered) > 0) & ~F.arrays_overlap(asked, answered)


def region_votes(hits: DataFrame, key: str, least: float = 0.5) -> DataFrame:
    """The region with the highest sum of confidences, where that exceeds ``least``; ties go to the first by name."""
    total = hits.groupBy(key, "region").agg(F.round(F.sum("confidence"), 9).alias("votes"))
    w = Window.partitionBy(key).orderBy(F.desc("votes"), "region")
    best = total.withColumn("n", F.row_number().over(w)).where("n = 1")
    return best.select(key, F.when(F.col("votes") > least, F.col("region")).alias("region"), "votes")


def escalated(turns: DataFrame, key: str, turn: str, priority: str) -> DataFrame:
    """The highest priority so far, in the order of ``PRIORITIES``."""
    rank = F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), F.col(priority))
    top = F.max(rank).over(Window.partitionBy(key).orderBy(turn).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return turns.withColumn("so_far", F.element_at(F.array(*[F.lit(p) for p in PRIORITIES]), top.cast("int")))
