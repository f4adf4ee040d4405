"""Line cleaners, transcripts, findings, notes and prompt blocks: expressions over text columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_text, normalize_for_hash

# Lines, phrases and patterns that results depend on.
GUIDELINE_EXACT = ("secretary for quality of care", "academy staff", "medical editor:", "approved by:", "board of trustees", "skip to main content")
GUIDELINE_DROP = (
    r"^P\d+\s*$",
    r"^[A-Za-z][A-Za-z\s\-&,']+\s+PPP\s+P\d+\s*$",
    r"^©\s*\d{4}\s+American Academy of Ophthalmology",
    r"^All rights reserved\s*$",
    r"^AMERICAN ACADEMY OF OPHTHALMOLOGY.+registered trademarks",
    r"^Preferred Practice Pattern®?\s*$",
)
GUIDELINE_ANCHORS = ("highlighted findings and recommendations", "major recommendations", "patient population", "introduction", "disease definition", "care process", "diagnosis", "management", r"follow[- ]?up", "patient education")
GUIDELINE_TAILS = ("literature searches for this ppp", "appendix", "references")
MANUAL_CONTAINS = ("view patient education", "drug information for the topic", "test your knowledge", "take a quiz", "cookie preferences", "all rights reserved")
MANUAL_TAILS = ("drug information for the topic", "test your knowledge", "cookie preferences", "copyright")
MANUAL_DROP = (r"^v\d+$", r"^(?:image|table|video|audio)$", r"^by\s+.+\b(md|do|phd|mbbs)\b", r"^reviewed(?:/revised)?\b")
TRANSCRIPT_STOCK = (r"thank you for watching\.?", r"thanks for watching\.?", r"please subscribe\.?", r"like and subscribe\.?", r"see you in the next video\.?", r"^\s*you\s*$")
ADVICE = (
    "consult your doctor", "see a specialist", "seek professional", "healthcare provider", "seek medical attention", "please visit", "go to the emergency",
    "automated screening findings", "preliminary findings", "only a professional eye", "evaluation by a qualified", "perform a comprehensive eye exam", "healthy lifestyle choices",
)
LEAD_INS = ("based on the provided medical reference texts, ", "based on the medical reference texts, ", "according to the texts, ", "the oct images show ")
ENTITY_TYPES = {"treatment": "medication", "drug": "medication", "surgery": "procedure", "test": "imaging", "sign": "finding"}
CONDITION = r"[●○]\s*(Probable|Possible):\s*(.+?)\s*\((\d+\.?\d*)%\)"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lines_of(c: Column) -> Column:
    return F.transform(F.split(clean_text(F.coalesce(c, F.lit(""))), "\n"), stripped)


def first_line(lines: Column, pattern: str) -> Column:
    """Place, from 0, of the first line that fits in lower case; -1 where none does."""
    return F.array_position(F.transform(lines, lambda x: F.lower(x).rlike(pattern)), True).cast("int") - 1


def joined(lines: Column) -> Column:
    """The lines with one blank line at most between others."""
    return stripped(F.array_join(F.filter(lines, lambda x, i: (x != "") | (i == 0) | (F.get(lines, i - 1) != "")), "\n"))


def guideline_text(c: Column, anchors: Sequence[str] = GUIDELINE_ANCHORS, tails: Sequence[str] = GUIDELINE_TAILS, anchor_within: int = 350, tail_after: int = 120) -> Column:
    """A guideline without front matter (up to the first anchor, if it comes early), running lines and a late tail."""
    kept = F.filter(lines_of(c), lambda x: (x == "") | ~(F.lower(x).isin(*GUIDELINE_EXACT) | x.rlike("(?i)" + "|".join(GUIDELINE_DROP))))

    def from_anchor(l: Column) -> Column:
        at = first_line(l, "|".join(anchors))
        return F.when((at >= 0) & (at < anchor_within), F.slice(l, F.greatest(at, F.lit(0)) + 1, F.greatest(F.size(l), F.lit(1)))).otherwise(l)

    def to_tail(l: Column) -> Column:
        at = first_line(l, "|".join(tails))
        return F.when(at > tail_after, F.slice(l, F.lit(1), F.greatest(at, F.lit(0)))).otherwise(l)

    return let(let(let(kept, from_anchor), to_tail), joined)


def manual_text(c: Column) -> Column:
    """A manual's page up to its tail, without links, media, bylines and lines that repeat the one before."""

    def to_tail(l: Column) -> Column:
        at = first_line(l, "|".join(MANUAL_TAILS))
        return F.when(at >= 0, F.slice(l, F.lit(1), F.greatest(at, F.lit(0)))).otherwise(l)

    def dropped(x: Column) -> Column:
        return F.lower(x).rlike("|".join(MANUAL_CONTAINS)) | (F.contains(x, F.lit("|")) & (F.length(x) <= 90)) | F.lower(x).rlike("|".join(MANUAL_DROP))

    def without_repeats(l: Column) -> Column:
        spoken = F.filter(F.transform(l, lambda x, i: F.struct(i.alias("i"), normalize_for_hash(x).alias("n"))), lambda s: s["n"] != "")

        def places(s: Column) -> Column:
            again = F.filter(F.transform(s, lambda x, j: F.struct(x["i"].alias("i"), ((F.length(x["n"]) > 24) & (j > 0) & F.coalesce(F.get(s, j - 1)["n"] == x["n"], F.lit(False))).alias("again"))), lambda x: x["again"])
            return F.transform(again, lambda x: x["i"])

        return let(let(spoken, places), lambda bad: F.filter(l, lambda x, i: ~F.array_contains(bad, i)))

    kept = F.filter(let(lines_of(c), to_tail), lambda x: (x == "") | ~dropped(x))
    return let(let(kept, without_repeats), joined)


def transcript(c: Column) -> Column:
    """A transcript without stock phrases; a phrase of 2 to 14 words that it begins with three times or more stands once."""
    own = F.regexp_replace(F.coalesce(c, F.lit("")), "(?i)" + "|".join(TRANSCRIPT_STOCK), "")

    def collapse(w: Column) -> Column:
        text = F.array_join(w, " ")
        loop = lambda p: F.concat(F.lit(r"^(?i)(?:\Q"), p, F.lit(r"\E ?){3,}"))
        phrases = F.transform(F.sequence(F.lit(2), F.greatest(F.least(F.floor(F.size(w) / 2).cast("int"), F.lit(14)), F.lit(2))), lambda n: F.array_join(F.slice(w, F.lit(1), n), " "))
        fit = F.when(F.size(w) > 6, F.get(F.filter(phrases, lambda p: F.regexp_like(text, loop(p))), F.lit(0)))
        return let(fit, lambda p: F.when(p.isNotNull(), stripped(F.concat(p, F.lit(" "), F.regexp_replace(text, loop(p), F.lit(""))))))

    looped = let(F.array_remove(F.split(own, r"\s+"), ""), collapse)
    return stripped(F.coalesce(looped, own))


def findings(c: Column) -> Column:
    """modality and conditions (name, confidence, score) of the text of an image's findings."""
    part = lambda i: F.regexp_extract_all(c, F.lit(CONDITION), F.lit(i))
    rows = F.transform(F.arrays_zip(part(1).alias("k"), part(2).alias("n"), part(3).alias("p")), lambda x: F.struct(x["n"].alias("name"), F.lower(x["k"]).alias("confidence"), (x["p"].cast("double") / 100).alias("score")))
    modality = F.nullif(F.regexp_extract(c, r"Detected Image Type:\s*(\S+)", 1), F.lit(""))
    return F.struct(modality.alias("modality"), rows.alias("conditions"))


def finding_terms(found: Column, most: int = 2) -> Column:
    """The modality and the first probable conditions, for retrieval; empty where no condition was found."""
    names = F.transform(F.slice(F.filter(found["conditions"], lambda x: x["confidence"] == "probable"), 1, most), lambda x: x["name"])
    return F.when(F.size(found["conditions"]) > 0, F.array_join(F.concat(F.array_compact(F.array(found["modality"])), names), " ")).otherwise("")


def note(c: Column) -> dict[str, Column]:
    """What a memory's text says: entity_type, value, normalized_value, confidence, source, with defaults."""
    part = lambda p: F.lower(stripped(F.regexp_extract(c, p, 1)))
    value = stripped(F.regexp_extract(c, r"(?i)Value:\s*([^.]+)", 1))
    blank = F.lit("")
    return {
        "entity_type": F.coalesce(F.nullif(part(r"(?i)Entity type:\s*([a-z_]+)"), blank), F.lit("entity")),
        "value": F.coalesce(F.nullif(value, blank), F.lit("unknown")),
        "normalized_value": F.lower(value),
        "confidence": F.coalesce(F.nullif(F.regexp_extract(c, r"(?i)Confidence:\s*([0-9]*\.?[0-9]+)", 1), blank).cast("double"), F.lit(0.0)),
        "source": part(r"(?i)Source:\s*([^.]+)"),
    }


ENTITY_JSON = "array<struct<text:string,entity_type:string,confidence:double,region:string,priority:string>>"


def entities_said(c: Column, least: float = 0.5) -> Column:
    """Entities of a model's answer: from the first ``[`` to the last ``]``, else the first object; sure ones with known types and defaults."""
    held = F.regexp_extract(c, r"(?s)\[.*\]", 0)
    one = F.regexp_extract(c, r"(?s)\{.*?\}", 0)
    rows = F.from_json(F.when(held != "", held).when(one != "", F.concat(F.lit("["), one, F.lit("]"))), ENTITY_JSON)
    sure = F.filter(F.coalesce(rows, F.array().cast(ENTITY_JSON)), lambda x: x["text"].isNotNull() & (F.coalesce(x["confidence"], F.lit(0.0)) >= least))

    def typed(x: Column) -> Column:
        kind = F.lower(F.coalesce(x["entity_type"], F.lit("finding")))
        known = reduce(lambda out, e: F.when(kind == e[0], e[1]).otherwise(out), ENTITY_TYPES.items(), kind)
        return F.struct(x["text"].alias("text"), known.alias("entity_type"), x["confidence"].alias("confidence"), F.coalesce(x["region"], F.lit("unspecified")).alias("region"), F.coalesce(x["priority"], F.lit("unspecified")).alias("priority"))

    return F.transform(sure, typed)


def claim_lines(c: Column) -> Column:
    """Lines to be judged by inference: over 15 characters, no headings and no advice, without lead-ins."""

    def bare(x: Column) -> Column:
        return reduce(lambda y, p: F.when(F.lower(y).startswith(p), stripped(F.substr(y, F.lit(len(p) + 1)))).otherwise(y), LEAD_INS, x)

    lines = F.transform(F.split(c, "\n"), stripped)
    return F.transform(F.filter(lines, lambda x: (F.length(x) > 15) & ~x.endswith(":") & ~F.lower(x).rlike("|".join(ADVICE))), bare)


def is_boilerplate(chapter: Column, section: Column, text: Column, of_chapter: str, sections: Sequence[str], signals: Sequence[str]) -> Column:
    """Chunks of one chapter that its section's name or a phrase in the text shows to be boilerplate."""
    said = lambda c, phrases: F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(F.lower(F.coalesce(c, F.lit(""))), p))
    return F.coalesce(F.lower(chapter) == of_chapter, F.lit(False)) & (said(section, sections) | said(text, signals))


def profile_block(fields: Mapping[str, Column]) -> Column:
    """Bullet lines of what is known of a person; empty where nothing is."""
    line = lambda k, v: F.when(F.coalesce(v.cast("string"), F.lit("")) != "", F.concat(F.lit(f"- {k.replace('_', ' ').title()}: "), v.cast("string")))
    body = F.array_join(F.array_compact(F.array(*[line(k, v) for k, v in fields.items()])), "\n")
    return F.when(body != "", F.concat(F.lit("PATIENT PROFILE (use this to personalize your advice):\n"), body, F.lit("\n\n"))).otherwise("")


def history_block(turns: Column, older: int = 5) -> Column:
    """Up to two questions as they are; of more, the last two after bullets of the ``older`` before them."""
    said = lambda a: F.array_join(F.transform(a, lambda q: F.concat(F.lit("Patient: "), q)), "\n")
    n = F.size(turns)
    start = F.greatest(n - 2 - older, F.lit(0)) + 1
    before = F.slice(turns, start, F.greatest(n - 2 - start + 1, F.lit(0)))
    summary = F.concat(F.array_join(F.transform(before, lambda q: F.concat(F.lit("- "), q)), "\n"), F.lit("\n"))
    last = F.slice(turns, F.greatest(n - 1, F.lit(1)), F.lit(2))
    return F.when(n == 0, "").when(n <= 2, F.concat(said(turns), F.lit("\n\n"))).otherwise(F.concat(summary, said(last), F.lit("\n\n")))
