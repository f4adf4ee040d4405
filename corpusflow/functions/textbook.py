"""Textbooks as markdown: real headings are recovered from what a page's layout left, all else that looks like one goes."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of lines, for books whose chapters are headings of level 4 ...
NUMBER_HEADING = r"^#{1,6}\s+\d+\s*$"
CHAPTER_HEADING = r"^####\s+([A-Za-z][A-Za-z\s\-',()]+)$"
OTHER_HEADING = r"^#{1,6}\s+[^A-Za-z#].*$"
RUNNING_LINE = r"^CHAPTER\s*$"
PAGED_TOPIC = r"^[A-Z][a-z].*\d+\s*$"
SECTION_LINE = r"^([A-Z][a-z]+(?:\s+[a-z]+)*)\s*$"
# ... for books whose chapters stand in running heads ...
ANY_HEADING = r"^#{1,6}\s+.*$"
RUNNING_HEAD = r"^CHAPTER\s+(\d+)\s+(.+?)(?:\s+(?:_?\*\*|\d+\s*$))"
RUNNING_HEAD_LINE = r"^CHAPTER\s+\d+\s+.+$"
BOLD_CAPITALS = r"^\*\*([A-Z][A-Z\s()\-,.]{3,})\*\*$"
# ... and for both.
FIGURE = r"^(?:_?\*?\*?)?Fig\.?\s*\*?\*?\s*[\d.]+.*$"
EMPTY_BOLD = r"\*\*\s*\*\*"
BLANK_LINES = r"\n{3,}"


def by_headings(c: Column) -> Column:
    """Chapters are headings of level 4 that have words (level 1 here), sections are lines of one capitalised word and small ones (level 2).

    Headings of numbers, running heads, topics with a page number and captions of figures go. Null stays null.
    """
    steps = (
        (NUMBER_HEADING, ""), (CHAPTER_HEADING, "\n# $1\n"), (OTHER_HEADING, ""), (RUNNING_LINE, ""), (PAGED_TOPIC, ""), (SECTION_LINE, "\n## $1\n"), (FIGURE, ""),
    )
    out = reduce(lambda x, s: F.regexp_replace(x, f"(?md){s[0]}", s[1]), steps, c)
    out = F.regexp_replace(F.regexp_replace(out, EMPTY_BOLD, ""), BLANK_LINES, "\n\n")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def chapters(text: str) -> dict[int, str]:
    """The name of each chapter that running heads give, kept first per number; names of up to three letters don't count."""
    out: dict[int, str] = {}
    for number, name in re.findall(RUNNING_HEAD, text, re.M):
        name = re.sub(r"\s+\d+\s*$", "", name.rstrip("*_").strip()).strip()
        if len(name) > 3:
            out.setdefault(int(number), name.title())
    return out


def recovered(text: str) -> str:
    """One text of ``by_running_heads``."""
    bare = re.sub(ANY_HEADING, "", text, flags=re.M)
    names = chapters(bare)
    body = re.sub(RUNNING_HEAD_LINE, "", bare, flags=re.M)
    body = re.sub(BOLD_CAPITALS, lambda m: f"\n## {m[1].strip().title()}\n", body, flags=re.M)
    for number in sorted(names):
        at = body.find(f"## {names[number]}")
        if at >= 0:
            body = f"{body[:at]}\n# Chapter {number}: {names[number]}\n\n{body[at:]}"
    body = re.sub(EMPTY_BOLD, "", re.sub(FIGURE, "", body, flags=re.M))
    return re.sub(BLANK_LINES, "\n\n", body).strip()


def by_running_heads(c: Column) -> Column:
    """Bold lines of capitals are sections (level 2); before the first one that begins with a chapter's name, as running heads give
    it, the chapter's heading is inserted (level 1). All other headings, running heads and captions of figures go. Null stays null."""

    @F.pandas_udf("string")
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(recovered, na_action="ignore")

    return apply(c)
