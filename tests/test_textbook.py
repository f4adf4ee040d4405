"""Textbook cleaners and the states of the sanitiser, against cases and a line-by-line version."""

import random
import re

from pyspark.sql import functions as F

from corpusflow.functions import textbook
from corpusflow.operators import corpus


def cleaned(spark, f, texts):
    return [r.x for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


def test_chapters_that_are_headings(spark):
    text = "#### 12\n#### Glaucoma\nCHAPTER\nExamination Techniques 5\nIntroduction\nBody text, long.\nFig. 1.2 A figure\n**Fig** 3 none\n## 3. junk\n** **\n\n\n\nOptic nerve\nmore"
    assert cleaned(spark, textbook.by_headings, [text, None, ""]) == ["# Glaucoma\n\n## Introduction\n\nBody text, long.\n\n## Optic nerve\nmore", None, ""]


BOOK = "# ocr noise\nCHAPTER 10 GLAUCOMA **253**\n**GLAUCOMA**\ntext\nCHAPTER 10 OTHER NAME 254\n**LENS, AND (MORE)**\nbody\nCHAPTER 9 EYE 1\nCHAPTER 2 LENS 7\n**GLAUCOMA AGAIN**\nFig. 2 gone\n\n\n\nend"


def test_chapters_from_running_heads(spark):
    assert textbook.chapters(BOOK) == {10: "Glaucoma", 2: "Lens"}  # kept first; three letters are too few
    got = cleaned(spark, textbook.by_running_heads, [BOOK, None, "", "no chapter"])
    assert got[0] == "# Chapter 10: Glaucoma\n\n## Glaucoma\n\ntext\n\n# Chapter 2: Lens\n\n## Lens, And (More)\n\nbody\n\n## Glaucoma Again\n\nend"
    assert got[1:] == [None, "", "no chapter"]


def plain_states(text, allowed):
    """Line by line: the state after each line, and whether it is a heading to be neutralised."""
    state, out = "outside", []
    for line in text.split("\n"):
        m = re.match(corpus.HEADING, line)
        title = m[2].strip() if m else ""
        ok = m and len(m[1]) == 2 and 1 <= len(title) <= 140 and len(title.split()) <= 20 and len(re.findall("[.!?;]", title)) < 3 and not re.search(r"https?://|www\.", title, re.I) and not re.search(r"[.!?]\s+[A-Z]", title)
        hit = False
        if m and len(m[1]) == 1 and title.lower() in allowed:
            state = "outside"
        elif ok:
            state = "metadata"
        elif state != "outside" and m:
            state, hit = "body", True
        elif state == "metadata" and line.strip() and not re.match(corpus.METADATA, line.strip()):
            state = "body"
        out.append((state, hit))
    return out


def test_sanitiser_states(spark):
    r = random.Random(8)
    pieces = ["# Contents", "# contents ", "# Else", "## Record", "## See http://x.y", "## One. Two. Three; four", "### deep", "*Source*: x", " *url* : y", "", "  ", "words", "##", "#x"]
    texts = [(i, "\n".join(r.choice(pieces) for _ in range(r.randrange(1, 14)))) for i in range(200)]
    got: dict = {}
    for x in corpus.sanitized_lines(spark.createDataFrame(texts, "doc_id long, text string"), ["Contents"]).orderBy("doc_id", "line_no").collect():
        got.setdefault(x.doc_id, []).append((x.state, x.neutralised))
        assert x.line.startswith("\\") == x.neutralised
    assert got == {i: plain_states(t, {"contents"}) for i, t in texts}
