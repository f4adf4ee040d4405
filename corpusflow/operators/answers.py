"""Answers: given again where they fail, rewritten where they contradict known structures, and read as the choice of an option.

Models are arguments: functions of columns, or of a table where they need more than a row. They are called on the rows that
need them alone: what is decided before is written first, so nothing is answered twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from ..session import cut

#: Fixed value: what an answer is told that failed without a claim to name.
NO_CLAIM = "- Unspecified claims not supported by sources"
#: An answer that contradicts what is known, and still does after it was rewritten, is replaced by such a notice.
NOTICE = "The answer may be inconsistent about the anatomy of the eye. Please have your eyes examined in person, above all if there is pain, redness that stays, or a sudden change of vision."
#: Fixed value: the least score of a choice.
SURE = 0.4


def answered(questions: DataFrame, key: str, answer: Callable[[DataFrame], DataFrame], judge: Callable[[DataFrame], DataFrame], retries: int = 1) -> DataFrame:
    """``questions`` with ``answer, verdict, flagged, retries``: those whose verdict is FAIL are answered again, ``retries`` times at most.

    ``answer`` adds a column of that name to rows with a column ``correction`` (null at first, then a line for each claim that was
    flagged); ``judge`` adds verdict and flagged (an array of claims, may be null). Both see the rows to be answered only. A key is a row's own.
    """

    def attempt(rows: DataFrame, correction: Column, n: int) -> DataFrame:
        own = rows.select(*questions.columns, correction.alias("correction"))
        return judge(answer(own)).select(*questions.columns, "answer", "verdict", "flagged", F.lit(n).cast("long").alias("retries"))

    done = cut(attempt(questions, F.lit(None).cast("string"), 0))
    for n in range(1, retries + 1):
        failed = done.where("verdict = 'FAIL'")
        if failed.isEmpty():
            break
        lines = F.array_join(F.transform("flagged", lambda c: F.concat(F.lit("- "), c)), "\n")
        again = attempt(failed, F.coalesce(F.nullif(lines, F.lit("")), F.lit(NO_CLAIM)), n)
        done = cut(done.where("verdict IS DISTINCT FROM 'FAIL'").unionByName(again))
    return done


def guarded(answers: DataFrame, key: str, contradictions: Callable[[DataFrame], DataFrame], rewrite: Callable[[DataFrame], DataFrame], notice: str = NOTICE) -> DataFrame:
    """``answers`` (key, answer) with ``final`` and ``guard``: kept, rewritten or withheld.

    ``contradictions`` gives distinct ``key, message`` of rows (key, answer); rows with any are given, with ``issues`` (a line each), to
    ``rewrite``, which adds ``corrected``. An empty one keeps the answer, one that contradicts still is withheld.
    """
    found = contradictions(answers.select(key, "answer")).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_set("message")), lambda m: F.concat(F.lit("- "), m)), "\n").alias("issues"))
    own = cut(answers.join(found, key, "left"))
    bad = own.where("issues IS NOT NULL")
    new = cut(rewrite(bad).select(key, F.trim("corrected").alias("corrected")).where("corrected != ''"))
    still = contradictions(new.select(key, F.col("corrected").alias("answer"))).select(key, F.lit(True).alias("_still")).distinct()
    out = own.join(new.join(still, key, "left"), key, "left")
    guard = F.when(F.col("corrected").isNull(), "kept").when(F.col("_still"), "withheld").otherwise("rewritten")
    out = out.withColumn("guard", guard)
    final = F.when(F.col("guard") == "kept", F.col("answer")).when(F.col("guard") == "withheld", notice).otherwise(F.col("corrected"))
    return out.select(*answers.columns, final.alias("final"), "guard")


def option_text(c: Column) -> Column:
    """An option without its letter (A to E) and point."""
    return F.trim(F.when(c.rlike(r"^[A-E]\."), F.substring(c, 4, 2**31 - 1)).otherwise(c))


def share_said(answer: Column, option: Column) -> Column:
    """Share of an option's distinct words that the answer has: the default scorer."""
    own = F.array_distinct(words(option))
    return F.size(F.array_intersect(own, words(answer))) / F.greatest(F.size(own), F.lit(1))


def picked(answer: Column, options: Column, score: Callable[[Column, Column], Column] = share_said, least: float = SURE) -> Column:
    """The place (from 0) of the option of highest score, the first of equals, if that is above ``least``; null for no option or a blank answer."""
    scores = F.transform(options, lambda o: score(answer, option_text(o)))
    best = F.array_max(scores)
    return F.when((F.trim(answer) != "") & (best > least), F.array_position(scores, best) - 1).cast("long")
