"""Cases of several sessions, replayed in order: what memory carries from one session to the next, and what answers make of it.

Each turn is a session of its own, so nothing but the person's memory goes on. The memory before a turn is that of the turns before
it, folded by the rules of the stored memory; answers and their measures come after, for all turns of all cases at once.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import coverage, filtered_mean, rouge_l
from .memory import EXCLUSIVE, recorded


def carried(turns: DataFrame, n: int = 6) -> DataFrame:
    """subject, turn, memory: the values that are active before each turn of rows (subject, turn, entities), the surest ``n`` first.

    ``entities``: array<struct<room,type,value,confidence>>, may be null. Turns of a subject are folded together; there are few.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        loci: dict[tuple[str, str], list[tuple]] = {}
        out, at = [], 0
        for r in rows.sort_values("turn").itertuples(index=False):
            active = [x for own in loci.values() for x in own if x[5] == -1]
            out.append((r.subject, r.turn, [x[0] for x in sorted(active, key=lambda x: (-x[1], -x[4], x[0]))[:n]]))
            for e in r.entities if r.entities is not None else ():
                if not (e["value"] or "").strip() or e["confidence"] is None:
                    continue
                key, at = (e["room"] or "", e["type"] or ""), at + 1
                loci[key] = recorded(loci.get(key, []), [(at, e["value"], e["confidence"])], key[1] in EXCLUSIVE and key[0] != "")
        return pd.DataFrame(out, columns=["subject", "turn", "memory"])

    own = turns.select(F.col("subject").cast("string").alias("subject"), F.col("turn").cast("long").alias("turn"), "entities").where("subject IS NOT NULL")
    return own.groupBy("subject").applyInPandas(fold, "subject string, turn bigint, memory array<string>")


def replayed(turns: DataFrame, answer: Callable[[DataFrame], DataFrame], n: int = 6) -> DataFrame:
    """``turns`` (subject, turn, question, reference, keywords, entities) with memory, answer, and for turns after a subject's first
    coverage (of the keywords, 1 for none) and rouge_l; null for first turns. ``answer`` adds a column of that name."""
    own = turns.withColumns({"subject": F.col("subject").cast("string"), "turn": F.col("turn").cast("long")})
    own = answer(own.join(carried(own, n), ["subject", "turn"])).join(own.groupBy("subject").agg(F.min("turn").alias("_first")), "subject")
    later = F.col("turn") > F.col("_first")
    words = F.coalesce("keywords", F.array().cast("array<string>"))
    text = F.coalesce("answer", F.lit(""))
    covered = F.round(coverage(text, F.transform(words, F.lower), 1.0), 4)
    return own.withColumns({"coverage": F.when(later, covered), "rouge_l": F.when(later, rouge_l(text, F.coalesce("reference", F.lit(""))))}).drop("_first")


def compared(runs: DataFrame, backend: str = "backend") -> DataFrame:
    """Means of the measures of each backend over turns after the first, and how many there were."""
    return runs.where("coverage IS NOT NULL").groupBy(backend).agg(filtered_mean(F.col("coverage")).alias("mean_coverage"), filtered_mean(F.col("rouge_l")).alias("mean_rouge_l"), F.count(F.lit(1)).alias("scored"))
