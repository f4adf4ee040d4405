"""Whether answers are grounded in their sources: claims against overlapping windows of the context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import split_sentences, words

SUPPORTED, UNSUPPORTED, FAIL_SHARE = 0.35, 0.10, 0.5
#: An answer that is short and says one of these refuses.
REFUSALS = ("i don't know", "cannot answer", "not enough information", "no relevant information")


def claims(answers: DataFrame, key: str, text: str) -> DataFrame:
    """Sentences of at least 25 characters and five words outside headings, the first of equals."""
    lines = answers.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).where(F.trim("line") != "").where(~F.col("line").rlike(r"^\s*#"))
    own = lines.select(key, "line_no", F.posexplode(split_sentences(F.col("line"))).alias("pos", "claim"))
    own = own.where((F.length(F.trim("claim")) >= 25) & (F.size(words(F.col("claim"))) > 4))
    own = own.withColumn("claim", F.regexp_replace(F.trim("claim"), r"^[-*•]\s*", ""))
    w = Window.partitionBy(key, F.lower("claim")).orderBy("line_no", "pos")
    return own.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(key, "line_no", "pos", "claim")


def windows(contexts: DataFrame, key: str, text: str, size: int = 400, step: int = 320) -> DataFrame:
    """Overlapping windows of words; none begins after one that reached the end."""
    own = contexts.select(key, words(F.col(text)).alias("_w")).where(F.size("_w") > 0)
    last = F.greatest(F.ceil((F.size("_w") - size) / step), F.lit(0)).cast("int")
    own = own.select(key, "_w", F.explode(F.sequence(F.lit(0), last)).alias("window_no"))
    return own.select(key, "window_no", F.slice("_w", F.col("window_no") * step + 1, size).alias("window"))


def overlap(claim: Column, window: Column) -> Column:
    """Share of the claim's distinct words in the window: the default scorer."""
    c = F.array_distinct(words(claim))
    return F.round(F.size(F.array_intersect(c, window)) / F.greatest(F.size(c), F.lit(1)), 6)


def claim_scores(own_claims: DataFrame, own_windows: DataFrame, key: str, scorer=overlap) -> DataFrame:
    """The best window of each claim, joined by key."""
    both = own_claims.join(own_windows, key, "left").withColumn("s", F.coalesce(scorer(F.col("claim"), F.col("window")), F.lit(0.0)))
    return both.groupBy(key, "line_no", "pos").agg(F.max("s").alias("score"))


def verdicts(answers: DataFrame, key: str, answer: str, context: str, scorer=overlap) -> DataFrame:
    """key, claims, unsupported, weak, verdict: refusals pass, no context fails, no claims pass."""
    scored = claim_scores(claims(answers, key, answer), windows(answers, key, context), key, scorer)
    per = scored.groupBy(key).agg(
        F.count(F.lit(1)).alias("claims"),
        F.count_if(F.col("score") <= UNSUPPORTED).alias("unsupported"),
        F.count_if((F.col("score") > UNSUPPORTED) & (F.col("score") < SUPPORTED)).alias("weak"),
    )
    refusal = (F.length(answer) < 150) & F.exists(F.array(*[F.lit(r) for r in REFUSALS]), lambda r: F.contains(F.lower(answer), r))
    out = answers.select(key, answer, context).join(per, key, "left").na.fill(0, ["claims", "unsupported", "weak"])
    verdict = (
        F.when(refusal, "PASS")
        .when(F.trim(context) == "", "FAIL")
        .when(F.col("claims") == 0, "PASS")
        .when(F.col("unsupported") / F.greatest("claims", F.lit(1)) > FAIL_SHARE, "FAIL")
        .when(F.col("unsupported") + F.col("weak") > 0, "PARTIAL")
        .otherwise("PASS")
    )
    return out.select(key, "claims", "unsupported", "weak", verdict.alias("verdict"))
