"""Questions answered from beginning to end, a table of them at once: red flags, search by two wordings, a wider search where nothing was
found, prompts, answers judged and given again, notices, and which answers memory may keep.

Models are arguments. A step is computed for the questions that need it alone: those with a red flag are not searched for, only those
without hits are searched for again, only those with sources are answered, only those that fail are answered again.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import prompts
from ..functions.rules import normalize_query
from ..functions.safety import ACRONYMS, CANONICAL, NOISE, refined_query, triage_level, with_disclaimer
from ..session import cut, hint_of
from . import evidence, grounding, retrieval
from .answers import answered
from .runs import context_block

REPLIES = {
    "emergency": "This can be an emergency. Please go to an eye emergency department now.",
    "urgent": "This needs an eye doctor within 24 hours. Please don't wait for it to pass.",
    "leukocoria": "A white pupil or spot must be looked at by an eye doctor soon, within days.",
}
NOTHING = "I found no sources on this question. Please ask an eye doctor."
NOTICES = {"conflict": "Parts of this may conflict with the sources. ", "unverified": "This could not be confirmed by the sources. ", "partial": "Parts of this could not be confirmed by the sources. "}
#: Verdicts of answers that memory may keep.
KEPT = ("PASS", "PARTIAL")
OPTIONAL = {"terms": "array<string>", "facts": "array<string>", "structures": "array<string>", "profile": "string", "history": "string", "state": "string", "memory": "string", "findings": "string", "language": "string"}


def search_text(question: Column, terms: Column, cap: int = 16) -> Column:
    """The refined question with the terms of its session (array, may be null), each word once, at most ``cap``; the question where none is left."""
    both = F.concat_ws(" ", refined_query(question), F.array_join(F.coalesce(terms, F.array().cast("array<string>")), " "))
    return F.coalesce(F.nullif(normalize_query(both, CANONICAL, NOISE, (), ACRONYMS, cap), F.lit("")), question)


def two_anchors(asked: DataFrame, chunks: DataFrame, k: int, scorer: Callable, stats: DataFrame | None = None) -> DataFrame:
    """item_id, parent_id, rank of rows (item_id, search, question): hits of both wordings merged, reranked by the question, at most ``k`` parents."""
    both = cut(asked.select("item_id", F.explode(F.array(F.struct(F.lit(0).alias("no"), F.col("search").alias("text")), F.struct(F.lit(1).alias("no"), F.col("question").alias("text")))).alias("_w")).select((F.col("item_id") * 2 + F.col("_w.no")).alias("item_id"), "_w.text"))
    hits = retrieval.hybrid_top_k(chunks, both, 10, 4 * k, stats)
    hits = hits.select(F.floor(F.col("item_id") / 2).alias("item_id"), "doc_id", F.pmod("item_id", F.lit(2)).alias("list_no"), "rank")
    hits = cut(hits)
    hint = hint_of(asked, 10_000)
    own = chunks.join(hint(hits.select("doc_id").distinct()), "doc_id", "left_semi")
    own = cut(own.select("doc_id", "parent_id", "text"))  # few texts a question
    ranked = retrieval.rerank(merged_hits(hits, own), asked.select("item_id", F.col("question").alias("text")), own, 2 * k, scorer)
    found = ranked.join(own.select("doc_id", "parent_id"), "doc_id").groupBy("item_id", "parent_id").agg(F.min("rerank_rank").alias("rank"))
    w = Window.partitionBy("item_id").orderBy("rank")
    return found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).select("item_id", "parent_id", F.col("_n").cast("long").alias("rank"))


def merged_hits(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """Hits of several lists, earlier lists first; of equal parent and beginning the first."""
    own = hits.join(texts.select("doc_id", F.col("parent_id").alias("_parent")), "doc_id")
    return evidence.merge_hits(own, texts, F.col("_parent"))


def judged_by_claims(rows: DataFrame, key: str = "item_id", scorer: Callable = grounding.overlap) -> DataFrame:
    """``rows`` (key, answer, context) with verdict and flagged: the claims that no window of the context supports."""
    own = cut(rows)
    said = grounding.claims(own, key, "answer")
    scores = grounding.claim_scores(said, grounding.windows(own, key, "context"), key, scorer)
    bad = said.join(scores.where(F.col("score") <= grounding.UNSUPPORTED), [key, "line_no", "pos"])
    flagged = bad.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "pos", "claim"))), lambda c: c["claim"]).alias("flagged"))
    verdict = grounding.verdicts(own, key, "answer", "context", scorer).select(key, "verdict")
    return own.join(verdict, key).join(flagged, key, "left")


def ask(
    questions: DataFrame,
    chunks: DataFrame,
    parents: DataFrame,
    answer: Callable[[DataFrame], DataFrame],
    judge: Callable[[DataFrame], DataFrame] = judged_by_claims,
    widen: Callable[[Column], Column] | None = None,
    k: int = 3,
    retries: int = 1,
    scorer: Callable = retrieval.overlap_score,
    replies: Mapping[str, str] = REPLIES,
    notices: Mapping[str, str] = NOTICES,
) -> DataFrame:
    """One row a question: item_id, level, search, sources (array of parent_id, best first), answer, verdict, flagged, retries, remembered.

    ``questions``: item_id (an integer of its own), question, and of ``OPTIONAL`` what is known; null questions are empty. ``chunks``: doc_id (an
    integer), parent_id, text; ``parents``: parent_id, source, path, text, and structures (array) where known. ``answer`` adds a column of that name
    to rows with ``system`` and ``user``; ``judge`` adds verdict and flagged to rows (item_id, answer, context). A question with a red flag gets the
    reply of its level and verdict ``TRIAGE``; one without sources, after a search by ``widen`` of it too, ``NOTHING`` and ``N/A``.
    """
    own = questions.select("item_id", F.coalesce("question", F.lit("")).alias("question"), *[(F.col(c) if c in questions.columns else F.lit(None)).cast(t).alias(c) for c, t in OPTIONAL.items()])
    own = own.withColumn("level", triage_level(F.col("question")))
    own = cut(own.withColumn("search", F.when(F.col("level") == "none", search_text(F.col("question"), F.col("terms")))))
    calm = own.where("level = 'none'")
    found = cut(two_anchors(calm.select("item_id", "search", "question"), chunks, k, scorer))
    hint = hint_of(own, 10_000)
    if widen is not None:
        missed = cut(calm.select("item_id", "question").join(hint(found.select("item_id").distinct()), "item_id", "left_anti"))
        if not missed.isEmpty():
            wide = missed.select("item_id", widen(F.col("question")).alias("search"), "question")
            found = found.unionByName(cut(two_anchors(wide, chunks, k, scorer)))
    structures = F.col("structures") if "structures" in parents.columns else F.lit(None)
    texts = parents.select("parent_id", "source", "path", F.coalesce("text", F.lit("")).alias("text"), structures.cast("array<string>").alias("known")).join(hint(found), "parent_id")
    docs = texts.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rank", "parent_id", "source", "path", "text", "known"))).alias("docs"))  # at most k of a question
    with_docs = calm.join(docs, "item_id")
    known = F.array_distinct(F.flatten(F.array_compact(F.transform("docs", lambda x: x["known"]))))
    rules = prompts.applied_rules(F.col("question"), prompts.mismatched(F.col("structures"), known), F.col("language"))
    blocks = [("CONTEXT OF THE CONVERSATION:", F.col("state")), ("MEMORY:", F.col("memory"))]
    user = prompts.user_prompt(F.col("question"), context_block(F.col("docs")), F.col("history"), blocks, F.col("findings"))
    # claims on an image are judged by its findings too
    context = F.concat_ws("\n\n", context_block(F.col("docs")), F.col("findings"))
    ready = with_docs.select("item_id", "question", "profile", "facts", "language", rules.alias("rules"), user.alias("user"), context.alias("context"), F.transform("docs", lambda x: x["parent_id"]).alias("sources"))

    def told(rows: DataFrame) -> DataFrame:
        system = prompts.system_prompt(F.col("rules"), F.col("profile"), F.col("facts"), F.col("language"), F.col("correction"))
        return answer(rows.withColumn("system", system)).withColumn("answer", F.coalesce("answer", F.lit("")))

    done = answered(ready, "item_id", told, judge, retries).select("item_id", "sources", "answer", "verdict", "flagged", "retries")
    out = own.select("item_id", "level", "search").join(done, "item_id", "left")
    text = F.coalesce(with_disclaimer(F.col("answer"), F.col("verdict"), F.lit(0), notices), F.lit(NOTHING))
    for level, reply in replies.items():
        text = F.when(F.col("level") == level, reply).otherwise(text)
    verdict = F.when(F.col("level") != "none", "TRIAGE").otherwise(F.coalesce("verdict", F.lit("N/A")))
    return out.select("item_id", "level", "search", "sources", text.alias("answer"), verdict.alias("verdict"), "flagged", F.coalesce("retries", F.lit(0)).cast("long").alias("retries"), F.coalesce(F.col("verdict").isin(*KEPT), F.lit(False)).alias("remembered"))
