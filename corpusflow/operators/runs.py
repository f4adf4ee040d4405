"""Evaluation runs: questions over retrieval, answers and their grounding to measures, for one or several configurations at once.

A configuration says which wording of a question is searched for, which of the retrieval's lists answers it and whether the answer is
judged. All wordings are looked up in one retrieval whose lists are shared; what two configurations have in common is retrieved,
answered and judged once. Models are arguments.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import coverage, dot, filtered_mean, mcq_loose, rouge_l
from ..functions.notes import stripped
from ..functions.rules import normalize_query
from ..functions.safety import ACRONYMS, CANONICAL, NOISE, judge_scores, mapped_query, refined_query
from ..session import cut, hint_of
from . import grounding, retrieval
from .answers import option_text, picked

#: Wordings of a question, in the order of their numbers.
WORDINGS = ("raw", "refined", "normalized", "augmented")
#: A configuration: the wording, the list, and whether answers are judged.
CONFIGS: dict[str, tuple[str, str, bool]] = {
    "full_pipeline": ("refined", "reranked", True),
    "no_refinement": ("raw", "reranked", True),
    "no_reranking": ("refined", "fused", True),
    "dense_only": ("refined", "dense", True),
    "bm25_only": ("refined", "sparse", True),
    "no_grounding": ("refined", "reranked", False),
    "augmented": ("augmented", "reranked", True),
}
MEASURES = ("recall", "mrr", "precision", "hit_rate", "rouge_l", "similarity", "coverage", "judge")
RUN = ["item_id", "wording", "list"]


def with_options(question: Column, options: Column) -> Column:
    """A question, and the options of one that has some (an array, may be null), a line each."""
    return F.when(F.size(options) > 0, F.concat(question, F.lit("\n\nOptions:\n"), F.array_join(options, "\n"))).otherwise(question)


def wordings(questions: DataFrame, terms: Sequence[str] = ()) -> DataFrame:
    """item_id, wording, text: each question (item_id, question, options) as it is, refined, normalised, and refined behind one of ``terms``,
    which its MD5 chooses. Null questions are empty ones."""
    full = with_options(F.coalesce("question", F.lit("")), F.col("options"))
    own = questions.select("item_id", full.alias("full")).withColumn("refined", refined_query(F.col("full")))
    plain = normalize_query(F.col("full"), CANONICAL, NOISE, (), ACRONYMS, 18)
    term = F.get(F.array(*[F.lit(t) for t in terms]), (F.conv(F.substring(F.md5("full"), 1, 8), 16, 10).cast("long") % len(terms)).cast("int")) if terms else F.lit(None).cast("string")
    said = {"raw": F.col("full"), "refined": F.col("refined"), "normalized": mapped_query(F.col("full"), F.coalesce(F.nullif(plain, F.lit("")), F.col("full"))), "augmented": F.concat_ws(" ", term, "refined")}
    each = F.explode(F.array(*[F.struct(F.lit(w).alias("wording"), said[w].alias("text")) for w in WORDINGS]))
    return own.select("item_id", each.alias("_w")).select("item_id", "_w.*")


def retrieved(texts: DataFrame, chunks: DataFrame, wanted: Sequence[tuple[str, str]], k: int = 3, scorer: Callable = retrieval.overlap_score, vector: Callable = retrieval.hashed_vector, stats: DataFrame | None = None) -> DataFrame:
    """item_id, wording, list, parent_id, rank: the ``k`` parents of each wanted (wording, list).

    ``texts`` as of ``wordings``, item_id an integer; ``chunks``: doc_id (an integer), parent_id, text. Sparse and dense lists hold ten chunks, the
    fused one 4 k, reranked to 2 k; of each the first 2 k chunks give parents. One retrieval serves all lists.
    """
    used, number = {w for w, _ in wanted}, F.array_position(F.array(*[F.lit(w) for w in WORDINGS]), F.col("wording")) - 1
    asked = cut(texts.where(F.col("wording").isin(*used)).select((F.col("item_id") * len(WORDINGS) + number).alias("item_id"), "text"))
    sparse = retrieval.bm25_top_k(chunks, asked, 10, stats).select("item_id", "doc_id", "rank", F.lit("sparse").alias("kind"))
    items = chunks.select(F.col("doc_id").alias("id"), vector(F.col("text")).alias("v"))
    # negative numbers, so that no question is taken for a chunk
    dense = retrieval.dense_top_k(items, asked.select((-F.col("item_id") - 1).alias("query_id"), vector(F.col("text")).alias("qv")))
    dense = dense.select((-F.col("query_id") - 1).alias("item_id"), F.col("id").alias("doc_id"), F.col("rank").cast("long").alias("rank"), F.lit("dense").alias("kind"))
    single = cut(sparse.unionByName(dense))
    fused = cut(retrieval.fuse(single, 4 * k))
    ranked = lambda df, kind, rank="rank": df.select("item_id", "doc_id", F.col(rank).cast("long").alias("rank"), kind.alias("list"))
    lists = [ranked(single, F.col("kind")), ranked(fused, F.lit("fused"))]
    if any(name == "reranked" for _, name in wanted):
        lists.append(ranked(retrieval.rerank(fused, asked, chunks, 2 * k, scorer), F.lit("reranked"), "rerank_rank"))
    hits = lists[0].unionByName(lists[1]) if len(lists) == 2 else lists[0].unionByName(lists[1]).unionByName(lists[2])
    wording = F.element_at(F.array(*[F.lit(w) for w in WORDINGS]), (F.pmod("item_id", F.lit(len(WORDINGS))) + 1).cast("int"))
    hits = hits.where(F.col("rank") <= 2 * k).select(F.floor(F.col("item_id") / len(WORDINGS)).alias("item_id"), wording.alias("wording"), "list", "doc_id", "rank")
    hits = hits.where(F.concat_ws("/", "wording", "list").isin(*{"/".join(w) for w in wanted}))
    # few rows a question: what is broadcast is the hits
    parents = chunks.select("doc_id", "parent_id").join(hint_of(asked, 10_000)(hits), "doc_id")
    first = parents.groupBy(*RUN, "parent_id").agg(F.min("rank").alias("rank"))
    own = first.withColumn("_n", F.row_number().over(Window.partitionBy(*RUN).orderBy("rank"))).where(F.col("_n") <= k)
    return own.select(*RUN, "parent_id", F.col("_n").cast("long").alias("rank"))


def context_block(docs: Column) -> Column:
    """Sources of an answer: array<struct<source,path,text>> as blocks of at most 2,000 characters each."""
    block = lambda x, i: F.concat(F.lit("[Source "), i + 1, F.lit(": "), F.coalesce(x["source"], F.lit("Unknown")), F.lit(" — "), F.coalesce(x["path"], F.lit("General")), F.lit("]\n"), stripped(F.substring(x["text"], 1, 2000)))
    return F.array_join(F.transform(docs, block), "\n\n---\n\n")


def retrieval_measures(texts: Column, keywords: Column) -> dict[str, Column]:
    """recall, precision, mrr (4 places) and hit_rate (per cent, 1 place) of keywords in ranked texts; 0 where there are none of either."""
    low, held = F.transform(texts, F.lower), F.transform(keywords, F.lower)
    right = F.transform(low, lambda t: F.exists(held, lambda x: F.contains(t, x)))
    found = F.size(F.filter(held, lambda x: F.contains(F.array_join(low, " "), x)))
    share = F.when((F.size(low) > 0) & (F.size(held) > 0), found / F.size(held)).otherwise(0.0)
    precision = F.when(F.size(low) > 0, F.size(F.filter(right, lambda x: x)) / F.size(low)).otherwise(0.0)
    place = F.array_position(right, True)
    return {"recall": F.round(share, 4), "precision": F.round(precision, 4), "mrr": F.round(F.when(place > 0, 1 / place).otherwise(0.0), 4), "hit_rate": F.round(100 * share, 1)}


def similarity(a: Column, b: Column, vector: Callable = retrieval.hashed_vector) -> Column:
    """Cosine of unit vectors, from 0, to four places."""
    return F.round(F.greatest(dot(vector(a), vector(b)), F.lit(0.0)), 4)


def answer_measures(answer: Column, reference: Column, keywords: Column, vector: Callable = retrieval.hashed_vector) -> dict[str, Column]:
    """rouge_l and similarity to the reference, coverage of the keywords (1 where there are none)."""
    held = F.transform(keywords, F.lower)
    return {"rouge_l": rouge_l(answer, reference), "similarity": similarity(answer, reference, vector), "coverage": F.round(coverage(answer, held, 1.0), 4)}


def chose(answer: Column, options: Column, right: Column) -> Column:
    """Whether an answer names the right option (a place from 0) by its letter or text, or is read as it; null without options or a right one."""
    option, letter = F.get(options, right.cast("int")), F.substring(F.lit("ABCDE"), (right + 1).cast("int"), F.lit(1))
    named = mcq_loose(answer, letter, option_text(option))
    return F.when((F.size(options) > 0) & option.isNotNull(), named | F.coalesce(picked(answer, options) == right, F.lit(False)))


def evaluated(
    questions: DataFrame,
    chunks: DataFrame,
    parents: DataFrame,
    answer: Callable[[DataFrame], DataFrame],
    configs: Mapping[str, tuple[str, str, bool]] = {"full_pipeline": CONFIGS["full_pipeline"]},
    k: int = 3,
    terms: Sequence[str] = (),
    judge: Callable[[DataFrame], DataFrame] | None = None,
    scorer: Callable = retrieval.overlap_score,
    vector: Callable = retrieval.hashed_vector,
    claim_scorer: Callable = grounding.overlap,
) -> DataFrame:
    """One row a question and configuration: item_id, config, returned, answer, verdict, correct and the measures.

    ``questions``: item_id (an integer of its own), question, options (array), right (place of the right option), reference, keywords (array); all but
    the first may be null. ``chunks``: doc_id, parent_id, text; ``parents``: parent_id, source, path, text. ``answer`` adds a column of that name to
    rows (item_id, wording, list, question, context, texts) with at least one source; ``judge`` adds ``judged``, a text with scores, to rows with
    answer and reference. Questions without sources have measures of retrieval alone, and null for the rest.
    """
    none = F.array().cast("array<string>")
    asked = questions.select("item_id", F.coalesce("question", F.lit("")).alias("question"), F.coalesce("options", none).alias("options"), "right", F.coalesce("reference", F.lit("")).alias("reference"), F.coalesce("keywords", none).alias("keywords"))
    runs = sorted({(w, name) for w, name, _ in configs.values()})
    hits = cut(retrieved(wordings(asked, terms), chunks, runs, k, scorer, vector))
    hint = hint_of(questions, 10_000)
    texts = parents.select("parent_id", "source", "path", F.coalesce("text", F.lit("")).alias("text")).join(hint(hits), "parent_id")
    docs = texts.groupBy(*RUN).agg(F.array_sort(F.collect_list(F.struct("rank", "source", "path", "text"))).alias("docs"))  # at most k of a run
    every = asked.withColumn("_r", F.explode(F.array(*[F.struct(F.lit(w).alias("wording"), F.lit(name).alias("list")) for w, name in runs]))).select(*asked.columns, "_r.*")
    own = every.join(docs, RUN, "left").withColumn("texts", F.coalesce(F.transform("docs", lambda x: x["text"]), none))
    own = own.withColumns(retrieval_measures(F.col("texts"), F.col("keywords")) | {"returned": F.size("texts").cast("long"), "context": context_block(F.col("docs"))})
    own = cut(own.drop("docs"))
    said = own.where("returned > 0").select(*RUN, with_options(F.col("question"), F.col("options")).alias("question"), "context", "texts", "reference")
    said = cut(answer(said).select(*RUN, "question", F.coalesce("answer", F.lit("")).alias("answer"), "context", "reference"))
    key = F.struct(*RUN).alias("key")
    judged = grounding.verdicts(said.select(key, "answer", "context"), "key", "answer", "context", claim_scorer).select("key.*", "verdict")
    score = judge(said).select(*RUN, judge_scores(F.col("judged"))["overall"].alias("judge")) if judge else said.select(*RUN, F.lit(None).cast("double").alias("judge"))
    out = own.join(said.select(*RUN, "answer"), RUN, "left").join(judged, RUN, "left").join(score, RUN, "left")
    measures = answer_measures(F.col("answer"), F.col("reference"), F.col("keywords"), vector) | {"correct": chose(F.col("answer"), F.col("options"), F.col("right"))}
    out = out.withColumns({name: F.when(F.col("answer").isNotNull(), c) for name, c in measures.items()})
    each = F.array(*[F.struct(F.lit(name).alias("config"), F.lit(w).alias("w"), F.lit(of).alias("l"), F.lit(sure).alias("sure")) for name, (w, of, sure) in configs.items()])
    out = out.withColumn("_c", F.explode(F.filter(each, lambda c: (c["w"] == F.col("wording")) & (c["l"] == F.col("list")))))
    verdict = F.when(F.col("_c.sure"), F.col("verdict")).when(F.col("answer").isNotNull(), "SKIPPED")
    return out.select("item_id", "_c.config", "returned", "answer", verdict.alias("verdict"), "correct", *MEASURES)


def summarised(runs: DataFrame, by: str = "config") -> DataFrame:
    """Means of the measures over what is neither null nor negative, accuracy over questions with options and the share of PASS over verdicts
    that were given, per ``by``; null where there is nothing to count."""
    graded = F.col("verdict").isNotNull() & ~F.col("verdict").isin("SKIPPED", "ERROR")
    means = [filtered_mean(F.col(m)).alias(f"mean_{m}") for m in MEASURES]
    rate = lambda c: F.round(F.avg(c), 4)
    passed = F.when(graded, F.when(F.col("verdict") == "PASS", 1.0).otherwise(0.0))
    return runs.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *means, rate(F.col("correct").cast("double")).alias("accuracy"), rate(passed).alias("pass_rate"))
