"""Evaluation runs: what configurations share, empty parts, measures against plain versions."""

import random

from pyspark.sql import functions as F

from corpusflow.functions.metrics import rouge_l
from corpusflow.operators import runs

DOCS = [(1, "The cornea is clear. It bends light into the eye."), (2, "A cataract clouds the lens. Surgery takes the lens out."), (3, "Drops lower the pressure. Glaucoma hurts the nerve."), (4, None)]
QUESTIONS = [
    (10, "What does the cornea do with light?", None, None, "It bends light.", ["Cornea", "light", "zebra"]),
    (11, "Which part does a cataract cloud?", ["A. cornea", "B. the lens"], 1, "The lens.", None),
    (12, None, [], None, None, []),
]
SCHEMA = "item_id long, question string, options array<string>, right long, reference string, keywords array<string>"


def tables(spark):
    docs = spark.createDataFrame(DOCS, "parent_id long, text string")
    chunks = docs.where("text is not null").select((F.col("parent_id") * 10).alias("doc_id"), "parent_id", "text")
    return spark.createDataFrame(QUESTIONS, SCHEMA), chunks, docs.withColumns({"source": F.when(F.col("parent_id") == 2, "book"), "path": F.lit(None).cast("string")})


def test_configurations_share_what_they_have_in_common(spark):
    seen = []

    def answer(rows):
        seen.extend((r.item_id, r.wording, r.list) for r in rows.select("item_id", "wording", "list").collect())
        assert all(r.context.startswith("[Source 1: ") and " — General]\n" in r.context for r in rows.select("context").collect())
        return rows.withColumn("answer", F.get("texts", F.lit(0)))

    got = {(r.item_id, r.config): r for r in runs.evaluated(*tables(spark), answer, runs.CONFIGS, terms=("lens",)).collect()}
    assert len(got) == len(QUESTIONS) * len(runs.CONFIGS)
    assert len(seen) == len(set(seen)) and len({(w, name) for _, w, name in seen}) == 6  # two of seven configurations differ by the verdict alone
    full, silent = got[10, "full_pipeline"], got[10, "no_grounding"]
    assert silent.verdict == "SKIPPED" and full.verdict != "SKIPPED" and full.answer == silent.answer == DOCS[0][1]
    assert full.mrr == 1.0 and full.recall == round(2 / 3, 4) and full.hit_rate == 66.7 and full.correct is None and full.coverage == round(2 / 3, 4)
    mcq = got[11, "bm25_only"]
    assert mcq.correct and mcq.recall == 0.0 and mcq.coverage == 1.0 and mcq.rouge_l > 0
    # a question without words finds nothing by words; what is not answered has measures of retrieval alone
    none = got[12, "bm25_only"]
    assert (none.returned, none.recall, none.answer, none.verdict, none.rouge_l, none.coverage) == (0, 0.0, None, None, None, None)


def test_means_leave_out_what_is_missing(spark):
    rows = [("a", "PASS", True, 0.5, -1.0), ("a", "SKIPPED", None, None, None), ("a", "FAIL", False, 0.0, 0.4), ("a", None, None, 1.0, None), ("b", "ERROR", None, None, None)]
    df = spark.createDataFrame(rows, "config string, verdict string, correct boolean, recall double, judge double")
    df = df.withColumns({m: F.lit(0.25) for m in runs.MEASURES if m not in ("recall", "judge")})
    got = {r.config: r for r in runs.summarised(df).collect()}
    assert (got["a"].n, got["a"].mean_recall, got["a"].mean_judge, got["a"].accuracy, got["a"].pass_rate) == (4, 0.5, 0.4, 0.5, 0.5)
    assert got["b"].pass_rate is None and got["b"].mean_recall is None and got["b"].accuracy is None and got["b"].mean_mrr == 0.25


def test_no_questions(spark):
    questions, chunks, parents = tables(spark)
    assert runs.evaluated(questions.limit(0), chunks, parents, lambda rows: rows.withColumn("answer", F.lit("x"))).count() == 0


def plain(x, y):
    import re

    a, b = (re.sub(r"[^a-z0-9\s]", "", (t or "").lower()).split() for t in (x, y))
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, u in enumerate(a, 1):
        for j, v in enumerate(b, 1):
            t[i][j] = t[i - 1][j - 1] + 1 if u == v else max(t[i - 1][j], t[i][j - 1])
    n = t[-1][-1]
    return round(2 * n / (len(a) + len(b)), 4) if n else 0.0


def test_rouge_l(spark):
    r = random.Random(5)
    text = lambda: "".join(r.choice(["a", "b", "don't ", " ", "well-known ", "É", "7"]) for _ in range(r.randrange(60)))
    rows = [("I don't know", "dont know"), (None, "a"), ("", ""), ("well-known", "well known"), *((text(), text()) for _ in range(60))]
    got = spark.createDataFrame(rows, "x string, y string").select("x", "y", rouge_l(F.col("x"), F.col("y")).alias("s")).collect()
    assert [r.s for r in got] == [plain(r.x, r.y) for r in got]
    assert got[0].s == round(2 * 2 / 5, 4) and got[3].s == 0.0
