"""Answers given again, guarded and read as choices."""

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import anatomy, answers


@pytest.mark.parametrize("retries", [0, 1, 2])
def test_only_failures_are_answered_again(spark, retries):
    """Of 12 questions 6 fail; the second answer mends half of them. Each call is counted where it runs."""
    called = spark.sparkContext.accumulator(0)
    questions = spark.createDataFrame([(i, f"q{i}", "c") for i in range(12)], "key long, question string, context string").repartition(3)

    @F.udf("string")
    def model(i, correction):
        called.add(1)
        return ("good" if i % 2 else "bad") if correction is None else ("good" if i % 4 == 0 else f"bad {correction}")

    def judge(rows):
        bad = F.col("answer").startswith("bad")
        return rows.withColumns({"verdict": F.when(bad, "FAIL").otherwise("PASS"), "flagged": F.when(F.col("key") > 5, F.array("question"))})

    got = {r.key: r for r in answers.answered(questions, "key", lambda rows: rows.withColumn("answer", model("key", "correction")), judge, retries).collect()}
    assert called.value == 12 + (6 if retries else 0) + (3 if retries == 2 else 0)
    assert len(got) == 12 and all(got[i].retries == 0 and got[i].verdict == "PASS" for i in range(1, 12, 2))
    if retries:
        assert [got[i].verdict for i in range(0, 12, 2)] == ["PASS", "FAIL"] * 3 and got[8].retries == 1
        assert got[2].answer == f"bad {answers.NO_CLAIM}" and got[6].answer == "bad - q6" and got[2].retries == retries


def test_contradictions_are_rewritten_or_withheld(spark):
    different = spark.createDataFrame([("cornea", "lens")], "a string, b string")
    rules = spark.createDataFrame([(r"the iris is clear", None, "The iris is not clear.")], "pattern string, exempt string, message string")
    check = lambda rows: anatomy.contradictions(rows, "key", "answer", rules, different)
    rows = [(1, "All is well."), (2, "The cornea is the same as the lens."), (3, "the iris is clear"), (4, "the iris is clear, really"), (5, "Lens equals the cornea."), (6, None)]
    new = F.when(F.col("key") == 2, "The cornea lies before the lens.").when(F.col("key") == 3, " ").when(F.col("key") == 4, "Yes, the iris is clear").when(F.col("key") == 5, F.concat(F.lit("fixed: "), F.col("issues")))
    got = {r.key: (r.guard, r.final) for r in answers.guarded(spark.createDataFrame(rows, "key long, answer string"), "key", check, lambda bad: bad.withColumn("corrected", new)).collect()}
    assert got == {
        1: ("kept", "All is well."), 2: ("rewritten", "The cornea lies before the lens."), 3: ("kept", "the iris is clear"), 4: ("withheld", answers.NOTICE),
        5: ("rewritten", "fixed: - Cornea is anatomically different from Lens."), 6: ("kept", None),
    }


def test_option_is_picked_or_not(spark):
    rows = [("It is Glaucoma", ["A. Cataract", "B. glaucoma"], 1), ("unclear", ["A. Cataract"], None), (" ", ["A. x"], None), (None, ["A. x"], None), ("x", None, None), ("x", [], None), ("red and blue", ["red", "blue"], 0), ("one of five", ["one b c d e"], None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, o array<string>, want long").select("*", answers.picked(F.col("a"), F.col("o")).alias("got"))
    assert all(r.got == r.want for r in df.collect())
