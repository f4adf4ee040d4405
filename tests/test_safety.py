"""Rules of danger, mapped queries and the graph of structures on written cases."""

import pytest
from pyspark.sql import functions as F

from corpusflow.functions import safety as S
from corpusflow.operators import anatomy as A
from corpusflow.operators import corpus, sessions

CASES = [
    ("I have a white spot on the black part of the eye with redness and watering.", "retina roth spots leukocoria", "urgent", True, ["cornea", "keratitis"], ["retina", "roth", "leukocoria"]),
    ("There is a white patch on the front of my eye and it is painful and red.", "retinal vasculitis fundus roth", "urgent", True, ["cornea", "ulcer"], ["retina", "roth", "fundus"]),
    ("As a contact lens wearer I now have red painful eye with a white spot.", "roth spots retinal finding", "urgent", True, ["cornea", "keratitis"], ["roth", "retina"]),
    ("White dot on black part of eye and tearing since today.", "retina lesion", "urgent", True, ["cornea", "tear"], ["retina"]),
    ("After dilated fundus exam they saw Roth spots and retinal hemorrhage.", "roth spots retina", "none", False, ["retina"], ["keratitis"]),
    ("Both eyes are itchy and watery due to seasonal allergy.", "allergic conjunctivitis", "none", False, ["conjunctivitis"], ["keratitis"]),
    ("Contact lens feels uncomfortable but no redness or pain.", "contact lens discomfort", "none", False, ["lens"], ["ulcer"]),
    ("I suddenly went blind in one eye.", "vision loss", "emergency", False, ["vision"], ["keratitis"]),
    ("There is a white spot in my pupil.", "spot", "leukocoria", False, ["cataract"], ["retina"]),
    (None, "x", "none", False, [], ["keratitis"]),
]


@pytest.mark.parametrize("case", CASES, ids=lambda c: (c[0] or "null")[:20])
def test_mapping(spark, case):
    raw, candidate, level, risk, include, exclude = case
    df = spark.createDataFrame([(raw, candidate)], "raw string, candidate string")
    row = df.select(
        S.triage_level(F.col("raw")).alias("level"), S.surface_profile(F.col("raw"))["high_risk"].alias("risk"), S.mapped_query(F.coalesce("raw", F.lit("")), F.col("candidate")).alias("q"), S.refined_query(F.coalesce("raw", F.lit(""))).alias("r")
    ).first()
    assert (row.level, row.risk) == (level, risk)
    tokens = row.q.split()
    assert set(include) <= set(tokens) and not set(exclude) & set(tokens) and len(tokens) <= 18 and len(row.r.split()) <= 15


def test_answers(spark):
    df = spark.createDataFrame([("Accuracy: 4\nSAFETY: 5, clarity: 9", "Summary: short---DETAILS---**Details:** long", "<thought>no</thought> yes\nConfidence score: 3\nend")], "j string, s string, t string")
    a, b = S.split_response(F.col("s"))
    own = S.judge_scores(F.col("j"))
    row = df.select(own["accuracy"].alias("acc"), own["completeness"].alias("com"), own["overall"].alias("all"), a.alias("a"), b.alias("b"), S.without_thoughts(F.col("t")).alias("t")).first()
    assert tuple(row) == (4, None, 4.5, "short", "long", "yes\nend")
    verdicts = spark.createDataFrame([(3, 0, 0), (2, 0, 1), (1, 0, 3), (5, 1, 0), (0, 0, 0)], "e int, c int, u int")
    assert [r[0] for r in verdicts.select(S.nli_verdict(F.col("e"), F.col("c"), F.col("u"))).collect()] == ["PASS", "PARTIAL", "FAIL", "FAIL", "PASS"]
    terms = spark.createDataFrame([("- 12. Dry   Eye ;",), ("ab",), ("x" * 90,)], "t string")
    assert [r[0] for r in terms.select(S.lexicon_term(F.col("t"))).collect()] == ["dry eye", None, None]
    names = spark.createDataFrame([("Catar",), ("AMD",), ("Other ",)], "t string")
    assert [r[0] for r in names.select(S.first_entity(F.col("t"), [("cataract", "Cataract"), ("catarrh", "Cold")], {"amd": "Macular degeneration"})).collect()] == ["Cataract", "Macular degeneration", "other"]


def test_contradictions(spark):
    texts = spark.createDataFrame([(1, "The sclera is black."), (2, "A black spot on the sclera is black."), (3, "the cornea is the same as the retina"), (4, "retina. is the same as cornea"), (5, None)], "k int, t string")
    rules = spark.createDataFrame([("s", r"sclera\s+is\s+black", r"black\b[^.]{0,40}\bspot\b[^.]{0,40}\bsclera", "The sclera is white.")], "id string, pattern string, exempt string, message string")
    got = A.contradictions(texts, "k", "t", rules, spark.createDataFrame([("cornea", "retina")], "a string, b string")).collect()
    assert sorted(map(tuple, got)) == [(1, "The sclera is white."), (3, "Cornea is anatomically different from Retina.")]
    rooms = spark.createDataFrame([("Optic disc", None), ("?", "iris"), (None, None)], "a string, b string").select(A.resolved_room(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in rooms] == ["posterior_segment", "anterior_segment", None]


def test_session_resets():
    state = sessions.empty_state()
    for turn in (1, 2):
        state = sessions.transition(state, turn, [("anatomy", "cornea", 0.8), ("finding", "ulcer", 0.9), ("symptom", "pain", 0.85), ("symptom", "glare", 0.4)])
    assert sessions.has_context(state) and sessions.context_terms(state) == ["cornea", "ulcer", "pain", "glare"]
    state = sessions.transition(state, 3, [("image", "new", 1.0)])
    assert not state["slots"] and sessions.context_terms(state) == ["pain", "glare"]
    state = sessions.transition(state, 3 + sessions.IDLE_TURNS + 1, [])
    assert not state["items"] and not sessions.has_context(state)
    state = sessions.transition(state, 20, [("finding", "scar", 0.5)])
    assert not sessions.has_context(state) and sessions.has_context(state, provisional=0.45)
    many = sessions.empty_state()
    many = sessions.transition(many, 1, [("medication", f"m{i}", 0.8 + i / 100) for i in range(6)])
    assert sessions.context_terms(many) == ["m5", "m4", "m3"]


def test_purge_section(spark):
    lines = ["intro", "# Keep", "a", "# Drop", "b", "## below", "c", "# Keep", "d"]
    df = spark.createDataFrame([(k, i, x) for k in (1, 2) for i, x in enumerate(lines)], "k int, line_no int, line string")
    got = [r.line for r in corpus.purge_section(df, "k", "Drop").where("k = 1").orderBy("line_no").collect()]
    assert got == ["intro", "# Keep", "a", "# Keep", "d"]


def test_question_is_rewritten(spark):
    rows = [
        (1, "What to do now?", "[condition:drusen]", ["drusen"], ["'front of eye' -> cornea"], ["f1", "f2", "f3"], " past ", ["What is it?", "What to do now?"], "drusen monitoring treatment options"),
        (2, "Is it bad?", None, None, [], None, " ", None, "x"),
    ]
    df = spark.createDataFrame(rows, "i int, q string, c string, p array<string>, t array<string>, f array<string>, m string, h array<string>, a string")
    got = {r.i: r for r in df.select("i", S.rewrite_input(*[F.col(c) for c in "qcptfmh"]).alias("given"), S.rewritten_query(F.col("q"), F.col("a")).alias("query")).collect()}
    assert got[1].given == "Context:[condition:drusen] [Image: drusen]\nAnatomy Translation: 'front of eye' -> cornea\nAnatomy Facts: f1 f2\nPatient Memory:\npast\nPrior Questions: What is it?\nPatient: What to do now?"
    assert got[2].given == "Context:\nPatient: Is it bad?"
    assert "drusen" in got[1].query and "monitoring" in got[1].query and "bad" in got[2].query.lower()
