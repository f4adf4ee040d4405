"""Questions from beginning to end, the prompts they lead to, and what a session tells a model."""

import re

from pyspark.sql import functions as F

from corpusflow.functions import prompts
from corpusflow.functions.safety import split_response
from corpusflow.operators import ask, sessions

PARENTS = [
    (1, "book", "Cornea", "The cornea is the clear front window of the eye. It bends light that comes into the eye.", ["cornea"]),
    (2, None, None, "A cataract clouds the lens of the eye slowly. Surgery takes the cloudy lens out.", ["lens"]),
    (3, "guide", None, "Eye drops lower the pressure in glaucoma. The nerve suffers from high pressure.", None),
]
QUESTIONS = [
    (1, "Bleach in my eye, what now?", None, None, None),
    (2, "How does the cornea bend light?", ["cornea"], "MEMORIES", ["cornea"]),
    (3, "What clouds the lens in a cataract?", [], None, ["cornea"]),
    (4, "Which drops lower pressure in glaucoma?", None, None, None),
    (5, None, None, None, None),
]


def tables(spark):
    parents = spark.createDataFrame(PARENTS, "parent_id long, source string, path string, text string, structures array<string>")
    questions = spark.createDataFrame(QUESTIONS, "item_id long, question string, terms array<string>, memory string, structures array<string>")
    return questions, parents.select((F.col("parent_id") * 100).alias("doc_id"), "parent_id", "text"), parents


def test_from_question_to_answer(spark):
    told = []

    def answer(rows):
        told.extend(rows.select("item_id", "system", "user", "correction").collect())
        wrong = F.lit("Invented nonsense words stand here without any support whatsoever.")
        true = F.lit(PARENTS[2][3])
        # 3 is wrong once, 4 always
        return rows.withColumn("answer", F.when((F.col("item_id") == 4) | ((F.col("item_id") == 3) & F.col("correction").isNull()), wrong).when(F.col("item_id") == 3, F.lit(PARENTS[1][3])).when(F.col("item_id") == 2, F.lit(PARENTS[0][3])).otherwise(true))

    got = {r.item_id: r for r in ask.ask(*tables(spark), answer).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    assert (got[1].verdict, got[1].answer, got[1].sources, got[1].search, got[1].remembered) == ("TRIAGE", ask.REPLIES["emergency"], None, None, False)
    assert got[2].verdict == "PASS" and got[2].retries == 0 and got[2].remembered and got[2].sources[0] == 1 and got[2].answer == PARENTS[0][3]
    assert got[3].verdict == "PASS" and got[3].retries == 1 and got[3].remembered
    assert got[4].verdict == "FAIL" and got[4].retries == 1 and not got[4].remembered and got[4].answer.startswith(ask.NOTICES["unverified"]) and len(got[4].flagged) == 1
    assert got[5].level == "none"
    first = {r.item_id: r for r in told if r.correction is None}
    again = {r.item_id: r for r in told if r.correction is not None}
    assert sorted(first) == [2, 3, 4, 5] and sorted(again) == [3, 4] and len(told) == 6
    assert "nonsense words" in again[3].system and "nonsense words" not in first[3].system
    assert "MEMORY:\nMEMORIES" in first[2].user and "MEMORY:" not in first[3].user and "[Source 1: book — Cornea]\n" in first[2].user


def test_sources_on_another_part_are_told(spark):
    questions, chunks, parents = tables(spark)
    seen = []

    def answer(rows):
        seen.extend(rows.select("item_id", "system").collect())
        return rows.withColumn("answer", F.lit("I don't know"))

    own = lambda df: df.where("parent_id = 2")
    got = ask.ask(questions.where("item_id in (2, 4)"), own(chunks), own(parents), answer).collect()
    assert {r.verdict for r in got} == {"PASS"}  # a refusal
    assert {r.item_id: "\n16. " in r.system for r in seen} == {2: True, 4: False}


def test_without_sources_it_searches_wider_and_then_says_so(spark):
    questions, chunks, parents = tables(spark)
    got = {r.item_id: r for r in ask.ask(questions, chunks.limit(0), parents, lambda rows: rows.withColumn("answer", F.lit("x")), widen=lambda q: F.concat(q, F.lit(" eye"))).collect()}
    assert got[1].verdict == "TRIAGE" and all(got[i].verdict == "N/A" and got[i].answer == ask.NOTHING and not got[i].remembered for i in (2, 3, 4, 5))


def test_rules_and_prompts(spark):
    asked = ["White spot on my cornea, red and painful", "A white spot on the iris", "white spot on the cornea, red; fundus photo done", "Is it blurred?", None]
    df = spark.createDataFrame([(i, q, "Tamil" if i == 3 else None) for i, q in enumerate(asked)], "i int, q string, lang string")
    numbers = prompts.applied_rules(F.col("q"), F.col("i") == 1, F.col("lang"))
    rows = df.select("i", numbers.alias("n"), prompts.system_prompt(numbers, F.lit("PROFILE\n"), F.array(F.lit("A fact.")), F.col("lang"), F.when(F.col("i") == 4, "- bad")).alias("s")).orderBy("i").collect()
    always = [*range(1, 12)]
    assert [r.n for r in rows] == [[*always, 12, 13, 14, 15, 18], [*always, 12, 13, 16, 18], [*always, 18], [*always, 12, 17, 18], [*always, 12, 18]]
    for r in rows:
        assert [int(x) for x in re.findall(r"(?m)^(\d+)\. ", r.s)] == r.n and "PROFILE\nFACTS:\n- A fact.\n\nRULES:\n1. " in r.s and ("- bad" in r.s) == (r.i == 4)
    assert "in Tamil." in rows[3].s
    short = df.select(prompts.system_prompt(F.array(F.lit(6)), concise=True).alias("s")).first().s
    assert "6. Use 40 to 90 words" in short and "RULES:" in short
    user = df.limit(1).select(prompts.user_prompt(F.lit("Q?"), F.lit(None), None, [("A:", F.lit(" ")), ("B:", F.lit("b"))], F.lit("dots")).alias("u")).first().u
    assert user == "\nB:\nb\n\nQUESTION:\nQ?\n[FINDINGS OF THE IMAGE]\ndots\n\n\nSOURCES:\n\n"
    both = split_response(F.lit(f"Short.\n{prompts.MARK}\nLong."))
    assert tuple(df.limit(1).select(*both).first()) == ("Short.", "Long.")


def test_sessions_tell_what_they_know(spark):
    assert sessions.generation_context(sessions.empty_state()) == ""
    turns = [
        (1, 1, [("anatomy", "cornea", 0.9), ("condition", "corneal ulcer", 0.8), ("symptom", "pain", 0.9), ("medication", "moxifloxacin", 0.8), ("finding", "haze", 0.6), ("symptom", "tearing", 0.3)]),
        (1, 2, [("imaging", "oct", 0.9), ("condition", "cataract", 0.5)]),
        (2, 1, []),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, entities array<struct<type:string,value:string,confidence:double>>")
    got = {(r.conv_id, r.turn): r.context.split("\n") for r in sessions.contexts(df, {"corneal_ulcer": "It scars."}).collect()}
    assert got[1, 1] == ["Part of the eye: cornea (confidence: 0.90)", "Main condition: corneal ulcer (confidence: 0.80)", "Symptoms: pain (0.90)", "Medications: moxifloxacin", "Possible finding: haze", "Facts: It scars."]
    later = got[1, 2]
    assert "Imaging: OCT" in later and any(x.startswith("Other conditions: cataract") for x in later) and "Possible finding: haze" in later and later[-1] == "Facts: It scars."
    assert got[2, 1] == [""]
    state = sessions.empty_state() | {"pending": {f"symptom:{v}": {"c": c, "hits": h, "first": 1, "last": 1} for v, c, h in [("a", 0.6, 1), ("b", 0.9, 1), ("c", 0.6, 2), ("d", 0.56, 1), ("e", 0.5, 3)]}}
    assert sessions.provisional(state) == {"symptom": ["b", "c", "a"]}
    state["shift"] = {"condition": {"value": "glaucoma", "c": 0.6, "hits": 1, "last": 1}}
    assert sessions.provisional(state)["condition"] == ["glaucoma"] and "Possible condition: glaucoma" in sessions.generation_context(state)
    assert "Possible" not in sessions.generation_context(state, least=None)
