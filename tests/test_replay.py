"""Cases of two sessions each: what is carried from one to the next, and measures on the later ones."""

from pyspark.sql import functions as F

from corpusflow.operators import replay

CASES = [
    ("p1", 0, "A corneal ulcer, drops of moxifloxacin since yesterday.", "Keep using the drops.", ["corneal ulcer"], [("cornea", "condition", "corneal ulcer", 0.9), (None, "medication", "moxifloxacin", 0.8)]),
    ("p1", 1, "Redness is better, it still hurts. May I stop the drops?", "Do not stop the drops for the corneal ulcer.", ["Corneal ulcer", "drops"], [(None, "symptom", "redness", 0.8)]),
    ("p1", 2, "And now?", "Go on.", [], None),
    ("p2", 5, "It was called diabetic retinopathy, then glaucoma.", "Control matters.", ["x"], [("retina", "condition", "diabetic retinopathy", 0.9), ("retina", "condition", "glaucoma", 0.6), ("retina", "condition", " ", 0.6)]),
    ("p2", 6, "More floaters in that eye?", "Floaters need review.", ["floaters", "retinal"], []),
    ("p3", 0, "Only once.", "Yes.", None, None),
]
SCHEMA = "subject string, turn long, question string, reference string, keywords array<string>, entities array<struct<room:string,type:string,value:string,confidence:double>>"


def run(spark, with_memory):
    said = F.concat_ws(" ", F.array_join("memory", ", ") if with_memory else F.lit(""), "question")
    return replay.replayed(spark.createDataFrame(CASES, SCHEMA).repartition(4), lambda rows: rows.withColumn("answer", said))


def test_memory_is_carried_between_sessions(spark):
    got = {(r.subject, r.turn): r for r in run(spark, True).collect()}
    assert len(got) == len(CASES) and got["p1", 0].memory == [] and got["p1", 0].coverage is None and got["p3", 0].rouge_l is None
    assert got["p1", 1].memory == ["corneal ulcer", "moxifloxacin"] and got["p1", 2].memory == ["corneal ulcer", "redness", "moxifloxacin"]
    # of one room the later condition supersedes the earlier one
    assert got["p2", 6].memory == ["glaucoma"] and got["p2", 6].coverage == 0.5
    assert got["p1", 1].coverage == 1.0 and got["p1", 2].coverage == 1.0 and 0 < got["p1", 1].rouge_l <= 1


def test_backends_are_compared(spark):
    both = run(spark, True).withColumn("backend", F.lit("memory")).unionByName(run(spark, False).withColumn("backend", F.lit("none")))
    got = {r.backend: r for r in replay.compared(both).collect()}
    assert got["memory"].scored == got["none"].scored == 3
    assert got["memory"].mean_coverage > got["none"].mean_coverage
