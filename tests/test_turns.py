"""Automaton, entities of turns, condition and imaging slots, recorded memory and memory by vectors, against plain versions and cases."""

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusflow.functions.metrics import dot
from corpusflow.operators import automaton, dictionary, entities, memory, sessions
from corpusflow.streaming import recorder


def test_automaton_finds_what_patterns_find(spark):
    r = random.Random(3)
    words = ["eye", "eyes", "red", "é", "x_y", "dry", "3d", "a-b", "(c)"]
    terms = sorted({" ".join(r.choice(words) for _ in range(r.choice([1, 1, 2, 3]))) for _ in range(60)} | {"eye*", "EYE  pain", "red\teye"})
    texts = [(i, "".join(r.choice([*words, "pain", " ", "  ", "\n", ".", "ing", "Eye"]) + r.choice(["", " ", " "]) for _ in range(r.randrange(0, 25)))) for i in range(200)] + [(900, None), (901, "")]
    got = {(x.k, x.needle): (x.hits, x.first) for x in automaton.phrase_hits(spark.createDataFrame(texts, "k long, t string").repartition(3), ["k"], "t", spark.createDataFrame([(t,) for t in terms], "term string"), "term").collect()}
    want = {}
    for k, t in texts:
        own = re.sub(r"\s+", " ", (t or "").lower())
        for term in terms:
            n = re.sub(r"\s+", " ", term.lower()).strip()
            pattern = rf"(?=\b{re.escape(n[:-1])})" if n.endswith("*") else rf"(?=\b{re.escape(n)}\b)"
            found = [m.start() for m in re.finditer(pattern, own)]
            if found:
                want[k, n] = (len(found), found[0])
    assert got == want and len(got) > 100


def test_automaton_in_shares_and_plain(spark):
    texts = spark.createDataFrame([(1, "abcabc"), (2, "zz")], "k long, t string")
    terms = spark.createDataFrame([("a",), ("bc",), ("bc",), ("",), ("cab",), ("q",)], "term string")
    for most in (1, 1000):
        got = {(x.k, x.needle): x.hits for x in automaton.phrase_hits(texts, ["k"], "t", terms, "term", words=False, most=most).collect()}
        assert got == {(1, "a"): 2, (1, "bc"): 2, (1, "cab"): 1}
    assert automaton.phrase_hits(texts, ["k"], "t", terms.limit(0), "term").count() == 0


def test_pattern_hits_over_a_large_vocabulary(spark):
    """Ten thousand terms in one pass: each text holds its own three."""
    terms = spark.range(10_000).select(F.concat(F.lit("term"), "id").alias("term"), F.concat(F.lit("n"), F.col("id") % 100).alias("name"), F.lit("finding").alias("type"), (F.col("id") / 10_000).alias("confidence"))
    texts = spark.range(2_000).select(F.col("id").alias("k"), F.concat_ws(" ", F.lit("so"), F.concat(F.lit("Term"), "id"), F.concat(F.lit("term"), F.col("id") + 100, F.lit(",")), F.concat(F.lit("xterm"), "id"), F.concat(F.lit("term"), F.col("id") + 1)).alias("t"))
    got = dictionary.pattern_hits(texts, "k", "t", terms)
    assert got.count() == 4_000 and got.where("k = 5 AND name = 'n5'").first().confidence == pytest.approx(0.0105)


IMAGE = "Detected Image Type: OCT (Optical Coherence Tomography)\nTop Findings:\n● Probable: drusen (69.0%)\n● Possible: macular star (24.3%)\n- Detected: AMD (1.0%)\n● Probable: cornea haze (1.2.3%)"


def test_entities_of_an_image():
    got = [(e["text"], e["type"], round(e["confidence"], 3), e["modality"], e["place"]) for e in entities.shown(IMAGE, 4)]
    oct_ = "optical coherence tomography"
    assert got == [(oct_, "imaging", 0.95, None, None), ("drusen", "finding", 0.79, oct_, "retina"), ("macular star", "finding", 0.223, oct_, "macula")]
    assert entities.shown("", 1) == [] and entities.shown("Detected Image Type: Some Camera", 1)[0]["text"] == "some camera"


@pytest.mark.parametrize(("answer", "names"), [
    (None, None), ("", None), ("nothing here", None), ("[broken", None), ('[{"text": "IOP", "confidence": 0.9}]', ["intraocular pressure"]), ("[]", []),
    ('Here: {"text": "Amd", "entity_type": "condition", "confidence": 0.8} done', ["age-related macular degeneration"]),
    ('[{"text": "timolol", "entity_type": "Drug", "confidence": 0.7}, {"text": "weak", "confidence": 0.4}, {"no": 1}, 5, {"text": "odd", "entity_type": "mood", "confidence": 1}]', ["timolol", "odd"]),
])
def test_entities_of_an_answer(answer, names):
    got = entities.said(answer, "answer", 1, 0.5)
    assert (None if got is None else [e["normalized"] for e in got]) == names
    if got and len(got) == 2:
        assert [e["type"] for e in got] == ["medication", "finding"]


def test_entities_are_merged():
    e = entities.entity
    image = [e("drusen", "finding", 0.9, "visual", 1, "drusen", "oct", "retina"), e("amd", "condition", 0.8, "visual", 1, "amd", "oct"), e("pain", "symptom", 0.6, "visual", 1)]
    spoken = [e("Drusen", "finding", 0.5, "answer", 2, "drusen"), e("AMD", "condition", 0.5, "answer", 2, "amd", None, "macula"), e("pain", "symptom", 0.55, "patient", 2), e("amd", "finding", 0.7, "patient", 2)]
    got = {(x["text"], x["type"]): x for x in entities.folded(image, spoken)}
    assert got["drusen", "finding"]["confidence"] == pytest.approx(0.95) and got["pain", "symptom"]["source"] == "patient"
    both = got["amd", "condition"]
    assert both["confidence"] == pytest.approx(0.7 * 0.8 + 0.3 * 0.5) and (both["source"], both["turn"], both["place"], both["modality"]) == ("merged", 2, "macula", "oct") and len(got) == 4
    # the surer one is the base, and only an image before an answer weighs more
    assert entities.merged(e("a", "condition", 0.5, "visual", 1), e("a", "condition", 0.9, "answer", None))["confidence"] == pytest.approx(0.6 * 0.9 + 0.4 * 0.5)


def test_turn_is_extracted(spark):
    rows = [
        (1, 1, "My eye is paining, no redness; roth spots and Blurry  vision.", "patient", IMAGE, None),
        (2, 2, "Consider acute angle closure of the lens", "answer", None, '[{"text": "acute angle closure", "entity_type": "condition", "confidence": 0.9}]'),
        (3, 3, None, "patient", None, None), (4, 4, "", "patient", None, "[]"),
    ]
    turns = spark.createDataFrame(rows, "key long, turn long, text string, source string, findings string, answer string")
    terms = [("paining", "eye pain", "symptom", 0.8, False), ("redness", "redness", "symptom", 0.8, True), ("roth spots", "roth spots", "finding", 0.8, False), ("blurry vision", "blurry vision", "symptom", 0.8, True), ("lens", "lens", "anatomy", 0.72, True), ("vis*", "vis", "procedure", 0.45, False)]
    got = entities.extract(turns, spark.createDataFrame(terms, "term string, name string, type string, confidence double, template boolean"), "key", findings="findings", answer="answer").orderBy("key", "no").collect()
    own = {(x.key, x.text, x.type): x for x in got}
    assert (1, "redness", "symptom") not in own and own[1, "roth spots", "symptom"].source == "patient_bridge" and own[1, "roth spots", "symptom"].confidence == 0.78
    assert own[1, "drusen", "finding"].region == "posterior" and own[1, "eye pain", "symptom"].confidence == 0.8 and own[1, "blurry vision", "symptom"].source == "patient"
    assert own[2, "acute angle closure", "condition"].priority == "A" and own[2, "lens", "anatomy"].region == "anterior" and {x.key for x in got} == {1, 2}
    assert [x.no for x in got if x.key == 1] == list(range(len([x for x in got if x.key == 1])))
    back = spark.createDataFrame(got).select(F.struct(*entities.FIELDS).alias("e")).select("e", entities.from_json(entities.to_json(F.col("e"))).alias("b"))
    assert all(x.e == x.b for x in back.collect())
    assert spark.range(1).select(entities.from_json(F.lit('{"text": "a", "type": "finding"}')).alias("e")).first().e.region == "unspecified"
    assert spark.range(1).select(entities.from_json(F.lit('{"text": "a", "type": "mood"}')).alias("e")).first().e is None


def states(*turns):
    s = sessions.empty_state()
    for turn, seen in enumerate(turns, 1):
        s = sessions.transition(s, turn, seen)
    return s


def test_condition_is_promoted_by_a_margin():
    s = states([("condition", "a", 0.5)], [("condition", "b", 0.64)])
    assert s["slots"]["condition"]["value"] == "a" and [o["value"] for o in s["others"]] == ["b"]
    # the second sighting: .64 is .2 above a, which has faded to .405
    s = sessions.transition(s, 3, [("condition", "b", 0.64)])
    assert s["slots"]["condition"]["value"] == "b" and [o["value"] for o in s["others"]] == [] or [o["value"] for o in s["others"]] == ["a"]
    # much surer: at once
    assert states([("condition", "a", 0.4)], [("condition", "b", 0.9)])["slots"]["condition"]["value"] == "b"
    # not surer: never
    assert states([("condition", "a", 0.8)], *[[("condition", "a", 0.8), ("condition", "b", 0.8)]] * 4)["slots"]["condition"]["value"] == "a"


def test_other_conditions_are_five():
    s = states([("condition", "a", 0.95)], [("condition", f"c{i}", 0.6) for i in range(8)])
    assert [o["value"] for o in s["others"]] == [f"c{i}" for i in range(3, 8)]
    # seen once and unsure, they go as they fade
    s = states([("condition", "a", 0.95)], [("condition", "b", 0.5)], [], [])
    assert s["others"] == [] and s["slots"]["condition"]["value"] == "a"


def test_imaging_is_replaced_at_once():
    s = states([("imaging", "oct", 0.9)], [("imaging", "OCT", 0.5)])
    assert s["slots"]["imaging"]["value"] == "OCT" and s["slots"]["imaging"]["n"] == 2
    assert states([("imaging", "oct", 0.9)], [("imaging", "Fundus Photo", 0.3)])["slots"]["imaging"] == {"value": "fundus photo", "c": 0.3, "n": 1, "last": 2}


def test_two_turns_of_a_complaint():
    """Symptoms of a first question stay in the context of a second one that says nothing."""
    s = states([("symptom", "eye pain", 0.8), ("symptom", "bleeding", 0.8)], [])
    assert sessions.context_terms(s) == ["eye pain", "bleeding"] and sessions.has_context(s)


def test_region_priority_and_images_are_admitted():
    s = states([("finding", "drusen", 0.1, "visual", "posterior", "B"), ("symptom", "pain", 0.9, "patient", "anterior", "C")], [("finding", "x", 0.2, "answer", "posterior", "routine")])
    assert s["priority"] == "B" and s["region"] == "anterior" and "finding:drusen" in s["pending"] and "finding:x" not in s["pending"]


def observed(r, n, start=0):
    return [(f"s{r.randrange(4)}", r.choice(["hall", "study", None]), r.choice(["condition", "symptom"]), r.choice("abc "), r.choice([0.2, 0.6, 0.9]), start + i) for i in range(n)]


OBSERVED = "subject string, room string, type string, value string, confidence double, ord long"


def loci(df):
    return sorted(str((x.subject, x.room, x.type, x.value, round(x.confidence, 6), x.evidence, x.first_ord, x.last_ord, x.superseded_by)) for x in df.collect())


def test_recorded_stream_equals_upsert(spark, tmp_path):
    """Batches of a stream give what all observations at once give; a batch that comes again or was killed changes nothing."""
    r, path, source = random.Random(5), str(tmp_path / "memory"), str(tmp_path / "in")
    rows = observed(r, 240)
    spark.createDataFrame(rows[:120], OBSERVED).coalesce(1).write.parquet(source)
    stream = lambda: recorder.record(spark.readStream.schema(OBSERVED).parquet(source), path, str(tmp_path / "c"), buckets=4)
    stream().awaitTermination(120)
    first = loci(recorder.load(spark, path))
    assert first == loci(memory.upsert(spark.createDataFrame(rows[:120], OBSERVED)))
    assert not recorder.apply_batch(spark.createDataFrame(rows[:120], OBSERVED), 0, path, buckets=4) and loci(recorder.load(spark, path)) == first
    # killed after its data, before its manifest
    later = spark.createDataFrame(rows[120:], OBSERVED)
    later.select("subject").write.parquet(f"{path}/data/batch=1")
    assert loci(recorder.load(spark, path)) == first
    later.coalesce(1).write.mode("append").parquet(source)
    stream().awaitTermination(120)
    assert loci(recorder.load(spark, path)) == loci(memory.upsert(spark.createDataFrame(rows, OBSERVED)))
    assert recorder.apply_batch(later.limit(0), 2, path, buckets=4) and len(recorder.manifest(spark, path)) <= 4


def test_batch_rewrites_what_it_touches(spark, tmp_path):
    path = str(tmp_path)
    for n, s in enumerate(("a", "b", "c", "a")):
        recorder.apply_batch(spark.createDataFrame([(s, "hall", "symptom", "x", 0.5, n)], OBSERVED), n, path, buckets=64)
    assert sorted(recorder.manifest(spark, path).values()) == [1, 2, 3]
    assert {x.subject: x.evidence for x in recorder.load(spark, path).collect()} == {"a": 2, "b": 1, "c": 1}


def test_memory_by_vectors(spark, tmp_path):
    rows = [("s", "hall", "symptom", "Pain", [1.0, 0.0], 0.9, "patient", 1), ("s", "hall", "symptom", "pain ", [0.9, 0.1], 0.9, "patient", 2), ("s", "study", "symptom", "pain", [1.0, 0.1], 0.9, "answer", 3), ("s", None, "symptom", "itch", [0.0, 1.0], 0.9, "patient", 4),
        ("t", "hall", "symptom", "other", [1.0, 0.0], 1.0, "patient", 5), ("s", "hall", "symptom", "zero", [0.0, 0.0], 1.0, "patient", 6), ("s", "hall", "symptom", " ", [1.0, 0.0], 1.0, "patient", 7), ("s", "hall", "symptom", "null", None, 1.0, "patient", 8)]
    held = spark.createDataFrame(rows, "subject string, room string, type string, value string, vector array<double>, confidence double, source string, ord long")
    asked = spark.createDataFrame([(1, "s", None, [2.0, 0.0]), (2, "s", ["study"], [1.0, 0.0]), (3, "u", None, [1.0, 0.0]), (4, "s", [], [0.0, 0.0])], "query_id long, subject string, rooms array<string>, vector array<double>")
    got = [(x.query_id, x.rank, x.ord) for x in memory.nearest(held, asked).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 1), (1, 2, 3), (1, 3, 4), (2, 1, 3)]
    memory.keep_vectors(held, str(tmp_path / "v"), buckets=8)
    kept = memory.kept_vectors(spark, str(tmp_path / "v"), asked, buckets=8)
    assert sorted(map(tuple, memory.nearest(kept, asked).collect())) == sorted(map(tuple, memory.nearest(held, asked).collect()))
    one = asked.where("query_id = 2")
    plan = memory.nearest(memory.kept_vectors(spark, str(tmp_path / "v"), one, buckets=8), one)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet", plan)) == 1 and re.search(r"PartitionFilters: \[[^]]*bucket", plan) and re.search(r"PushedFilters: \[[^]]*room", plan)


def test_memory_by_vectors_meets_in_tiles(spark, monkeypatch):
    """What leaves the tiles is what a join of all pairs ranks first, with ties, copies, missing rooms and vectors that are no numbers or of another length, and little more."""
    for name, n in (("TILE", 11), ("ASKED", 5), ("BLOCK", 3)):
        monkeypatch.setattr(memory, name, n)
    rng = random.Random(3)
    vector = lambda: [rng.choice([0.1, 0.7, -0.3, 1.0]) for _ in range(3)]
    rows = [(rng.choice("sssst"), rng.choice(["hall", "study", None]), "symptom", str(i % 7), vector(), 0.5, "patient", i) for i in range(150)]
    rows += [("s", "hall", "symptom", "nan", [float("nan"), 1.0, 0.0], 0.5, "patient", 900), ("s", "hall", "symptom", "long", [1.0] * 4, 0.5, "patient", 901), ("s", "hall", "symptom", "missing", [1.0, None, 0.0], 0.5, "patient", 902)]
    rows += [("s", "hall", "symptom", "copy", [0.3, 0.2, 0.9], 0.5, "patient", 1000 + i) for i in range(30)] + [(None, "hall", "symptom", "nobody", [1.0, 0.0, 0.0], 0.5, "patient", 903)]
    held = spark.createDataFrame(rows, "subject string, room string, type string, value string, vector array<double>, confidence double, source string, ord long")
    queries = [(i, rng.choice(["s", "s", "t", "u", None]), rng.choice([None, ["hall", "study"], ["study"]]), vector()) for i in range(25)] + [(99, "s", None, [0.3, 0.2, 0.9])]
    asked = spark.createDataFrame(queries, "query_id long, subject string, rooms array<string>, vector array<double>")
    length = lambda c: F.sqrt(dot(F.col(c), F.col(c)))
    own = asked.select("query_id", "subject", F.explode_outer("rooms").alias("_asked"), F.col("vector").alias("_q")).withColumn("_qn", length("_q")).where("_qn > 0")
    some = held.withColumn("_n", length("vector")).where("_n > 0")
    order = Window.partitionBy("query_id", "_asked").orderBy("distance", "ord")

    def first(pairs):
        pairs = pairs.withColumn("distance", F.abs(F.round("distance", 6)))
        return sorted((x.query_id, x._asked or "", x.r, x.ord, x.value, repr(x.distance)) for x in pairs.withColumn("r", F.row_number().over(order)).where("r <= 18").collect())

    joined = own.join(some, "subject").where("(_asked is null or _asked = room) and size(vector) = size(_q)").withColumn("distance", 1 - dot(F.col("vector"), F.col("_q")) / (F.col("_n") * F.col("_qn")))
    tiled = memory.near_candidates(some, own, 18)
    assert first(tiled) == first(joined) and len({x[0] for x in first(tiled)}) > 10
    few = memory.near_candidates(some, own, 2)
    assert few.count() < joined.count() / 2 and "CoGroups" in few._jdf.queryExecution().executedPlan().toString()
    assert memory.nearest(held, asked.limit(0)).count() == memory.nearest(held.limit(0), asked).count() == 0


def test_merging_is_recording_without_python_groups(spark):
    rng = random.Random(5)
    made = lambda start, n: [(rng.choice("ab"), rng.choice(["hall", "study", None, ""]), rng.choice(["condition", "symptom", None]), rng.choice("xyz"), rng.randrange(5, 100) / 100, start + i) for i in range(n)]
    held, want = spark.createDataFrame([], memory.LOCUS), {}
    for rows in (made(0, 90), made(90, 60), made(150, 1)):
        out = memory.merged(held, spark.createDataFrame(rows, OBSERVED))
        assert "InPandas" not in out._jdf.queryExecution().toString()
        for s, room, kind, value, c, at in rows:
            key = s, room or "", kind or ""
            want[key] = memory.recorded(want.get(key, []), [(at, value, c)], key[2] in memory.EXCLUSIVE and key[1] != "")
        got = sorted((x.subject, x.room or "", x.type, x.value, round(x.confidence, 9), *x[5:]) for x in out.collect())
        assert got == sorted((*k, r[0], round(r[1], 9), *r[2:]) for k, v in want.items() for r in v)
        held = spark.createDataFrame(out.collect(), memory.LOCUS)


def test_phrases_take_small_batches(spark):
    """Texts come to the automaton in batches of a bounded size, whatever a session had set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    texts, words = spark.createDataFrame([(1, "a b"), (2, None)], "key long, text string"), spark.createDataFrame([("b",)], "phrase string")
    assert [x.key for x in automaton.phrase_hits(texts, ["key"], "text", words, "phrase").collect()] == [1]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000" and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(4 << 20)
