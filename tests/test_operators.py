"""Golden cases and properties of operators that SQL doesn't express."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusflow.functions import metrics, rules, text
from corpusflow.operators import corpus, dictionary, grounding, memory, retrieval, sessions
from corpusflow.sources import readers, sinks


LONG = "A sentence " + "of many words " * 25 + "ends."


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (text.clean_text, "a &amp;&nbsp;b\r\n\n\n\n c\t d ", "a & b\n\n c d"),
        (text.normalize_for_hash, " Hello,  World! ", "hello world"),
        (text.strip_html, "<p>A</p><script>x()</script><b>B</b>", "A\nB"),
        (text.sanitize_heading, "..: Title; ", "Title"),
        (text.sanitize_heading, ".. ", "Untitled"),
        (text.strip_wikitext, "{{x}}'''Bold''' [[a|b]] [[c]]<ref>r</ref>", "Bold b c"),
        (text.strip_wikitext, "{{a|{{b|{{c}}}}|d}}Kept{{x|{y}z}} too", "Kept too"),
        (text.collapse_repeats, "This is said. This is said. Then that.", "This is said. This is said. Then that."),
        (text.collapse_repeats, "This is said again and again here. This is said again and again here. Then that.", "This is said again and again here. Then that."),
        (text.collapse_repeats, f"{LONG} {LONG}\n{LONG} End", f"{LONG} End"),
        (text.collapse_repeats, "So it is As we were told by all of them here. As we were told by all of them here. then", "So it is As we were told by all of them here. then"),
        (text.collapse_repeats, "as we were told by all of them here. as we were told by all of them here.", "as we were told by all of them here. as we were told by all of them here."),
        (text.title_from_text, "First one. Second.", "First one."),
        (text.strip_option, "A. yes", "yes"),
        (lambda c: text.slug("wing", c), "A b/C", "wing_a_b_c"),
    ],
)
def test_text(spark, f, given, want):
    assert one(spark, given, f) == want


def test_collapse_repeats_against_plain():
    r = random.Random(2)
    for _ in range(3000):
        given = plain = "".join(r.choice(["One two", " three four five six seven", "Two", ".", "!", " ", "\n", ". One two three four five six.", " One two three four five six."]) for _ in range(r.randrange(14)))
        before = None
        while plain != before:
            before, plain = plain, re.sub(r"([A-Z][^.!?]{25,}?[.!?])(?:\s+\1)+", r"\1", plain)
        assert text.without_repeats(given) == plain, given


def test_sections(spark):
    md = "intro line that is long enough to be kept as a section of its own, surely\n# One\nshort\n## Two\n" + "body " * 20 + "\n### not a boundary\n# 1. See http://x.y\nmore"
    got = corpus.sections(spark.createDataFrame([(1, "Src", md)], "doc_id long, source string, text string")).orderBy("section_no").collect()
    assert [(r.chapter, r.section, r.path) for r in got] == [("Src", "Src", "Src"), ("One", "Two", "One > Two")]
    assert "### not a boundary" in got[1].body and "http://x.y" in got[1].body


def test_chunks_of_equal_distances_do_not_break(spark):
    s = "Alpha beta gamma delta epsilon zeta eta theta. " * 5
    got = corpus.chunks(spark.createDataFrame([(1, "s", s.strip()), (2, "s", "Short. One.")], "doc_id long, source string, text string")).collect()
    assert [(r.doc_id, r.sentences) for r in got] == [(1, 5)]


def test_decay_compounds():
    state = sessions.transition(sessions.empty_state(), 1, [("anatomy", "lens", 0.8)])
    got = []
    for turn in range(2, 8):
        state = sessions.transition(state, turn, [])
        got.append(round(state["slots"]["anatomy"]["c"], 4) if "anatomy" in state["slots"] else None)
    assert got == [0.72, 0.5832, 0.4252, 0.2789, 0.1647, None]


def test_shift_needs_a_second_sighting():
    s = sessions.transition(sessions.empty_state(), 1, [("condition", "a", 0.5)])
    s = sessions.transition(s, 2, [("condition", "b", 0.7)])
    assert s["slots"]["condition"]["value"] == "a"
    s = sessions.transition(s, 3, [("condition", "b", 0.7)])
    assert s["slots"]["condition"]["value"] == "b" and s["drift"]


def test_item_is_staged_then_promoted():
    s = sessions.transition(sessions.empty_state(), 1, [("symptom", "pain", 0.6)])
    assert not s["items"] and len(s["pending"]) == 1
    s = sessions.transition(s, 2, [("symptom", "pain", 0.6)])
    assert list(s["items"]) == ["symptom:pain"] and not s["pending"]


def test_stream_equals_fold(spark, tmp_path):
    from corpusflow.streaming.turns import session_states

    rows = [(c, t, [("condition", "ab"[(c + t) % 2], 0.5 + t / 10)]) for c in range(3) for t in range(4)]
    schema = "conv_id long, turn long, entities array<struct<type:string,value:string,confidence:double>>"
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = session_states(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = sorted(map(tuple, sessions.fold(df).collect()))
    assert sorted(map(tuple, spark.table("states").collect())) == want and len(want) == 12


def test_stream_with_event_time_ends(spark, tmp_path):
    """A session that comes back long after the watermark passed it begins anew, and the run ends."""
    from corpusflow.streaming.turns import session_states

    schema = "conv_id long, turn long, ts timestamp, entities array<struct<type:string,value:string,confidence:double>>"
    for conv, turn, ts, c in ((1, 1, "2024-01-01 00:00:00", 0.5), (2, 1, "2024-01-03 00:00:00", 0.5), (1, 2, "2024-01-04 00:00:00", 0.7)):
        entity = f"array(named_struct('type', 'condition', 'value', 'a', 'confidence', {c}D))"
        spark.sql(f"SELECT {conv}L AS conv_id, {turn}L AS turn, timestamp'{ts}' AS ts, {entity} AS entities").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = session_states(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "ts")
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    got = {(r["conv_id"], r["turn"]): r["confidence"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, 1): 0.5, (2, 1): 0.5, (1, 2): 0.7}


def test_event_window_stream(spark, sf, tmp_path):
    from corpusflow.streaming.turns import event_windows

    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = event_windows(stream).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("windows").agg(F.sum("n")).first()[0] == events.count()


def test_upsert_supersedes_and_restarts(spark):
    rows = [(1, "r", "condition", "a", 0.8, 1), (1, "r", "condition", "a", 0.4, 2), (1, "r", "condition", "b", 0.6, 3), (1, "r", "condition", "a", 0.9, 4), (1, None, "condition", "c", 0.5, 5), (1, "r", "condition", " ", 0.5, 6)]
    got = memory.upsert(spark.createDataFrame(rows, "subject long, room string, type string, value string, confidence double, ord long")).orderBy("first_ord").collect()
    assert [(r.value, r.confidence, r.evidence, r.superseded_by) for r in got] == [("a", 0.66, 2, 3), ("b", 0.6, 1, 4), ("a", 0.9, 1, -1), ("c", 0.5, 1, -1)]


def test_grounding(spark):
    context = "the pressure inside the eye damages the nerve over time and slowly"
    rows = [(1, "The pressure inside the eye damages the nerve.", context), (2, "Bananas grow on very tall purple mountains nowhere.", context), (3, "I don't know.", context), (4, "The pressure inside the eye damages the nerve.", "")]
    got = {r.id: r.verdict for r in grounding.verdicts(spark.createDataFrame(rows, "id long, a string, c string"), "id", "a", "c").collect()}
    assert got == {1: "PASS", 2: "FAIL", 3: "PASS", 4: "FAIL"}


def test_weighted_fold_and_bridge(spark):
    e = spark.createDataFrame([([("finding", 0.8), ("finding", 0.5), ("symptom", 0.4)],)], "e array<struct<type:string,confidence:double>>")
    assert e.select(dictionary.weighted_fold(F.col("e"))).first()[0] == pytest.approx(0.4)
    hits = spark.createDataFrame([(1, "red eye sign", "finding", 0.8), (2, "red eye sign", "finding", 0.8), (2, "redness", "symptom", 0.7)], "k long, name string, type string, confidence double")
    aliases = spark.createDataFrame([("red eye", "redness")], "finding string, symptom string")
    got = dictionary.bridge(hits, aliases, "k").where("type = 'symptom'").orderBy("k").collect()
    assert [(r.k, round(r.confidence, 2)) for r in got] == [(1, 0.72), (2, 0.7)]


def test_lcs():
    assert metrics.lcs_length(list("abcbdab"), list("bdcaba")) == 4
    assert metrics.lcs_length([], list("x")) == 0


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "my_book_clean.md").write_text("# T\nbody")
    assert readers.text_files(spark, str(tmp_path / "my_book_clean.md")).select("source", "text").first() == ("My Book", "# T\nbody")
    (tmp_path / "labels.txt").write_text("# c\n\nfundus, glaucoma\n")
    assert [r.label for r in readers.labels(spark, str(tmp_path / "labels.txt")).collect()] == ["fundus, glaucoma"]
    for name, v in (("r_1.json", 1), ("r_2.json", 2)):
        (tmp_path / name).write_text(json.dumps({"v": v}))
    assert readers.latest(spark, str(tmp_path / "r_*.json"), "v int").first().v == 2
    (tmp_path / "a.xml").write_text(f"<Set><Article><PMID>1</PMID><Title>T</Title><Abstract Label='AIM'>{'x' * 120}</Abstract><Author>A</Author><Author>B</Author><Author>C</Author><Author>D</Author></Article></Set>")
    assert tuple(readers.articles_xml(spark, str(tmp_path / "a.xml")).select("pmid", "authors").first()) == ("1", "A, B, C et al.")
    (tmp_path / "x.bin").write_bytes(b"RIFF1234")
    assert readers.bytes_of(spark, str(tmp_path / "x.bin")).first().kind == "wav"
    records = spark.createDataFrame([("g", "T", {"b": "2", "a": "1"}, "text", 1), ("g", "U", {}, "more", 2)], "source_group string, title string, metadata map<string,string>, content string, id int")
    sinks.markdown(records, str(tmp_path / "md"))
    assert "*a=1; b=2*" in "\n".join(r.value for r in spark.read.text(str(tmp_path / "md")).collect())
    assert sinks.append_new(records.limit(1), str(tmp_path / "inc"), "id").count() == 1
    assert sinks.append_new(records.unionByName(records), str(tmp_path / "inc"), "id").count() == records.count() - 1
    assert sinks.append_new(records, str(tmp_path / "inc"), "id").count() == 0
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "inc")).collect()) == [1, 2]


def test_normalize_query(spark):
    got = one(spark, "```The OD [pain] pain in THEE eye```", lambda c: rules.normalize_query(c, {"thee": "the"}, ("the",), (), ("od",)))
    assert got == "od pain eye"


def test_bm25_of_tasks_is_that_of_joins(spark, monkeypatch):
    """What tasks keep is what all joined scores give: in small slices, with words in most documents, null and empty texts; questions don't meet documents by a join."""
    r = random.Random(3)
    text = lambda n: " ".join(r.choice(["the", "the", "The", *"abcdefgh"]) for _ in range(n))
    docs = spark.createDataFrame([(i, [None, "", text(5 + i % 7)][min(i % 9, 2)]) for i in range(300)], "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(i, text(6) if i else None) for i in range(20)] + [(99, "zz")], "item_id long, text string")
    pairs = asked.select("item_id", F.explode(retrieval.words(F.col("text"))).alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times"))
    want = retrieval.top_k(retrieval.joined_scores(docs, pairs), "item_id", [F.desc("score"), F.asc("doc_id")], 4)
    want = sorted((x.item_id, x.rank, x.doc_id, x.score) for x in want.collect())
    for size in (1 << 20, 50):
        monkeypatch.setattr(retrieval, "SCORES", size)
        got = retrieval.bm25_top_k(docs, asked, 4)
        assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted((x.item_id, x.rank, x.doc_id, x.score) for x in got.collect()) == want and len(want) == 76
    stored = retrieval.term_statistics(docs).where("term != 'a'").withColumn("idf", F.col("idf") + 1)
    want = retrieval.top_k(retrieval.joined_scores(docs, pairs, stored), "item_id", [F.desc("score"), F.asc("doc_id")], 4).collect()
    assert sorted(map(str, retrieval.bm25_top_k(docs, asked, 4, stored).collect())) == sorted(str(x) for x in retrieval.top_k(spark.createDataFrame(want).drop("rank"), "item_id", [F.desc("score"), F.asc("doc_id")], 4).withColumn("rank", F.col("rank").cast("long")).collect())
    assert retrieval.bm25_top_k(docs.limit(0), asked).count() == 0 == retrieval.bm25_top_k(docs, asked.limit(0)).count()


def test_term_statistics_in_small_tasks(spark, monkeypatch):
    """Few terms are held at a time, and the counts are the same."""
    docs = spark.createDataFrame([(i, f"w{i} w{i % 7} x") for i in range(400)], "doc_id long, text string")
    want = {x.term: (x.df, round(x.idf, 9)) for x in retrieval.term_statistics(docs).collect()}
    assert retrieval.COUNTED <= 1 << 17 and want["x"][0] == 400
    monkeypatch.setattr(retrieval, "COUNTED", 5)
    assert {x.term: (x.df, round(x.idf, 9)) for x in retrieval.term_statistics(docs).collect()} == want
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 1000
