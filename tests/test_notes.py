"""Line cleaners, notes, readers of article answers, sinks and the two-anchor context on small cases."""

import json

from pyspark.sql import functions as F

from corpusflow.functions import notes as N
from corpusflow.operators import evidence
from corpusflow.sources import readers, sinks


def one(spark, make, text):
    return spark.createDataFrame([(text,)], "t string").select(make(F.col("t")).alias("r")).first()["r"]


def test_guideline_text(spark):
    body = ["Front matter", "P12", "Academy Staff", "", "", "INTRODUCTION", "", "", "© 2020 American Academy of Ophthalmology", "Text of it", "References", "after"]
    assert one(spark, N.guideline_text, "\n".join(body)) == "INTRODUCTION\n\nText of it\nReferences\nafter"
    late = ["Diagnosis"] + [f"line {i}" for i in range(130)] + ["Appendix A", "gone"]
    assert one(spark, N.guideline_text, "\n".join(late)) == "\n".join(late[:-2])
    assert one(spark, N.guideline_text, None) == "" and one(spark, N.guideline_text, "P1") == ""


def test_manual_text(spark):
    said = "This line is longer than twenty-four characters."
    lines = ["View Patient Education", said, "", said, "By Anna Example, MD", "v123", "Video", "a | b", "short", "short", "Copyright 2024", "gone"]
    assert one(spark, N.manual_text, "\n".join(lines)) == f"{said}\n\nshort\nshort"
    assert one(spark, N.manual_text, "copyright") == "" and one(spark, N.manual_text, None) == ""


def test_transcript(spark):
    assert one(spark, N.transcript, "my eye hurts My eye hurts my eye hurts badly. Thanks for watching.") == "my eye hurts badly."
    assert one(spark, N.transcript, "my eye hurts my eye hurts today too") == "my eye hurts my eye hurts today too"
    assert one(spark, N.transcript, " you ") == "" and one(spark, N.transcript, None) == ""
    assert one(spark, N.transcript, "a+ (b a+ (b a+ (b c d") == "a+ (b c d"


def test_findings_and_terms(spark):
    text = "Detected Image Type: OCT (Optical)\n● Probable: drusen (45.2%)\n○ Possible: edema (8%)\n● Probable: scar (20.0%)\n● Probable: hole (16%)"
    got = one(spark, N.findings, text)
    assert got["modality"] == "OCT" and [(c["name"], c["confidence"], round(c["score"], 4)) for c in got["conditions"]][:2] == [("drusen", "probable", 0.452), ("edema", "possible", 0.08)]
    assert one(spark, lambda c: N.finding_terms(N.findings(c)), text) == "OCT drusen scar"
    assert one(spark, lambda c: N.finding_terms(N.findings(c)), "nothing") == ""


def test_entities_said(spark):
    said = 'Here: [{"text": "timolol", "entity_type": "Drug", "confidence": 0.8}, {"text": "x", "confidence": 0.2}, {"entity_type": "sign", "confidence": 1}] done'
    assert [(e["text"], e["entity_type"], e["region"]) for e in one(spark, N.entities_said, said)] == [("timolol", "medication", "unspecified")]
    assert [e["text"] for e in one(spark, N.entities_said, 'only {"text": "a", "confidence": 0.5} here')] == ["a"]
    assert one(spark, N.entities_said, "no json") == [] and one(spark, N.entities_said, None) == [] and one(spark, N.entities_said, "[broken") == []


def test_claim_lines(spark):
    text = "Possible causes of this:\nAccording to the texts, the lens is cloudy.\nPlease see a specialist about this.\nshort"
    assert one(spark, N.claim_lines, text) == ["the lens is cloudy."]


def test_history_block(spark):
    def block(q):
        return spark.createDataFrame([(q,)], "q array<string>").select(N.history_block(F.col("q")).alias("r")).first()["r"]

    assert block([]) == "" and block(["a"]) == "Patient: a\n\n"
    assert block(list("abcdefghi")) == "- c\n- d\n- e\n- f\n- g\nPatient: h\nPatient: i\n\n"


def test_tagged_by_text_or_parent(spark):
    own = spark.createDataFrame([(1, "Macular edema of the retina"), (2, "drusen"), (3, "unknown"), (4, None)], "id int, text string")
    got = {r["id"]: (r["region"], r["priority"]) for r in evidence.tagged(own, "id", "text", spark.createDataFrame([("drusen", "macula")], "text string, anatomy string")).collect()}
    assert got == {1: ("posterior", "B"), 2: ("posterior", "unspecified"), 3: ("unspecified", "unspecified"), 4: ("unspecified", "unspecified")}


def test_ask_context_falls_back(spark):
    docs = spark.createDataFrame([(i, f"word{i} shared text") for i in range(40)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "word1 shared"), (2, "word20")], "item_id long, text string")
    hits = lambda rows: spark.createDataFrame(rows, "item_id long, doc_id long, rank long")
    got = evidence.ask_context(hits([(1, 11, 1), (1, 1, 2)]), hits([(1, 1, 1), (1, 12, 2)]), hits([(1, 30, 1), (2, 20, 1)]), docs, queries, F.floor(F.col("doc_id") / 10), 2)
    assert sorted((r["item_id"], r["parent_id"], r["doc_id"], r["parent_rank"]) for r in got.collect()) == [(1, 0, 1, 1), (1, 1, 11, 2), (2, 2, 20, 1)]


def test_surviving_keeps_all_noise_when_alone(spark):
    hits = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 3, True)], "item_id int, doc_id int, bad boolean")
    assert sorted(r["doc_id"] for r in evidence.surviving(hits, F.col("bad")).collect()) == [2, 3]


def test_article_readers(spark, tmp_path):
    long = "An abstract <b>of</b> some length. " * 5
    (tmp_path / "a.json").write_text(json.dumps({"resultList": {"result": [{"id": "7", "title": "T", "abstractText": long, "pubYear": "2020"}, {"pmid": "9", "abstractText": "short"}]}}))
    (tmp_path / "b.json").write_text(json.dumps({"data": [{"paperId": "p", "abstract": long, "year": 2021, "authors": [{"name": n} for n in "ABCD"], "externalIds": {"DOI": "10.1/x"}}, {"paperId": "q", "abstract": long, "externalIds": {"PubMed": "123"}}]}))
    (tmp_path / "c.xml").write_text(f'<r><document><content name="title">Dry eye</content><content name="FullSummary">&lt;p&gt;{"Summary text. " * 6}&lt;/p&gt;</content></document></r>')
    a = readers.result_pages(spark, str(tmp_path / "a.json")).collect()
    assert [(r["pmid"], r["journal"], r["year"]) for r in a] == [("EPMC_7", "Unknown Journal", "2020")] and "<b>" not in a[0]["abstract"]
    b = readers.paper_pages(spark, str(tmp_path / "b.json")).collect()
    assert [(r["pmid"], r["authors"], r["year"]) for r in b] == [("S2_10.1/x", "A, B, C et al.", "2021"), ("123", "", "Unknown")]
    assert [(r["title"], r["summary"][:7]) for r in readers.topics_xml(spark, str(tmp_path / "c.xml")).collect()] == [("Dry eye", "Summary")]


def test_preferred_and_settings(spark, tmp_path):
    (tmp_path / "x_sanitized.md").write_text("a")
    (tmp_path / "s.json").write_text('{"k": "5"}')
    assert [p.rsplit("/", 1)[1] for p in readers.preferred(spark, str(tmp_path / "x.md"), str(tmp_path / "y.md"))] == ["x_sanitized.md", "y.md"]
    assert readers.settings(spark, str(tmp_path / "s.json"), {"k": "3", "m": "a"}) == {"k": "5", "m": "a"}


def test_sessions_keep_the_latest(spark, tmp_path):
    p = str(tmp_path / "s")
    rows = lambda x: spark.createDataFrame(x, "session_id int, turn int, v string")
    assert sinks.load_sessions(spark, p) is None
    sinks.save_sessions(rows([(1, 1, "a"), (2, 1, "b")]), p)
    sinks.save_sessions(rows([(1, 2, "c")]), p)
    assert sorted((r["session_id"], r["v"]) for r in sinks.load_sessions(spark, p).collect()) == [(1, "c"), (2, "b")]


def test_sanitized_dry_run_writes_nothing(spark, tmp_path):
    lines = spark.createDataFrame([(1, 0, "a", False), (1, 1, "\\# b", True)], "doc_id int, line_no int, line string, neutralised boolean")
    assert tuple(sinks.sanitized(lines, str(tmp_path / "o"), dry_run=True).first()) == (2, 1)
    assert not (tmp_path / "o").exists()
    sinks.sanitized(lines, str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2


def test_articles_by_category(spark, tmp_path):
    rows = [("c", "T", "1", "Who, 2020", [f"k{i}" for i in range(10)]), ("d", "U", "2", "Who", [])]
    sinks.articles(spark.createDataFrame(rows, "category string, title string, id string, citation string, keywords array<string>"), str(tmp_path / "a"))
    got = "\n".join(f.read_text() for f in (tmp_path / "a" / "category=c").glob("*.txt"))
    assert got.strip() == "## T (PMID: 1)\n*Who, 2020*\nKeywords: " + ", ".join(f"k{i}" for i in range(8))
