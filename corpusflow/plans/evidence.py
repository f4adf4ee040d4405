"""Registered queries of line cleaners, notes, memory, tags, two-anchor retrieval and reports, and DuckDB SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import notes as N
from ..functions import rules as R
from ..functions import text as X
from ..operators import anatomy, corpus, dictionary, evidence, retrieval
from ..session import small_side, table
from .clinical import _NLI, _any, _q, _VALUES, verdicts_of
from .registry import _QT, BM25, METRICS, _sql_clean, metrics_of, query

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_LINES = rf"""l AS (SELECT doc_id, pos, {_STRIP.format("x")} AS x FROM (SELECT doc_id, unnest(a) AS x, generate_subscripts(a, 1) AS pos FROM (SELECT doc_id, string_split({_sql_clean("coalesce(text, '')")}, chr(10)) AS a FROM documents)))"""
_JOIN = rf"""b AS (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM g), j AS (SELECT doc_id, {_STRIP.format("string_agg(x, chr(10) ORDER BY i) FILTER (x <> '' OR p IS NULL OR p <> '')")} AS t FROM b GROUP BY doc_id)
SELECT doc_id, md5(coalesce(t, '')) AS hash FROM documents LEFT JOIN j USING (doc_id)"""
_DROP = _q("(?i)" + "|".join(N.GUIDELINE_DROP))


@query(f"""WITH {_LINES}, k AS (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i FROM l WHERE x = '' OR NOT (lower(x) IN ({", ".join(f"'{e}'" for e in N.GUIDELINE_EXACT)}) OR regexp_matches(x, '{_DROP}'))),
a AS (SELECT doc_id, coalesce(min(i) FILTER (regexp_matches(lower(x), '{"|".join((*N.GUIDELINE_ANCHORS, "license"))}')), 350) AS a FROM k GROUP BY doc_id),
f AS (SELECT doc_id, x, i - CASE WHEN a < 350 THEN a ELSE 0 END AS i FROM k JOIN a USING (doc_id) WHERE a >= 350 OR i >= a),
t AS (SELECT doc_id, coalesce(min(i) FILTER (regexp_matches(lower(x), '{"|".join((*N.GUIDELINE_TAILS, "copyright"))}')), 0) AS t FROM f GROUP BY doc_id),
g AS (SELECT f.* FROM f JOIN t USING (doc_id) WHERE t <= 120 OR i < t), {_JOIN}""")
def guideline_lines(spark, d):
    """Front matter ends here also at a license line, tails begin also at a copyright."""
    t = N.guideline_text(F.col("text"), (*N.GUIDELINE_ANCHORS, "license"), (*N.GUIDELINE_TAILS, "copyright"))
    return table(spark, d, "documents").select("doc_id", F.md5(t).alias("hash"))


_NORM = r"trim(regexp_replace(regexp_replace(lower(x), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(rf"""WITH {_LINES}, e AS (SELECT doc_id, min(pos) AS e FROM l WHERE regexp_matches(lower(x), '{"|".join(N.MANUAL_TAILS)}') GROUP BY doc_id),
k AS (SELECT l.*, {_NORM} AS n FROM l LEFT JOIN e USING (doc_id) WHERE (e IS NULL OR pos < e) AND (x = '' OR NOT (regexp_matches(lower(x), '{"|".join(N.MANUAL_CONTAINS)}') OR (contains(x, '|') AND length(x) <= 90) OR regexp_matches(lower(x), '{"|".join(N.MANUAL_DROP)}')))),
s AS (SELECT doc_id, pos FROM (SELECT *, lag(n) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM k WHERE n <> '') WHERE n = before AND length(n) > 24),
g AS (SELECT doc_id, x, pos AS i FROM k ANTI JOIN s USING (doc_id, pos)), {_JOIN}""")
def manual_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(N.manual_text(F.col("text"))).alias("hash"))


_SAID = "CASE WHEN turn % 2 = 0 THEN left(coalesce(text, ''), 24) || ' ' || left(coalesce(text, ''), 24) || ' ' || left(coalesce(text, ''), 24) || ' ' ELSE '' END || coalesce(text, '') || ' Thanks for watching.'"


@query(rf"""WITH o AS (SELECT conv_id, turn, regexp_replace({_SAID}, '(?i){"|".join(N.TRANSCRIPT_STOCK)}', '', 'g') AS o FROM conversations), w AS (SELECT *, list_filter(string_split_regex(o, '\s+'), lambda x: x <> '') AS w FROM o),
p AS (SELECT *, array_to_string(w, ' ') AS s, CASE WHEN len(w) > 6 THEN list_transform(range(2, least(len(w) // 2, 14) + 1), lambda n: array_to_string(w[1:n], ' ')) ELSE [] END AS ps FROM w),
f AS (SELECT *, list_filter(ps, lambda p: regexp_matches(s, '^(?i)(?:' || regexp_escape(p) || ' ?){{3,}}'))[1] AS p FROM p)
SELECT conv_id, turn, md5({_STRIP.format("coalesce(p || ' ' || regexp_replace(s, '^(?i)(?:' || regexp_escape(p) || ' ?){3,}', ''), o)")}) AS hash, p IS NOT NULL AS looped FROM f""".replace("{{", "{").replace("}}", "}"))
def transcripts(spark, d):
    """Turns as transcripts; every other one begins with a phrase that is said again and again."""
    t = F.coalesce("text", F.lit(""))
    head = F.concat(F.left(t, F.lit(24)), F.lit(" "))
    own = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.when(F.col("turn") % 2 == 0, F.repeat(head, F.lit(3))).otherwise(""), t, F.lit(" Thanks for watching.")).alias("said"))
    stock = F.regexp_replace("said", "(?i)" + "|".join(N.TRANSCRIPT_STOCK), "")
    out = own.select("conv_id", "turn", N.transcript(F.col("said")).alias("t"), stock.alias("o"))
    return out.select("conv_id", "turn", F.md5("t").alias("hash"), (F.col("t") != N.stripped(F.col("o"))).alias("looped"))


_FOUND = "'Detected Image Type: OCT (' || event_type || ')' || chr(10) || '● Probable: ' || event_type || ' ' || (user_id % 7) || ' (' || (event_id % 100) || '.5%)' || chr(10) || CASE WHEN value > 100 THEN '○ Possible' ELSE '● Probable' END || ': user ' || user_id || ' (' || (user_id % 15) || '%)'"


@query(f"""WITH f AS (SELECT event_id, {_FOUND} AS t FROM events), p AS (SELECT *, regexp_extract_all(t, '{N.CONDITION}', 1) AS k, regexp_extract_all(t, '{N.CONDITION}', 2) AS n, regexp_extract_all(t, '{N.CONDITION}', 3) AS s FROM f),
c AS (SELECT event_id, k, n, unnest(s)::DOUBLE / 100 AS s FROM p), m AS (SELECT event_id, sum(s) AS total FROM c GROUP BY event_id)
SELECT event_id, regexp_extract(t, 'Detected Image Type:\\s*(\\S+)', 1) AS modality, len(n)::INT AS n, round(total, 6) AS total, 'OCT ' || n[1] || CASE WHEN k[2] = 'Probable' THEN ' ' || n[2] ELSE '' END AS terms FROM p JOIN m USING (event_id)""".replace("\\\\", "\\"))
def findings_terms(spark, d):
    """Texts of findings, written from events, read back."""
    text = F.expr(_FOUND.replace("chr(10)", "'\\n'"))
    own = table(spark, d, "events").select("event_id", N.findings(text).alias("f"))
    total = F.aggregate("f.conditions", F.lit(0.0), lambda a, x: a + x["score"])
    return own.select("event_id", "f.modality", F.size("f.conditions").alias("n"), F.round(total, 6).alias("total"), N.finding_terms(F.col("f")).alias("terms"))


_NOTE = "CASE WHEN event_id % 9 = 0 THEN 'nothing said' ELSE 'Entity type: ' || upper(event_type) || '. Value: K ' || user_id || ' . Confidence: 0.' || (event_id % 10) || '. Source: Patient.' END"


@query(f"""SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'entity' ELSE event_type END AS entity_type, CASE WHEN event_id % 9 = 0 THEN 'unknown' ELSE 'K ' || user_id END AS value, CASE WHEN event_id % 9 = 0 THEN '' ELSE 'k ' || user_id END AS normalized_value,
CASE WHEN event_id % 9 = 0 THEN 0 ELSE (event_id % 10) / 10 END::DOUBLE AS confidence, CASE WHEN event_id % 9 = 0 THEN '' ELSE 'patient' END AS source FROM events""")
def memory_notes(spark, d):
    own = table(spark, d, "events").select("event_id", F.expr(_NOTE).alias("t"))
    return own.select("event_id", *[c.alias(n) for n, c in N.note(F.col("t")).items()])


_SAID_JSON = """'Sure: [{"text": "' || event_type || '", "entity_type": "Drug", "confidence": 0.' || (event_id % 10) || '}, {"text": "k", "confidence": 0.9, "region": "anterior"}' || CASE WHEN event_id % 11 = 0 THEN ' oops' ELSE '' END || '] as asked.'"""


@query("""SELECT event_id, event_type AS text, 'medication' AS entity_type, (event_id % 10) / 10 AS confidence, 'unspecified' AS region FROM events WHERE event_id % 11 <> 0 AND event_id % 10 >= 5
UNION ALL SELECT event_id, 'k', 'finding', 0.9, 'anterior' FROM events WHERE event_id % 11 <> 0""")
def entity_json(spark, d):
    """Answers of a model, written from events, some of them malformed, read as entities."""
    own = table(spark, d, "events").select("event_id", F.explode(N.entities_said(F.expr(_SAID_JSON))).alias("e"))
    return own.select("event_id", "e.text", "e.entity_type", "e.confidence", "e.region")


_HITS = "SELECT user_id AS subject, ['front', 'back', 'lids'][(event_id % 3 + 1)::INT] AS room, event_type AS type, 'v' || (event_id % 5) AS value, (event_id % 10) / 10 AS confidence, round(value / 200 + event_id % 7, 9) AS distance, event_id % 4 = 0 AS answer, event_id AS ord FROM events"


@query(f"""WITH h AS ({_HITS}), k AS (SELECT *, row_number() OVER (PARTITION BY subject, room, type, value ORDER BY ord) AS n FROM h QUALIFY n = 1), t AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY distance, ord) AS rank FROM k QUALIFY rank <= 6),
f AS (SELECT *, row_number() OVER (PARTITION BY subject, value ORDER BY rank) AS m FROM t QUALIFY m = 1), w AS (SELECT subject, array_to_string(list_slice(list(value ORDER BY answer, rank), 1, 6), ' ') AS terms FROM f GROUP BY subject)
SELECT subject, terms, 'PAST CLINICAL RECORDS:' || chr(10) || string_agg('- ' || type || ': ' || value || ' (' || room || ', conf ' || printf('%.2f', confidence) || ')', chr(10) ORDER BY rank) AS block, count(*)::INT AS loci FROM t JOIN w USING (subject) GROUP BY subject, terms""")
def memory_context(spark, d):
    e = F.col("event_id")
    rooms = F.element_at(F.array(F.lit("front"), F.lit("back"), F.lit("lids")), (e % 3 + 1).cast("int"))
    hits = table(spark, d, "events").select(
        F.col("user_id").alias("subject"), rooms.alias("room"), F.col("event_type").alias("type"), F.concat(F.lit("v"), e % 5).alias("value"),
        (e % 10 / 10).alias("confidence"), F.round(F.col("value") / 200 + e % 7, 9).alias("distance"), (e % 4 == 0).alias("answer"), e.alias("ord"),
    )
    return evidence.memory_context(hits)


# Words that turns are given so that the rules have something to find.
_PLANTED = ("corneal ulcer", "macula", "lid margin", "cataract", "nothing", "retinal detachment", "lens", "drusen")
_PARENTS = [("drusen", "macula of the retina"), ("lid margin", "eyelid")]
_TERM = f"[{', '.join(repr(p) for p in _PLANTED)}][((conv_id + turn) % {len(_PLANTED)} + 1)::INT]"


def _planted():
    return F.element_at(F.array(*[F.lit(p) for p in _PLANTED]), ((F.col("conv_id") + F.col("turn")) % len(_PLANTED) + 1).cast("int"))


def _first(groups, c: str) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'''contains({c}, '{k}')''' for k in words)} THEN '{g}'" for g, words in groups.items()) + " ELSE 'unspecified' END"


@query(f"""WITH t AS (SELECT conv_id, turn, {_TERM} AS t FROM conversations), p AS (SELECT * FROM t LEFT JOIN (VALUES {_VALUES(_PARENTS)}) p(t, anatomy) USING (t))
SELECT conv_id, turn, CASE WHEN {_first(evidence.REGIONS, "t")} <> 'unspecified' THEN {_first(evidence.REGIONS, "t")} ELSE {_first(evidence.REGIONS, "coalesce(anatomy, '')")} END AS region, {_first(evidence.PRIORITIES, "t")} AS priority FROM p""")
def region_priority(spark, d):
    own = table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("key"), _planted().alias("text"))
    return evidence.tagged(own, "key", "text", spark.createDataFrame(_PARENTS, "text string, anatomy string")).select("key.*", "region", "priority")


_TERMS = [("corneal ulcer", "condition", 0.9), ("macula", "anatomy", 0.8), ("lid margin", "anatomy", 0.7), ("cataract", "condition", 0.8), ("retinal detachment", "condition", 0.95), ("lens", "anatomy", 0.6), ("drusen", "finding", 0.7)]


@query(f"""WITH t AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'patient' ELSE 'answer' END AS source, {_TERM} AS t FROM conversations), e AS (SELECT conv_id, turn, source, name, type, round(c * CASE source WHEN 'patient' THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END, 6) AS confidence
FROM t JOIN (VALUES {", ".join(f"('{a}', '{b}', {c}::DOUBLE)" for a, b, c in _TERMS)}) d(name, type, c) ON t = name WHERE source <> 'answer' OR type = 'anatomy')
SELECT conv_id, name, type, source, confidence, turn, count(*) OVER (PARTITION BY conv_id, name, type) AS mentions FROM e QUALIFY row_number() OVER (PARTITION BY conv_id, name, type ORDER BY (source = 'patient')::INT DESC, confidence DESC, turn) = 1""")
def turn_entities(spark, d):
    """Entities of both sides of a conversation; what the person owns is not taken from answers."""
    own = table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("key"), "role", _planted().alias("text"))
    found = dictionary.pattern_hits(own, "key", "text", spark.createDataFrame([(t, k, t, c) for t, k, c in _TERMS], "name string, type string, term string, confidence double"))
    found = found.join(own.select("key", "role"), "key").select("key.conv_id", "key.turn", F.when(F.col("role") == "user", "patient").otherwise("answer").alias("source"), "name", "type", "confidence")
    return evidence.turn_entities(found, ["conv_id"], R.source_weight(R.source_bucket(F.col("source"))))


_NODE_FACTS = [("corneal_ulcer", 0, "An ulcer is an open sore."), ("macula", 0, "The macula is central."), ("macula", 1, "Cones are dense there."), ("lens", 0, "The lens focuses.")]


@query(f"""WITH t AS (SELECT conv_id, min(turn) AS first, {_TERM} AS t FROM conversations GROUP BY conv_id, 3), f AS (SELECT conv_id, fact, min(first * 10 + no) AS pos FROM t JOIN (VALUES {_VALUES(_NODE_FACTS)}) f(node, no, fact) ON replace(t, ' ', '_') = node GROUP BY ALL)
SELECT conv_id, fact, row_number() OVER (PARTITION BY conv_id ORDER BY pos, fact) AS rank FROM f QUALIFY rank <= 2""")
def context_facts(spark, d):
    """Up to two different facts of the nodes that a conversation's terms name, in the order of their first mention."""
    terms = table(spark, d, "conversations").groupBy("conv_id", F.replace(_planted(), F.lit(" "), F.lit("_")).alias("node")).agg(F.min("turn").alias("first"))
    facts = small_side(spark.createDataFrame(_NODE_FACTS, "node string, no int, fact string"))
    own = terms.join(facts, "node").groupBy("conv_id", "fact").agg(F.min(F.col("first") * 10 + F.col("no")).alias("pos"))
    return retrieval.top_k(own, "conv_id", [F.asc("pos"), F.asc("fact")], 2).select("conv_id", "fact", F.col("rank").cast("long").alias("rank"))


_ROOM_OF = "CASE t " + " ".join(f"WHEN '{n}' THEN '{room}'" for room, names in anatomy.ROOMS.items() for n in names) + " END"


@query(f"""WITH r AS (SELECT conv_id, turn, {_ROOM_OF} AS room FROM (SELECT conv_id, turn, {_TERM} AS t FROM conversations)), f AS (SELECT *, last_value(room IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS focus FROM r)
SELECT conv_id, turn, array_to_string(CASE WHEN room = focus THEN [room] ELSE list_filter([room, focus], lambda x: x IS NOT NULL) END, ',') AS rooms FROM f""")
def target_rooms(spark, d):
    """Rooms to look into: that of what is named, then the session's focus (the last room before)."""
    from pyspark.sql import Window

    own = table(spark, d, "conversations").select("conv_id", "turn", anatomy.room_of(_planted()).alias("room"))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("focus", F.last("room", ignorenulls=True).over(w))
    both = anatomy.keep_first_union(F.array_compact(F.array("room")), F.array_compact(F.array("focus")))
    return own.select("conv_id", "turn", F.array_join(both, ",").alias("rooms"))


def _bare(x: str) -> str:
    for p in N.LEAD_INS:
        x = f"(SELECT CASE WHEN starts_with(lower(y), '{p}') THEN {_STRIP.format(f'substr(y, {len(p) + 1})')} ELSE y END FROM (SELECT {x} AS y))"
    return x


@query(f"""WITH l AS (SELECT doc_id, {_STRIP.format("unnest(string_split('According to the texts, ' || text || chr(10) || 'Possible causes:' || chr(10) || 'Please visit the page of ' || source, chr(10)))")} AS x FROM documents)
SELECT doc_id, md5({_bare("x")}) AS hash FROM l WHERE length(x) > 15 AND NOT suffix(x, ':') AND NOT {_any(N.ADVICE, "lower(x)")}""")
def inference_claims(spark, d):
    said = F.concat(F.lit("According to the texts, "), F.col("text"), F.lit("\nPossible causes:\nPlease visit the page of "), F.col("source"))
    return table(spark, d, "documents").select("doc_id", F.explode(N.claim_lines(said)).alias("x")).select("doc_id", F.md5("x").alias("hash"))


@query("""SELECT c_custkey, 'PATIENT PROFILE (use this to personalize your advice):' || chr(10) || '- Full Name: ' || c_name || CASE WHEN c_mktsegment <> 'FURNITURE' THEN chr(10) || '- Market Segment: ' || c_mktsegment ELSE '' END || chr(10) || '- Nation: ' || c_nationkey || chr(10) || chr(10) AS block FROM customer""")
def profile_blocks(spark, d):
    segment = F.when(F.col("c_mktsegment") != "FURNITURE", F.col("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", N.profile_block({"full_name": F.col("c_name"), "market_segment": segment, "nation": F.col("c_nationkey")}).alias("block"))


@query("""WITH q AS (SELECT conv_id, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, coalesce(text, '') DESC) AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role = 'user' QUALIFY r <= 7),
b AS (SELECT conv_id, any_value(n) AS n, coalesce(string_agg('- ' || t, chr(10) ORDER BY r DESC) FILTER (r > 2), '') AS old, string_agg('Patient: ' || t, chr(10) ORDER BY r DESC) FILTER (r <= 2) AS new FROM q GROUP BY conv_id)
SELECT conv_id, CASE WHEN n > 2 THEN old || chr(10) ELSE '' END || new || chr(10) || chr(10) AS block FROM b""")
def history_blocks(spark, d):
    """Only the newest seven questions of a conversation are gathered."""
    own = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("t"))
    newest = retrieval.top_k(own, "conv_id", [F.desc("turn"), F.desc("t")], 7)
    turns = newest.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "t")), asc=False), lambda x: x["t"]).alias("q"))
    return turns.select("conv_id", N.history_block(F.col("q")).alias("block"))


@query("""WITH t AS (SELECT lower(left(text, 30)) AS title, doc_id, lang FROM documents), c AS (SELECT title, min(doc_id) AS doc_id FROM t WHERE lang = 'en' GROUP BY 1), o AS (SELECT title, min(doc_id) AS doc_id FROM t WHERE lang <> 'en' AND NOT contains(title, ':') GROUP BY 1)
SELECT 'curated' AS kind, title, doc_id FROM c UNION ALL SELECT 'found', title, doc_id FROM o ANTI JOIN c USING (title)""")
def curated_and_found(spark, d):
    """Titles of a curated list, then those found beside it, without namespaces."""
    own = table(spark, d, "documents").select(F.lower(F.left("text", F.lit(30))).alias("title"), "doc_id", "lang")
    first = lambda df, kind: df.groupBy("title").agg(F.min("doc_id").alias("doc_id")).select(F.lit(kind).alias("kind"), "title", "doc_id")
    curated = first(own.where("lang = 'en'"), "curated")
    found = first(own.where((F.col("lang") != "en") & ~F.contains("title", F.lit(":"))), "found")
    return curated.unionByName(found.join(curated.select("title"), "title", "left_anti"))


@query(f"""SELECT page_id, CASE WHEN d.text IS NOT NULL THEN 'asset' ELSE 'page' END AS kind, CASE WHEN d.text IS NOT NULL THEN length(d.text) ELSE length(html) END AS chars
FROM pages LEFT JOIN (SELECT doc_id, text FROM documents WHERE length(text) >= 700) d ON doc_id = page_id WHERE d.text IS NOT NULL OR length(html) >= 1200""")
def page_or_asset(spark, d):
    """The document of a landing page where it is long enough, else the page itself where that is."""
    assets = table(spark, d, "documents").where(F.length("text") >= 700).select(F.col("doc_id").alias("page_id"), F.length("text").alias("own"))
    both = table(spark, d, "pages").select("page_id", F.length("html").alias("chars")).join(assets, "page_id", "left").where("own is not null or chars >= 1200")
    return both.select("page_id", F.when(F.col("own").isNotNull(), "asset").otherwise("page").alias("kind"), F.coalesce("own", "chars").cast("long").alias("chars"))


@query("""SELECT 'MCQ_' || p_partkey AS id, p_name AS question, ['A. ' || p_brand, 'B. ' || p_type, 'C. ' || p_size, 'D. ' || p_name] AS o, p_size % 4 AS correct_option_idx FROM part WHERE contains(lower(p_type || ' ' || p_name), 'widget') OR contains(lower(p_type || ' ' || p_name), 'promo')""".replace(
    "AS o,", "AS o_,").replace("SELECT 'MCQ_'", "SELECT id, question, array_to_string(o_, ' | ') AS options, substr(o_[correct_option_idx + 1], 4) AS correct_answer, correct_option_idx FROM (SELECT 'MCQ_'") + ")")
def mcq_items(spark, d):
    """Questions of the wanted subjects with labelled options and the right one."""
    topic = F.lower(F.concat_ws(" ", "p_type", "p_name"))
    options = F.array("p_brand", "p_type", F.col("p_size").cast("string"), "p_name")
    labelled = F.zip_with(F.array(*[F.lit(x) for x in "ABCD"]), options, lambda a, b: F.concat(a, F.lit(". "), b))
    right = F.col("p_size") % 4
    return table(spark, d, "part").where(F.contains(topic, F.lit("widget")) | F.contains(topic, F.lit("promo"))).select(
        F.concat(F.lit("MCQ_"), F.col("p_partkey")).alias("id"), F.col("p_name").alias("question"), F.array_join(labelled, " | ").alias("options"),
        F.get(options, right).alias("correct_answer"), right.alias("correct_option_idx"),
    )


@query("""WITH e AS (SELECT user_id, event_type, avg(round(value)) AS c, count(*) AS hits, max(event_id) AS last FROM events GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, hits DESC, last DESC) AS place FROM e QUALIFY place <= 3)
SELECT user_id, event_type, round(c, 6) AS c, hits, place FROM t WHERE c >= 52 AND hits >= 2""")
def provisional_top(spark, d):
    """The first three pending sightings of each subject; thresholds come after the cut."""
    own = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.avg(F.round("value")).alias("c"), F.count(F.lit(1)).alias("hits"), F.max("event_id").alias("last"))
    top = retrieval.top_k(own, "user_id", [F.desc("c"), F.desc("hits"), F.desc("last")], 3, "place").where("c >= 52 and hits >= 2")
    return top.select("user_id", "event_type", F.round("c", 6).alias("c"), "hits", F.col("place").cast("long").alias("place"))


_CAPS = {"click": 3, "view": 4, "purchase": 4, "error": 3, "signup": 3}


@query(f"""WITH i AS (SELECT user_id % 50 AS subject, event_type AS kind, 'i' || user_id AS value, round(max(value) / 200, 9) AS confidence, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT * FROM i WHERE confidence >= 0.65 OR (confidence >= 0.35 AND n >= 2))
SELECT subject, kind, value, row_number() OVER (PARTITION BY subject, kind ORDER BY confidence DESC, value) AS place FROM s QUALIFY place <= CASE kind {" ".join(f"WHEN '{k}' THEN {n}" for k, n in _CAPS.items())} END""")
def context_buckets(spark, d):
    own = table(spark, d, "events").groupBy((F.col("user_id") % 50).alias("subject"), F.col("event_type").alias("kind"), F.concat(F.lit("i"), "user_id").alias("value"))
    own = own.agg(F.round(F.max("value") / 200, 9).alias("confidence"), F.count(F.lit(1)).alias("n"))
    out = evidence.capped(own, "subject", "kind", _CAPS, R.is_stable(F.col("confidence"), F.col("n"), 0.35))
    return out.select("subject", "kind", "value", F.col("place").cast("long").alias("place"))


@query("""SELECT DISTINCT m AS modality, label FROM embeddings, (VALUES ('a', [0, 1], 0), ('b', [2], 3), ('c', [], 5)) v(m, allowed, prefix) WHERE list_contains(allowed, label % 5) OR label % 7 = prefix""")
def modality_labels(spark, d):
    """Labels that a modality allows by their group or their own name."""
    rows = spark.createDataFrame([("a", [0, 1], 0), ("b", [2], 3), ("c", [], 5)], "modality string, allowed array<int>, prefix int")
    own = table(spark, d, "embeddings").select("label").distinct()
    return own.join(small_side(rows), F.array_contains("allowed", F.col("label") % 5) | (F.col("label") % 7 == F.col("prefix"))).select("modality", "label")


@query(f"""{_NLI}, r AS (SELECT user_id, verdict, CASE WHEN verdict = 'FAIL' AND c = 0 THEN 'PARTIAL' ELSE verdict END AS final FROM v) SELECT user_id, verdict, final, verdict = 'FAIL' AS retried, final IN ('PASS', 'PARTIAL') AND user_id <> 0 AS writes FROM r""")
def memory_write_gate(spark, d):
    """A failed answer is tried once more (here without its contradictions); only grounded turns of a known subject are kept."""
    own = verdicts_of(spark, d).withColumn("final", F.when((F.col("verdict") == "FAIL") & (F.col("c") == 0), "PARTIAL").otherwise(F.col("verdict")))
    return own.select("user_id", "verdict", "final", (F.col("verdict") == "FAIL").alias("retried"), (F.col("final").isin("PASS", "PARTIAL") & (F.col("user_id") != 0)).alias("writes"))


_REASON = "CASE WHEN recall = 0 THEN 'missed' WHEN precision < 0.5 THEN 'diluted' ELSE 'fine' END"


@query(f"""WITH {METRICS} SELECT {_REASON} AS section, row_number() OVER (PARTITION BY {_REASON} ORDER BY recall, item_id) AS place, '- item ' || item_id || ': returned ' || returned AS line FROM m QUALIFY place <= 5""")
def failure_report(spark, d):
    """Up to five cases of each section, as lines of a report."""
    section = F.when(F.col("recall") == 0, "missed").when(F.col("precision") < 0.5, "diluted").otherwise("fine")
    line = F.concat(F.lit("- item "), F.col("item_id"), F.lit(": returned "), F.col("returned"))
    return evidence.case_report(metrics_of(spark, d).withColumn("section", section), "section", [F.asc("recall"), F.asc("item_id")], line)


@query(f"""WITH {BM25}, h AS (SELECT top.*, source = 'src7' AND (contains(lower(lang), 'en') OR contains(lower(text), 'license')) AS noisy FROM top JOIN documents USING (doc_id)),
g AS (SELECT *, count(*) FILTER (NOT noisy) OVER (PARTITION BY item_id) AS clean FROM h) SELECT item_id, doc_id, rank FROM g WHERE NOT noisy OR clean = 0""")
def boilerplate_hits(spark, d):
    docs = table(spark, d, "documents")
    top = retrieval.bm25_top_k(docs, table(spark, d, "benchmark"))
    noisy = N.is_boilerplate(F.col("source"), F.col("lang"), F.col("text"), "src7", ("en",), ("license",))
    hits = top.join(docs.select("doc_id", noisy.alias("is_noisy")), "doc_id")
    return evidence.surviving(hits, F.coalesce("is_noisy", F.lit(False))).select("item_id", "doc_id", "rank")


_REFINED = f"(SELECT item_id, array_to_string(list_slice(t, 1, 12), ' ') AS text FROM (SELECT item_id, {_QT.format('text')} AS t FROM benchmark))"


@query(f"""WITH a AS (WITH {BM25.replace("FROM benchmark", f"FROM {_REFINED}")} SELECT item_id, doc_id, 0 AS list_no, rank FROM top), b AS (WITH {BM25} SELECT item_id, doc_id, 1 AS list_no, rank FROM top),
m AS (SELECT item_id, doc_id, list_no, rank, doc_id // 10 AS parent FROM (FROM a UNION ALL FROM b) JOIN documents USING (doc_id) QUALIFY row_number() OVER (PARTITION BY item_id, doc_id // 10, left(text, 120) ORDER BY list_no, rank) = 1)
SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY list_no, rank) AS rank FROM m""")
def two_anchor_hits(spark, d):
    """Hits of the refined question (its first twelve tokens), then those of the raw one."""
    docs, raw = table(spark, d, "documents"), table(spark, d, "benchmark")
    refined = raw.select("item_id", F.array_join(F.slice(R.query_tokens(F.col("text")), 1, 12), " ").alias("text"))
    # both wordings are looked up at once
    both = refined.select((F.col("item_id") * 2).alias("item_id"), "text").unionByName(raw.select((F.col("item_id") * 2 + 1).alias("item_id"), "text"))
    top = retrieval.bm25_top_k(docs, both)
    lists = top.select(F.floor(F.col("item_id") / 2).alias("item_id"), "doc_id", F.pmod("item_id", F.lit(2)).cast("int").alias("list_no"), "rank")
    return evidence.merge_hits(lists, docs, F.floor(F.col("doc_id") / 10))


@query(f"""SELECT doc_id, source AS category, '## ' || left(text, 20) || ' (PMID: ' || doc_id || ')' || chr(10) || '*' || lang || '*' || chr(10) || 'Keywords: ' || array_to_string(list_slice(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> ''), 1, 8), ', ') AS entry FROM documents WHERE text IS NOT NULL""".replace("\\\\", "\\"))
def category_entries(spark, d):
    """Entries of articles with at most eight keywords, for writing by category."""
    from ..sources.sinks import article_entry

    own = table(spark, d, "documents").where("text is not null").select("doc_id", F.col("source").alias("category"), F.left("text", F.lit(20)).alias("title"), F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("citation"), X.words(F.col("text")).alias("keywords"))
    return own.select("doc_id", "category", article_entry().alias("entry"))


@query(r"""WITH w AS (SELECT DISTINCT trim(regexp_replace(lower(l), '\s+', ' ', 'g')) AS t FROM (SELECT unnest(string_split(text, '.')) AS l FROM benchmark)), c AS (SELECT DISTINCT regexp_replace(regexp_replace(t, '^[\-*•\d.)\s]+', ''), '^[ ,;:]+|[ ,;:]+$', '', 'g') AS term FROM w)
SELECT term FROM c WHERE length(term) BETWEEN 3 AND 80 ORDER BY len(string_split(term, ' ')) > 8, length(term), term LIMIT 5000""")
def lexicon_limit(spark, d):
    """The first 5,000 terms of a lexicon: short ones before those of more than eight words."""
    from ..functions.safety import lexicon_term

    own = table(spark, d, "benchmark").select(F.explode(F.split("text", r"\.")).alias("line")).select(lexicon_term(F.col("line")).alias("term")).where("term is not null").distinct()
    return own.orderBy(F.size(F.split("term", " ")) > 8, F.length("term"), "term").limit(5000)
