"""Registered queries of safety rules, the graph of structures, pages and evaluation, and DuckDB SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import safety as S
from ..operators import anatomy as A
from ..session import table
from .registry import _QT, _stable_distinct, query


def _q(p: str) -> str:
    return p.replace("'", "''")


def _any(patterns, c="q") -> str:
    return f"regexp_matches({c}, '{_q('|'.join(f'(?:{p})' for p in patterns))}')"


_TURNS = "(SELECT conv_id, turn, role, lower(coalesce(text, '')) AS q, text FROM conversations)"
_NEGATED = rf"({_any([S.NEGATED_BOTH])} OR ({_any([r'\b(no|without)\s+red\w*\b'])} AND {_any([r'\b(no|without)\s+pain\w*\b'])}))"


def turns_of(spark, d):
    return table(spark, d, "conversations")


@query(f"""SELECT conv_id, turn, CASE WHEN {_any(S.EMERGENCY)} THEN 'emergency'
WHEN ({_any([S.TRIAGE_SPOT])} AND {_any(S.TRIAGE_INFLAMED)} AND ({_any(S.TRIAGE_PLACE)} OR {_any(S.SURFACE)})) OR ({_any([S.LENS])} AND {_any([S.LENS_SIGNS])} AND NOT {_NEGATED}) THEN 'urgent'
WHEN {_any([S.TRIAGE_SPOT])} AND ({_any(S.PUPIL)} OR {_any(S.SURFACE)}) AND NOT {_any(S.TRIAGE_INFLAMED)} THEN 'leukocoria' ELSE 'none' END AS level FROM {_TURNS}""")
def triage_levels(spark, d):
    return turns_of(spark, d).select("conv_id", "turn", S.triage_level(F.col("text")).alias("level"))


_PROFILE = f"""SELECT *, ((spot AND inflammation AND (surface_location OR eye_reference)) OR (lens AND inflammation AND spot)) AND NOT fundus_context AS high_risk, spot AND (surface_location OR eye_reference) AND NOT fundus_context AS surface_spot
FROM (SELECT *, {_any(S.SPOT)} AS spot, {_any((*S.PLACE, *S.SURFACE))} AS surface_location, {_any(S.INFLAMED)} AS inflammation, {_any(S.FUNDUS)} AS fundus_context, {_any([S.EYE])} AS eye_reference, {_any([S.LENS])} AS lens FROM {_TURNS})"""


@query(f"SELECT conv_id, turn, spot, surface_location, inflammation, fundus_context, eye_reference, high_risk, surface_spot FROM ({_PROFILE})")
def surface_sign_profile(spark, d):
    return turns_of(spark, d).select("conv_id", "turn", *[c.alias(n) for n, c in S.surface_profile(F.col("text")).items()])


def _mapped(text: str, banned=()) -> str:
    names = lambda xs: ", ".join(f"'{x}'" for x in xs)
    case = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in S.CANONICAL.items())
    t = f"list_filter(list_transform({_QT.format(text)}, lambda x: CASE x {case} ELSE x END), lambda x: x IN ({names(S.ACRONYMS)}) OR (length(x) > 2 AND x NOT IN ({names([*S.NOISE, *banned])})))"
    return f"array_to_string(list_slice({_stable_distinct(t)}, 1, 18), ' ')"


@query(f"""WITH p AS ({_PROFILE}), m AS (SELECT conv_id, turn, CASE WHEN high_risk THEN {_mapped(f"('{S.SEED_RISK} ' || t || ' ' || t)", S.POSTERIOR)}
WHEN surface_spot THEN {_mapped(f"('{S.SEED_SPOT} ' || t || ' ' || t)", S.POSTERIOR)} ELSE {_mapped("(t || ' ' || t)")} END AS query FROM (SELECT *, coalesce(text, '') AS t FROM p) WHERE role = 'user')
SELECT conv_id, turn, query FROM m""")
def symptom_queries(spark, d):
    t = F.coalesce(F.col("text"), F.lit(""))
    return turns_of(spark, d).where("role = 'user'").select("conv_id", "turn", S.mapped_query(t, t).alias("query"))


# A small graph: what it holds is a parameter of the operators.
_ALIASES = [("cornea", "cornea"), ("clear front", "cornea"), ("iris", "iris"), ("coloured part", "iris"), ("pupil", "pupil"), ("black part", "pupil"), ("black part", "cornea"), ("retina", "retina"), ("macula", "macula"), ("sclera", "sclera"), ("white part", "sclera"), ("eyelid", "eyelids"), ("sight", "retina"), ("light", "retina"), ("hand", "adnexa"), ("face", "adnexa"), ("head", "cornea")]
_FACTS = [("cornea", 0, "The cornea is clear."), ("pupil", 0, "The pupil is an opening."), ("retina", 0, "The retina lines the back."), ("retina", 1, "The macula is its centre."), ("adnexa", 0, "Lids protect.")]
_CONTRA = [("sclera_black", r"sclera\s+is\s+(the\s+)?(black|colou?red)", r"\b(?:black|dark|brown|pigmented)\b[^.]{0,40}\b(?:spot|dot|nevus)\b[^.]{0,40}\bsclera\b", "The sclera is white."), ("that_is", r"\bthat\s+is\s+the\b", None, "A claim of identity.")]
_DIFFERENT = [("cornea", "retina"), ("iris", "pupil"), ("the", "that")]
_VALUES = lambda rows: ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else f"'{_q(v)}'" for v in r) + ")" for r in rows)
_FOUND = rf"SELECT DISTINCT conv_id, turn, structure FROM {_TURNS}, (VALUES {_VALUES(_ALIASES)}) a(phrase, structure) WHERE regexp_matches(q, '\b' || regexp_replace(phrase, '\s+', '\\s+', 'g') || '\b')"


def found_in(spark, d):
    own = turns_of(spark, d).withColumn("key", F.struct("conv_id", "turn"))
    return A.structures(own, "key", "text", spark.createDataFrame(_ALIASES, "phrase string, structure string"))


@query(_FOUND)
def anatomy_structures(spark, d):
    return found_in(spark, d).select("key.*", "structure")


@query(f"""WITH f AS ({_FOUND}), b AS (SELECT conv_id, turn, fact, min(structure || fact_no) AS pos FROM f JOIN (VALUES {_VALUES(_FACTS)}) x(structure, fact_no, fact) USING (structure) GROUP BY ALL)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos, fact) AS rank, fact FROM b QUALIFY rank <= 3""")
def anatomy_facts(spark, d):
    return A.facts(found_in(spark, d), "key", spark.createDataFrame(_FACTS, "structure string, fact_no int, fact string"), 3).select("key.*", F.col("rank").cast("long").alias("rank"), "fact")


@query(rf"""SELECT DISTINCT conv_id, turn, message FROM {_TURNS}, (VALUES {_VALUES(_CONTRA)}) r(id, pattern, exempt, message) WHERE regexp_matches(q, pattern) AND (exempt IS NULL OR NOT regexp_matches(q, exempt))
UNION SELECT conv_id, turn, upper(a[1]) || a[2:] || ' is anatomically different from ' || upper(b[1]) || b[2:] || '.' FROM {_TURNS}, (VALUES {_VALUES(_DIFFERENT)}) p(a, b)
WHERE regexp_matches(q, '\b' || a || '\b[^.]{{0,40}}{A.IDENTITY}[^.]{{0,40}}\b' || b || '\b') OR regexp_matches(q, '\b' || b || '\b[^.]{{0,40}}{A.IDENTITY}[^.]{{0,40}}\b' || a || '\b')""")
def anatomy_contradictions(spark, d):
    own = turns_of(spark, d).withColumn("key", F.struct("conv_id", "turn"))
    rules = spark.createDataFrame(_CONTRA, "id string, pattern string, exempt string, message string")
    return A.contradictions(own, "key", "text", rules, spark.createDataFrame(_DIFFERENT, "a string, b string")).select("key.*", "message")


_ROOM = "CASE " + " ".join(f"WHEN {{0}} IN ({', '.join(repr(n) for n in names)}) THEN '{room}'" for room, names in A.ROOMS.items()) + " END"


@query(f"SELECT conv_id, turn, structure, {_ROOM.format('structure')} AS room FROM ({_FOUND})")
def memory_rooms(spark, d):
    return found_in(spark, d).select("key.*", "structure", A.resolved_room(F.col("structure"), F.lit("unknown place")).alias("room"))


@query(f"""WITH h AS (SELECT conv_id, {_ROOM.format('structure')} AS region, 0.3::DOUBLE AS confidence FROM ({_FOUND})), t AS (SELECT conv_id, region, round(sum(confidence), 9) AS votes FROM h WHERE region IS NOT NULL GROUP BY ALL)
SELECT conv_id, CASE WHEN votes > 0.5 THEN region END AS region, votes FROM t QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY votes DESC, region) = 1""")
def region_vote(spark, d):
    hits = found_in(spark, d).select("key.conv_id", A.room_of(F.col("structure")).alias("region"), F.lit(0.3).alias("confidence")).where("region is not null")
    return A.region_votes(hits, "conv_id")


@query(f"""WITH s AS (SELECT conv_id, role, list(DISTINCT structure) AS s FROM ({_FOUND}) JOIN conversations USING (conv_id, turn) GROUP BY ALL)
SELECT conv_id, len(u) > 0 AND len(a) > 0 AND NOT list_has_any(u, a) AS mismatch, len(list_distinct(u || a))::INT AS together
FROM (SELECT conv_id, coalesce(u.s, []) AS u, coalesce(a.s, []) AS a FROM (SELECT * FROM s WHERE role = 'user') u FULL JOIN (SELECT * FROM s WHERE role = 'assistant') a USING (conv_id))""")
def anatomy_mismatch(spark, d):
    roles = turns_of(spark, d).select(F.struct("conv_id", "turn").alias("key"), "role")
    sets = found_in(spark, d).join(roles, "key").groupBy("key.conv_id", "role").agg(F.collect_set("structure").alias("s"))
    side = lambda role, name: sets.where(F.col("role") == role).select("conv_id", F.col("s").alias(name))
    both = side("user", "asked").join(side("assistant", "answered"), "conv_id", "full")
    both = both.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("asked", "answered")})
    return both.select("conv_id", A.mismatch(F.col("asked"), F.col("answered")).alias("mismatch"), F.size(A.keep_first_union(F.col("asked"), F.col("answered"))).alias("together"))


@query("""WITH p AS (SELECT conv_id, turn, CASE WHEN length(q) > 400 THEN 'urgent' WHEN length(q) > 200 THEN 'soon' ELSE 'routine' END AS priority FROM (SELECT conv_id, turn, coalesce(text, '') AS q FROM conversations)),
r AS (SELECT *, max(CASE priority WHEN 'routine' THEN 1 WHEN 'soon' THEN 2 ELSE 3 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS n FROM p)
SELECT conv_id, turn, priority, ['routine', 'soon', 'urgent', 'emergency'][n] AS so_far FROM r""")
def priority_escalation(spark, d):
    n = F.length(F.coalesce("text", F.lit("")))
    own = turns_of(spark, d).select("conv_id", "turn", F.when(n > 400, "urgent").when(n > 200, "soon").otherwise("routine").alias("priority"))
    return A.escalated(own, "conv_id", "turn", "priority")


@query("""SELECT conv_id, string_agg('[Source ' || (turn + 1) || ': ' || coalesce(role, '') || ']' || chr(10) || left(coalesce(text, ''), 2000), chr(10) || '---' || chr(10) ORDER BY turn) AS context FROM conversations GROUP BY conv_id""")
def context_blocks(spark, d):
    block = F.concat(F.lit("[Source "), F.col("turn") + 1, F.lit(": "), F.coalesce("role", F.lit("")), F.lit("]\n"), F.substring(F.coalesce("text", F.lit("")), 1, 2000))
    own = turns_of(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", block.alias("block")))).alias("b"))
    return own.select("conv_id", F.array_join(F.transform("b", lambda x: x["block"]), "\n---\n").alias("context"))


_TOKENS = "list_distinct(regexp_extract_all(lower({}), '([a-z0-9]+)'))"


@query(f"SELECT item_id, len({_TOKENS.format('text')})::INT AS tokens, list_has_all({_TOKENS.format('text')}, ['the', 'and']) AND NOT list_has_any({_TOKENS.format('text')}, ['idiot', 'moron']) AS fits FROM benchmark")
def token_checks(spark, d):
    t = F.col("text")
    return table(spark, d, "benchmark").select("item_id", F.size(S.token_set(t)).alias("tokens"), S.tokens_fit(t, ["the", "and"], ["idiot", "moron"]).alias("fits"))


_SCORE = "TRY_CAST(regexp_extract(j, '(?i){}:\\s*([1-5])', 1) AS INT)"


@query(f"""WITH j AS (SELECT doc_id, 'Accuracy: ' || (quality + 3) || CASE WHEN toxic = 1 THEN ' Safety: 1' ELSE ' SAFETY: 5' END || ' clarity: 9' AS j FROM labels), s AS (SELECT doc_id, {", ".join(f"{_SCORE.format(x)} AS {x}" for x in S.JUDGED)} FROM j)
SELECT doc_id, {", ".join(f"coalesce({x}, 0) AS {x}" for x in S.JUDGED)}, round(list_avg(list_filter([{", ".join(S.JUDGED)}], lambda x: x IS NOT NULL)), 2) AS overall FROM s""")
def judge_scores(spark, d):
    said = F.concat(F.lit("Accuracy: "), F.col("quality") + 3, F.when(F.col("toxic") == 1, " Safety: 1").otherwise(" SAFETY: 5"), F.lit(" clarity: 9"))
    own = table(spark, d, "labels").select("doc_id", said.alias("j"))
    return own.select("doc_id", *[F.coalesce(c, F.lit(0)).alias(n) for n, c in S.judge_scores(F.col("j")).items()])


_NLI = """WITH c AS (SELECT user_id, CASE WHEN event_type = 'error' AND value > 150 THEN 'contradicted' WHEN value >= 20 THEN 'entailed' ELSE 'unverified' END AS label FROM events),
n AS (SELECT user_id, count(*) FILTER (label = 'entailed') AS e, count(*) FILTER (label = 'contradicted') AS c, count(*) FILTER (label = 'unverified') AS u FROM c GROUP BY user_id),
v AS (SELECT *, CASE WHEN c > 0 OR u / greatest(e + c + u, 1) > 0.66 THEN 'FAIL' WHEN u > 0 THEN 'PARTIAL' ELSE 'PASS' END AS verdict FROM n)"""


def verdicts_of(spark, d):
    """Events stand for claims: their value gives how far they are entailed, large errors contradict."""
    entail = F.when(F.col("value") >= 20, 0.9).otherwise(0.1)
    contra = F.when((F.col("event_type") == "error") & (F.col("value") > 150), 0.95).otherwise(0.05)
    own = table(spark, d, "events").select("user_id", S.nli_label(entail, contra).alias("label"))
    counts = own.groupBy("user_id").agg(*[F.count_if(F.col("label") == x).alias(x[0]) for x in ("entailed", "contradicted", "unverified")])
    return counts.withColumn("verdict", S.nli_verdict(F.col("e"), F.col("c"), F.col("u")))


@query(f"{_NLI} SELECT user_id, e, c, u, verdict FROM v")
def nli_verdicts(spark, d):
    return verdicts_of(spark, d)


@query(f"{_NLI} SELECT count(*) AS graded, count(*) FILTER (verdict = 'FAIL') AS failed, round(count(*) FILTER (verdict = 'FAIL') / count(*), 6) AS rate FROM v")
def hallucination_rate(spark, d):
    failed = F.count_if(F.col("verdict") == "FAIL")
    return verdicts_of(spark, d).agg(F.count(F.lit(1)).alias("graded"), failed.alias("failed"), F.round(failed / F.count(F.lit(1)), 6).alias("rate"))


_NOTICES = {"conflict": "Parts may conflict with the sources. ", "unverified": "This could not be verified. ", "partial": "Parts could not be verified. "}


@query(f"""{_NLI} SELECT user_id, CASE WHEN verdict = 'PASS' THEN '' WHEN verdict = 'FAIL' AND c > 0 THEN '{_NOTICES["conflict"]}' WHEN verdict = 'FAIL' THEN '{_NOTICES["unverified"]}' ELSE '{_NOTICES["partial"]}' END || 'user ' || user_id AS answer FROM v""")
def abstention_notices(spark, d):
    answer = F.concat(F.lit("user "), F.col("user_id"))
    return verdicts_of(spark, d).select("user_id", S.with_disclaimer(answer, F.col("verdict"), F.col("c"), _NOTICES).alias("answer"))


@query("""WITH m AS (SELECT coalesce(lang, '') AS lang, round(avg(length(text)), 6) AS chars, round(avg(len(string_split(text, ' '))), 6) AS words FROM documents GROUP BY 1),
p AS (SELECT (SELECT chars FROM m WHERE lang = 'en') AS a_chars, (SELECT chars FROM m WHERE lang = 'de') AS b_chars, (SELECT words FROM m WHERE lang = 'en') AS a_words, (SELECT words FROM m WHERE lang = 'de') AS b_words)
SELECT 'chars' AS measure, a_chars AS a, b_chars AS b, round(b_chars - a_chars, 6) AS delta FROM p UNION ALL SELECT 'words', a_words, b_words, round(b_words - a_words, 6) FROM p""")
def backend_delta(spark, d):
    """Means of measures per backend (here languages), side by side, and their difference."""
    means = table(spark, d, "documents").where("lang in ('en', 'de')").agg(
        *[F.round(F.avg(F.when(F.col("lang") == x, v)), 6).alias(f"{m}_{x}") for m, v in (("chars", F.length("text")), ("words", F.size(F.split("text", " ")))) for x in ("en", "de")]
    )
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"{m}_en").alias("a"), F.col(f"{m}_de").alias("b")) for m in ("chars", "words")]))
    return means.select(rows.alias("r")).select("r.*", F.round(F.col("r.b") - F.col("r.a"), 6).alias("delta"))


_NAV, _TOPIC, _REJECT = ("cookie", "sign in", "menu"), ("the", "and", "of", "that"), ("logo", "icon", "banner")


@query("SELECT page_id, length(html) >= 1200 AND (" + " + ".join(f"contains(lower(html), '{w}')::INT" for w in _NAV) + ") < 2 AND (" + " + ".join(f"contains(lower(html), '{w}')::INT" for w in _TOPIC) + ") >= 4 AS plausible FROM pages")
def html_plausible(spark, d):
    return table(spark, d, "pages").select("page_id", S.plausible_page(F.col("html"), _NAV, _TOPIC).alias("plausible"))


_HREF = r'href="([^"]+)"'


@query(rf"""WITH l AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '{_HREF}', 1))) AS link FROM pages), k AS (SELECT * FROM l WHERE NOT regexp_matches(lower(link), '{"|".join(_REJECT)}'))
SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY (NOT contains(lower(link), '.pdf'))::INT, length(link), link) AS rank FROM k""")
def asset_links(spark, d):
    """Distinct links of a page without those of rejected kinds; documents first, then short ones."""
    from pyspark.sql import Window

    own = table(spark, d, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(_HREF)))).alias("link")).where(~F.lower("link").rlike("|".join(_REJECT)))
    w = Window.partitionBy("page_id").orderBy((~F.contains(F.lower("link"), F.lit(".pdf"))).cast("int"), F.length("link"), "link")
    return own.withColumn("rank", F.row_number().over(w).cast("long"))


@query(r"""WITH u AS (SELECT regexp_replace(url, '[?#].*$', '') AS u FROM pages WHERE url IS NOT NULL), p AS (SELECT u, list_filter(string_split(regexp_replace(u, '^[^:]+://[^/]*', ''), '/'), lambda x: x <> '') AS p FROM u) SELECT DISTINCT u AS link, len(p)::INT AS parts FROM p WHERE len(p) >= 2""")
def article_links(spark, d):
    """Distinct addresses without query and fragment whose path has two parts or more."""
    own = table(spark, d, "pages").where("url is not null").select(F.regexp_replace("url", r"[?#].*$", "").alias("link"))
    parts = F.filter(F.split(F.regexp_replace("link", r"^[^:]+://[^/]*", ""), "/"), lambda x: x != "")
    return own.distinct().select("link", F.size(parts).alias("parts")).where("parts >= 2")


_KEYS = ("idiot", "license", "copyright", "password")


@query(f"SELECT doc_id, {' OR '.join(f'''contains(lower(coalesce(source, '') || ' ' || left(coalesce(text, ''), 2500)), '{k}')''' for k in _KEYS)} AS relevant FROM documents")
def topical_relevance(spark, d):
    return table(spark, d, "documents").select("doc_id", S.relevant(F.coalesce("source", F.lit("")), F.coalesce("text", F.lit("")), _KEYS).alias("relevant"))


_ANCHORS = ("License", "the ", "and ")


@query(f"""WITH a AS (SELECT doc_id, text, least({", ".join(f"nullif(strpos(left(text, 3000), '{a}'), 0)" for a in _ANCHORS)}) AS pos FROM documents)
SELECT doc_id, md5(CASE WHEN pos IS NOT NULL THEN substr(text, pos) ELSE text END) AS hash FROM a""")
def chapter_trim(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(S.trimmed_chapter(F.col("text"), _ANCHORS)).alias("hash"))


@query(f"""WITH t AS (SELECT source, k AS term FROM documents, (VALUES {", ".join(f"('{k}')" for k in _KEYS)}) v(k) WHERE contains(lower(text), k)), s AS (SELECT source, list_sort(list(DISTINCT term)) AS terms FROM t GROUP BY source)
SELECT source, array_to_string(terms, ',') AS terms, row_number() OVER (ORDER BY len(terms) DESC, source) AS rank FROM s""")
def source_ranking(spark, d):
    """Sources by the number of different terms that their documents hold."""
    from pyspark.sql import Window

    held = F.filter(F.array(*[F.lit(k) for k in _KEYS]), lambda k: F.contains(F.lower("text"), k))
    own = table(spark, d, "documents").select("source", F.explode(held).alias("term")).groupBy("source").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    return own.select("source", F.array_join("terms", ",").alias("terms"), F.row_number().over(Window.orderBy(F.desc(F.size("terms")), "source")).cast("long").alias("rank"))


@query("""WITH n AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i, sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v))) AS l FROM embeddings), m AS (SELECT label, i, avg(x / l) AS x FROM n GROUP BY ALL),
k AS (SELECT label, sqrt(sum(x * x)) AS l FROM m GROUP BY label) SELECT label, i::INT AS i, round(x / k.l, 6) AS x FROM m JOIN k USING (label)""")
def label_ensembles(spark, d):
    """The mean of a label's unit vectors, scaled to length 1."""
    v = F.col("embedding").cast("array<double>")
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    own = table(spark, d, "embeddings").select("label", F.posexplode(F.transform(v, lambda x: x / length)).alias("p", "x")).groupBy("label", "p").agg(F.avg("x").alias("x"))
    norm = own.groupBy("label").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("l"))
    return own.join(norm, "label").select("label", (F.col("p") + 1).alias("i"), F.round(F.col("x") / F.col("l"), 6).alias("x"))


@query("SELECT label % 5 AS grp, list_sort(list(DISTINCT label))::VARCHAR AS members FROM embeddings GROUP BY 1")
def label_taxonomy(spark, d):
    """Groups with the sorted list of their labels."""
    own = table(spark, d, "embeddings").groupBy((F.col("label") % 5).alias("grp")).agg(F.array_sort(F.collect_set("label")).alias("m"))
    return own.select("grp", F.concat(F.lit("["), F.array_join("m", ", "), F.lit("]")).alias("members"))


@query("""SELECT a.vec_id, round(greatest(0, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]))), 4) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def semantic_similarity(spark, d):
    own = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    both = own.join(own.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id")
    dot = F.aggregate(F.zip_with("v", "w", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return both.select("vec_id", F.round(F.greatest(dot, F.lit(0.0)), 4).alias("similarity"))


@query("""SELECT event_id, coalesce(CASE WHEN value <> 0 THEN user_id / value END, 0) AS factor FROM events""")
def real_time_factors(spark, d):
    return table(spark, d, "events").select("event_id", S.real_time_factor(F.col("user_id").cast("double"), F.col("value")).alias("factor"))


@query(r"""WITH w AS (SELECT DISTINCT trim(regexp_replace(lower(l), '\s+', ' ', 'g')) AS t FROM (SELECT unnest(string_split(text, '.')) AS l FROM benchmark)), c AS (SELECT DISTINCT regexp_replace(regexp_replace(t, '^[\-*•\d.)\s]+', ''), '^[ ,;:]+|[ ,;:]+$', '', 'g') AS term FROM w)
SELECT term FROM c WHERE length(term) BETWEEN 3 AND 80""")
def lexicon_terms(spark, d):
    own = table(spark, d, "benchmark").select(F.explode(F.split("text", r"\.")).alias("line"))
    return own.select(S.lexicon_term(F.col("line")).alias("term")).where("term is not null").distinct()


@query("""SELECT 'item_' || lpad(item_id::VARCHAR, greatest(length(item_id::VARCHAR), 4)::INTEGER, '0') AS id, text AS question, '' AS answer, length(text) > 60 AND (contains(lower(text), 'the') OR contains(lower(text), 'hein')) AS chosen FROM benchmark""")
def eval_items(spark, d):
    """Items in the one schema of evaluation sets, with a zero-padded id, and whether a keyword chooses them."""
    t = F.col("text")
    chosen = (F.length(t) > 60) & F.exists(F.array(F.lit("the"), F.lit("hein")), lambda k: F.contains(F.lower(t), k))
    padded = F.lpad(F.col("item_id").cast("string"), F.greatest(F.length(F.col("item_id").cast("string")), F.lit(4)), F.lit("0"))
    return table(spark, d, "benchmark").select(F.concat(F.lit("item_"), padded).alias("id"), t.alias("question"), F.lit("").alias("answer"), chosen.alias("chosen"))


@query("""SELECT event_id, CASE WHEN least(value / 100 + CASE event_type WHEN 'error' THEN 0.1::DOUBLE WHEN 'view' THEN -0.02::DOUBLE ELSE 0 END, 1) >= 0.03 THEN round(least(value / 100 + CASE event_type WHEN 'error' THEN 0.1::DOUBLE WHEN 'view' THEN -0.02::DOUBLE ELSE 0 END, 1), 9) END AS confidence FROM events""")
def finding_confidence(spark, d):
    kind = F.when(F.col("event_type") == "error", "condition").when(F.col("event_type") == "view", "anatomy").otherwise("other")
    return table(spark, d, "events").select("event_id", F.round(S.adjusted_confidence(F.col("value"), kind), 9).alias("confidence"))
