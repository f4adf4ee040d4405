"""Queries over turns of conversations: entities, slots, recorded memory; with SQL that says the same."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import answers, entities, memory, retrieval
from ..session import table
from ..streaming import recorder
from .registry import _DOT, ORACLES, WORDS, answers_of, observations, query

# Entities: a vocabulary of the words and pairs of words of the benchmark

_PLAIN = "^[a-z]{3,}$"
_LETTERS = r"[\p{L}\p{Nd}_]"
_VOCAB = f"""bw AS (SELECT {WORDS.format("text")} AS w FROM benchmark),
terms AS (SELECT unnest(w) AS term, unnest(w) AS name FROM bw UNION SELECT w[i] || ' ' || w[i + 1], w[i + 1] FROM bw, LATERAL (SELECT unnest(range(1, len(w))) AS i) WHERE regexp_matches(w[i], '{_PLAIN}')),
v AS (SELECT DISTINCT term, name, {list(entities.TYPES)}[length(name) % 7 + 1] AS type, 0.6::DOUBLE + (length(term) % 4) / 10::DOUBLE AS confidence, length(name) % 2 = 0 AS template FROM terms WHERE regexp_matches(name, '{_PLAIN}'))"""


def vocabulary_of(spark, d):
    words = table(spark, d, "benchmark").select(F.array_remove(F.split(F.lower("text"), r"\s+"), "").alias("w"))
    one = words.select(F.explode("w").alias("term")).select("term", F.col("term").alias("name"))
    two = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.struct(F.get("w", i - 1).alias("a"), F.get("w", i).alias("b")))).alias("p")).where(F.col("p.a").rlike(_PLAIN))
    terms = one.unionByName(two.select(F.concat_ws(" ", "p.a", "p.b").alias("term"), F.col("p.b").alias("name"))).where(F.col("name").rlike(_PLAIN)).distinct()
    kind = F.element_at(F.array(*[F.lit(t) for t in entities.TYPES]), F.length("name") % 7 + 1)
    return terms.select("term", "name", kind.alias("type"), (0.6 + (F.length("term") % 4) / 10).alias("confidence"), (F.length("name") % 2 == 0).alias("template"))


def turns_with_images(spark, d):
    """Turns with the findings of an image for those of users, and a model's answer for two thirds of the others."""
    own = table(spark, d, "conversations").withColumn("w", F.array_remove(F.split(F.lower("text"), r"\s+"), ""))
    w, n = lambda i: F.coalesce(F.get("w", F.lit(i)), F.lit("x")), F.length("text") % 90 + 5
    image = F.concat(F.lit("Detected Image Type: "), F.when(n % 2 == 0, "oct scan").otherwise("Some Camera"), F.lit("\n● Probable: "), w(0), F.lit(" ("), n, F.lit(".5%)\n- possible: "), w(1), F.lit(" (2"), n % 10, F.lit("%)"))
    said = F.concat(F.lit('Sure: [{"text": "'), F.regexp_replace(w(2), r'["\\]', ""), F.lit('", "entity_type": "Drug", "confidence": 0.'), n % 10, F.lit('}, {"text": "Lens", "entity_type": "condition", "confidence": 0.7}]'))
    k = (F.col("conv_id") + F.col("turn")) % 3
    user = F.col("role") == "user"
    return own.select(F.struct("conv_id", "turn").alias("key"), "turn", "text", F.when(user, "patient").otherwise("answer").alias("source"), F.when(user, image).alias("findings"), F.when(~user & (k == 0), said).when(~user & (k == 1), F.lit("[]")).alias("answer"))


def _first(groups, c: str) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains({c}, {_q(w)})' for w in words)} THEN '{g}'" for g, words in groups.items()) + " END"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _known(c: str, field: int, exact: bool = True) -> str:
    return "CASE " + " ".join(f"WHEN {c} = {_q(r[0])}{'' if exact else f' OR contains({_q(r[0])}, {c})'} THEN {_q(r[field])}" for r in entities.CONDITIONS) + " END"


def _normal(c: str, kind: str) -> str:
    long = " ".join(f"WHEN upper({c}) = '{k}' THEN '{v}'" for k, v in entities.ACRONYMS.items())
    return f"coalesce(CASE WHEN {kind} IN ('condition', 'finding') THEN {_known(f'lower({c})', 1, False)} END, CASE {long} END, trim(lower({c})))"


_ENTITY_SQL = f"""WITH {_VOCAB},
tw AS (SELECT conv_id, turn, role, text, coalesce(w[1], 'x') AS w0, coalesce(w[2], 'x') AS w1, coalesce(w[3], 'x') AS w2, length(text) % 90 + 5 AS n, (conv_id + turn) % 3 AS k FROM (SELECT *, {WORDS.format("text")} AS w FROM conversations)),
t AS (SELECT *, CASE role WHEN 'user' THEN 'patient' ELSE 'answer' END AS source, regexp_replace(lower(text), '\\s+', ' ', 'g') AS flat FROM tw),
image AS (SELECT conv_id, turn, turn AS at, 0 AS ord, CASE n % 2 WHEN 0 THEN 'optical coherence tomography' ELSE 'some camera' END AS modality, 'imaging' AS type, 0.95::DOUBLE AS confidence, modality AS text, NULL AS normalized, NULL AS m, NULL AS place FROM t WHERE role = 'user'),
seen AS (SELECT conv_id, turn, 1 AS ord, w0 AS name, (n || '.5')::DOUBLE / 100 + 0.1 AS c, n FROM t WHERE role = 'user' AND NOT contains(w0, '(') UNION ALL SELECT conv_id, turn, 2, w1, ('2' || (n % 10))::DOUBLE / 100 - 0.02, n FROM t WHERE role = 'user' AND NOT contains(w1, '(')),
found AS (SELECT *, coalesce({_known("name", 1)}, name) AS text, coalesce({_known("name", 2)}, 'finding') AS type FROM seen),
piece AS (SELECT conv_id, turn, source, string_split(flat, ' ') AS p FROM t),
held AS (SELECT DISTINCT conv_id, turn, source, unnest(regexp_extract_all(flat, '{_LETTERS}+')) AS term FROM t
    UNION SELECT conv_id, turn, source, regexp_extract(p[i], '{_LETTERS}+$') || ' ' || regexp_extract(p[i + 1], '^{_LETTERS}+') FROM piece, LATERAL (SELECT unnest(range(1, len(p))) AS i)),
words AS (SELECT conv_id, turn, source, lower(name) AS low, type, max(confidence) AS confidence FROM held JOIN v USING (term) GROUP BY ALL),
plain AS (SELECT DISTINCT conv_id, turn, name, type FROM t, v WHERE template AND (role = 'user' OR k = 2) AND contains(lower(text), name)),
rows AS (SELECT conv_id, turn, true AS image, ord, '' AS o2, text, type, confidence, 'visual' AS source, normalized, NULL AS modality, NULL AS place FROM image
    UNION ALL SELECT conv_id, turn, true, ord, '', text, type, least(c, 1), 'visual', {_known("name", 1)}, CASE n % 2 WHEN 0 THEN 'optical coherence tomography' ELSE 'some camera' END, coalesce({_first(entities.PLACES, "lower(text)")}, {_known("name", 3)}) FROM found WHERE c >= 0.03
    UNION ALL SELECT conv_id, turn, false, 10, low || chr(1) || type, low, type, confidence, source, {_normal("low", "type")}, NULL, NULL FROM words
    UNION ALL SELECT conv_id, turn, false, 20, '', regexp_replace(w2, '["\\\\]', '', 'g'), 'medication', (n % 10) / 10::DOUBLE, source, {_normal("regexp_replace(w2, '[\"\\\\]', '', 'g')", "'medication'")}, NULL, NULL FROM t WHERE role <> 'user' AND k = 0 AND n % 10 >= 5
    UNION ALL SELECT conv_id, turn, false, 21, '', 'Lens', 'condition', 0.7, source, 'lens', NULL, NULL FROM t WHERE role <> 'user' AND k = 0
    UNION ALL SELECT conv_id, turn, false, 30, type || chr(1) || name, name, type, 0.6, 'fallback', NULL, NULL, NULL FROM plain),
named AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY ord, o2) AS no FROM (SELECT *, coalesce(normalized, lower(text)) || chr(0) || type AS key FROM rows)),
lists AS (SELECT conv_id, turn, key, min(no) AS no, list(struct_pack(image := image, text := text, type := type, confidence := confidence, source := source, normalized := normalized, modality := modality, place := place) ORDER BY no) AS es FROM named GROUP BY ALL),
fold AS (SELECT conv_id, turn, no, list_reduce(es, lambda a, e: CASE WHEN e.image OR e.type = 'symptom' THEN e
    WHEN e.type = 'finding' AND a.confidence > 0.7 THEN struct_pack(image := a.image, text := a.text, type := a.type, confidence := least(a.confidence + 0.05, 1), source := a.source, normalized := a.normalized, modality := a.modality, place := a.place)
    WHEN a.confidence >= e.confidence THEN struct_pack(image := false, text := a.text, type := a.type, confidence := least(CASE WHEN a.source = 'visual' AND e.source = 'answer' THEN 0.7 ELSE 0.6 END * a.confidence + CASE WHEN a.source = 'visual' AND e.source = 'answer' THEN 0.3 ELSE 0.4 END * e.confidence, 1), source := 'merged', normalized := coalesce(a.normalized, e.normalized), modality := coalesce(a.modality, e.modality), place := coalesce(a.place, e.place))
    ELSE struct_pack(image := false, text := e.text, type := e.type, confidence := least(0.6 * e.confidence + 0.4 * a.confidence, 1), source := 'merged', normalized := coalesce(e.normalized, a.normalized), modality := coalesce(e.modality, a.modality), place := coalesce(e.place, a.place)) END) AS e FROM lists),
kept AS (SELECT f.conv_id, f.turn, no, e.* FROM fold f JOIN t ON f.conv_id = t.conv_id AND f.turn = t.turn WHERE e.confidence >= 0.5 AND NOT ({" OR ".join(f"contains(lower(t.text), '{x}' || lower(e.text))" for x in entities.DENIALS)}))
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY no) - 1 AS place, text, type, round(confidence, 6) AS confidence, source, normalized, modality, place AS spot,
    coalesce({_first(entities.REGIONS, "lower(text)")}, {_first(entities.REGIONS, "(" + _known("lower(text)", 3) + ")")}, 'unspecified') AS region, coalesce({_first(entities.PRIORITIES, "lower(text)")}, 'routine') AS priority FROM kept"""


@query(_ENTITY_SQL)
def entity_extraction(spark, d):
    """Image, rule, model and template entities of each turn, merged, filtered, bridged and tagged."""
    got = entities.extract(turns_with_images(spark, d), vocabulary_of(spark, d), "key", findings="findings", answer="answer")
    own = [c for c in entities.FIELDS if c not in ("turn", "place", "confidence")]
    return got.select("key.conv_id", "key.turn", F.col("no").alias("place"), F.round("confidence", 6).alias("confidence"), F.col("place").alias("spot"), *own)


# Memory: recorded in batches, and found by vectors


def shared_folder(spark) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_memory"
    return f"{root.rstrip('/')}/memory-{uuid.uuid4().hex}"


@query(ORACLES["memory_upsert"])
def memory_record(spark, d):
    """All observations, recorded in two batches of a stored memory, of which the first comes twice."""
    own, path = observations(spark, d).withColumn("subject", F.col("subject").cast("string")), shared_folder(spark)
    low, high = own.agg(F.min("ord"), F.max("ord")).first()
    if low is None:
        return recorder.load(spark, path)
    step = (high - low) // 2 + 1
    for n in (0, 0, 1):
        recorder.apply_batch(own.where(F.col("ord").between(low + n * step, low + (n + 1) * step - 1)), n, path, buckets=16)
    return recorder.load(spark, path).withColumns({"subject": F.col("subject").cast("long"), "confidence": F.round("confidence", 6)})


_SOURCES = "['visual', 'patient', 'rule', 'answer', 'x']"
_VECTOR_SQL = f"""WITH m AS (SELECT vec_id AS ord, label AS subject, CASE vec_id % 3 WHEN 0 THEN 'hall' WHEN 1 THEN 'study' END AS room, CASE vec_id % 2 WHEN 0 THEN 'symptom' ELSE 'condition' END AS type, (vec_id % 23)::VARCHAR AS value,
    (vec_id % 90 + 10) / 100::DOUBLE AS confidence, {_SOURCES}[vec_id % 5 + 1] AS source, embedding AS v, sqrt({_DOT.format(a="embedding", b="embedding")}) AS n FROM embeddings),
q AS (SELECT vec_id AS query_id, label AS subject, unnest(CASE vec_id % 2 WHEN 0 THEN ['hall', 'study'] ELSE [NULL] END) AS asked, embedding AS qv, sqrt({_DOT.format(a="embedding", b="embedding")}) AS qn FROM embeddings WHERE vec_id % 20 = 0 OR vec_id % 25 = 0),
b AS (SELECT query_id, asked, room, type, value, confidence, source, ord, abs(round(1 - {_DOT.format(a="v", b="qv")} / (n * qn), 6)) AS distance FROM q JOIN m USING (subject) WHERE asked IS NULL OR asked = room),
r AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY query_id, asked ORDER BY distance, ord) <= 18),
k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query_id, room, type, value ORDER BY distance, ord) = 1),
e AS (SELECT *, round(distance + (1 - confidence) * (0.1 + 0.35 * (1 - CASE source WHEN 'visual' THEN 1.0 WHEN 'patient' THEN 0.9 WHEN 'rule' THEN 0.75 WHEN 'answer' THEN 0.5 ELSE 0.6 END::DOUBLE)), 6) AS effective FROM k)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY effective, distance, ord) AS rank, room, type, value, ord, distance, effective FROM e QUALIFY rank <= 6"""


@query(_VECTOR_SQL)
def memory_vectors(spark, d):
    """Vectors as memories of their label; every twentieth and twenty-fifth asks, half of them for two rooms."""
    v = table(spark, d, "embeddings").withColumn("vector", F.col("embedding").cast("array<double>"))
    i = F.col("vec_id")
    m = v.select(i.alias("ord"), F.col("label").alias("subject"), F.when(i % 3 == 0, "hall").when(i % 3 == 1, "study").alias("room"), F.when(i % 2 == 0, "symptom").otherwise("condition").alias("type"), (i % 23).cast("string").alias("value"),
        ((i % 90 + 10) / 100).alias("confidence"), F.get(F.array(*[F.lit(s) for s in ("visual", "patient", "rule", "answer", "x")]), (i % 5).cast("int")).alias("source"), "vector")
    q = v.where((i % 20 == 0) | (i % 25 == 0)).select(i.alias("query_id"), F.col("label").alias("subject"), F.when(i % 2 == 0, F.array(F.lit("hall"), F.lit("study"))).alias("rooms"), "vector")
    return memory.nearest(m, q)


# Answers

_AGAIN = f"""WITH t AS (SELECT conv_id, turn, role, text, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS context FROM conversations),
w AS (SELECT *, list_distinct({WORDS.format("text")}) AS a, {WORDS.format("context")} AS c FROM t WHERE role = 'assistant'),
f AS (SELECT *, round(len(list_intersect(a, list_distinct(c))) / greatest(len(a), 1), 6) < 0.2 AS failed FROM w),
s AS (SELECT *, failed AND length(context) % 2 = 0 AS mended, context = '' AS empty FROM f)
SELECT conv_id, turn, md5(CASE WHEN mended THEN context ELSE text END) AS answer, CASE WHEN failed AND (NOT mended OR empty) THEN 'FAIL' ELSE 'PASS' END AS verdict, CASE WHEN failed THEN 1 ELSE 0 END::BIGINT AS retries FROM s"""


@query(_AGAIN)
def answers_again(spark, d):
    """Turns of assistants as answers, judged by the words they share with the turn before; half of those that fail are mended by it."""

    def answer(rows):
        mended = F.col("correction").isNotNull() & (F.length("context") % 2 == 0)
        return rows.withColumn("answer", F.when(mended, F.col("context")).otherwise(F.col("text")))

    def judge(rows):
        share = retrieval.overlap_score(F.col("answer"), F.col("context"))
        return rows.withColumns({"verdict": F.when(share < 0.2, "FAIL").otherwise("PASS"), "flagged": F.array("answer")})

    own = answers.answered(answers_of(spark, d), "key", answer, judge)
    return own.select("key.conv_id", "key.turn", F.md5("answer").alias("answer"), "verdict", "retries")


_OPTIONS = "['A. ' || p_name, 'B. ' || lower(p_type) || ' ring', 'ring', 'D. none of these', 'E.  ' || p_brand]"


@query(f"""WITH o AS (SELECT p_partkey, 'It is ' || CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN lower(p_type) ELSE 'unclear' END AS answer, {_OPTIONS} AS options FROM part),
s AS (SELECT p_partkey, list_transform(list_transform(options, lambda x: trim(CASE WHEN regexp_matches(x, '^[A-E]\\.') THEN substr(x, 4) ELSE x END)),
    lambda x: len(list_intersect(list_distinct({WORDS.format("x").replace("lambda x: x <>", "lambda y: y <>")}), {WORDS.format("answer").replace("lambda x: x <>", "lambda y: y <>")})) / greatest(len(list_distinct({WORDS.format("x").replace("lambda x: x <>", "lambda y: y <>")})), 1)) AS s FROM o)
SELECT p_partkey, CASE WHEN list_max(s) > 0.4 THEN list_position(s, list_max(s)) - 1 ELSE -1 END::BIGINT AS pick FROM s""")
def option_picks(spark, d):
    """The option that a sentence on each part chooses; -1 for none."""
    said = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).when(F.col("p_size") % 3 == 1, F.lower("p_type")).otherwise("unclear")
    lit = F.lit
    options = F.array(F.concat(lit("A. "), "p_name"), F.concat(lit("B. "), F.lower("p_type"), lit(" ring")), lit("ring"), lit("D. none of these"), F.concat(lit("E.  "), "p_brand"))
    return table(spark, d, "part").select("p_partkey", F.coalesce(answers.picked(F.concat(lit("It is "), said), options), lit(-1)).cast("long").alias("pick"))
