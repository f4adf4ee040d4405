"""Queries over whole evaluation runs of the benchmark, and DuckDB SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prompts
from ..functions import safety as S
from ..functions import text as X
from ..operators import ask, grounding, runs
from ..session import table
from .clinical import _PROFILE, _TURNS, _mapped
from .registry import _CLAIMS, _DOT, _KW, _UNIT, _VEC, RERANK, SENT, WORDS, docs_of, query

TERMS = ("retina vessel lesion", "corneal opacity", "optic disc", "lens cataract")


def questions_of(spark, d):
    """Items with keywords, their first sentence as a reference, and for every third two options."""
    w, i = X.words(F.col("text")), F.col("item_id")
    options = F.when(i % 3 == 0, F.array(F.concat(F.lit("A. "), F.array_join(F.slice(w, 1, 2), " ")), F.concat(F.lit("B. "), F.array_join(F.slice(w, 5, 2), " "))))
    keywords = F.array_sort(F.array_distinct(F.filter(w, lambda x: F.length(x) >= 6)))
    return table(spark, d, "benchmark").select("item_id", F.col("text").alias("question"), options.alias("options"), F.when(i % 3 == 0, i % 2).alias("right"), F.get(X.split_sentences(F.col("text")), F.lit(0)).alias("reference"), keywords.alias("keywords"))


def chunks_of(spark, d):
    """Windows of all documents; a document is their parent."""
    own = grounding.windows(docs_of(spark, d), "doc_id", "text")
    return own.select((F.col("doc_id") * (1 << 20) + F.col("window_no")).alias("doc_id"), F.col("doc_id").alias("parent_id"), F.array_join("window", " ").alias("text"))


def answer_of(rows):
    """The first two sentences of the first source, and the first one of the question."""
    source, asked = X.split_sentences(F.get("texts", F.lit(0))), X.split_sentences(F.col("question"))
    return rows.withColumn("answer", F.concat(F.array_join(F.slice(source, 1, 2), " "), F.lit("\n"), F.get(asked, F.lit(0))))


def judge_of(rows):
    n = F.length("answer")
    return rows.withColumn("judged", F.concat(F.lit("ACCURACY: "), n % 5 + 1, F.lit("\nSafety: 9\nclarity: "), n % 3 + 2))


def runs_of(spark, d):
    parents = docs_of(spark, d).select(F.col("doc_id").alias("parent_id"), "source", F.col("lang").alias("path"), "text")
    return runs.evaluated(questions_of(spark, d), chunks_of(spark, d), parents, answer_of, runs.CONFIGS, terms=TERMS, judge=judge_of)


_RAW = "(SELECT item_id, question, f AS text, lower(f) AS q FROM full_q)"


def _clean(text: str, cap: int, banned=()) -> str:
    return _mapped(text, banned).replace("1, 18)", f"1, {cap})")


def _search(candidate: str, cap: int) -> str:
    both = f"({candidate} || ' ' || text)"
    case = f"CASE WHEN high_risk THEN {_clean(f'(\'{S.SEED_RISK} \' || {both})', cap, S.POSTERIOR)} WHEN surface_spot THEN {_clean(f'(\'{S.SEED_SPOT} \' || {both})', cap, S.POSTERIOR)} ELSE {_clean(both, cap)} END"
    return f"coalesce(nullif({case}, ''), {_clean(candidate, cap)})"


_CLAIM_ROWS = "a AS (SELECT item_id AS conv_id, wording || ' ' || lst AS turn, answer AS text, context FROM said), " + _CLAIMS[_CLAIMS.index("l AS (SELECT conv_id") :].replace("\ns AS", "\nsn AS").replace("FROM s WHERE", "FROM sn WHERE")
_CONFIGS = ", ".join(f"('{name}', '{w}', '{of}', {str(sure).lower()})" for name, (w, of, sure) in runs.CONFIGS.items())
_TOK = r"list_filter(string_split_regex(regexp_replace(lower({}), '[^a-z0-9\s]', '', 'g'), '\s+'), lambda x: x <> '')"
_SEEN = f"round(len(list_intersect(list_distinct({WORDS.format('claim')}), win)) / greatest(len(list_distinct({WORDS.format('claim')})), 1), 6)"
_REFUSED = " OR ".join("contains(lower(answer), '" + x.replace("'", "''") + "')" for x in grounding.REFUSALS)
_OF = lambda c: f"sqrt(list_sum(list_transform({c}, lambda x: x * x)))"
_SAID = lambda o: f"len(list_intersect(list_distinct({WORDS.format(o)}), {WORDS.format('answer')})) / greatest(len(list_distinct({WORDS.format(o)})), 1)"
_RUNS = f"""WITH RECURSIVE bw AS (SELECT item_id, text, {WORDS.format("text")} AS w, {_KW} AS keywords FROM benchmark),
qs AS (SELECT item_id, text AS question, keywords, {SENT.format("text")}[1] AS reference, CASE WHEN item_id % 3 = 0 THEN ['A. ' || array_to_string(w[1:2], ' '), 'B. ' || array_to_string(w[5:6], ' ')] ELSE [] END AS options, CASE WHEN item_id % 3 = 0 THEN item_id % 2 END AS right_no FROM bw),
full_q AS (SELECT *, CASE WHEN len(options) > 0 THEN question || chr(10) || chr(10) || 'Options:' || chr(10) || array_to_string(options, chr(10)) ELSE question END AS f FROM qs),
pr AS ({_PROFILE.replace(_TURNS, _RAW)}),
md AS (SELECT *, CASE WHEN length({_clean("text", 13)}) >= 5 THEN {_clean("text", 13)} ELSE text END AS base FROM pr),
rf AS MATERIALIZED (SELECT item_id, text, CASE WHEN high_risk THEN {_search(f"'{S.REFINED_RISK}'", 15)} WHEN surface_spot THEN {_search(f"'{S.SEED_SPOT}'", 15)} ELSE {_search("base", 13)} END AS refined FROM md),
asked AS MATERIALIZED (SELECT item_id * 4 AS item_id, text FROM rf UNION ALL SELECT item_id * 4 + 1, refined FROM rf UNION ALL SELECT item_id * 4 + 3, concat_ws(' ', {list(TERMS)}[('0x' || substr(md5(text), 1, 8))::BIGINT % {len(TERMS)} + 1], refined) FROM rf),
dw AS (SELECT doc_id, w, unnest(range(0, greatest(ceil((len(w) - 400) / 320), 0)::BIGINT + 1)) AS no FROM (SELECT doc_id, {WORDS.format("text")} AS w FROM documents) WHERE len(w) > 0),
chunks AS MATERIALIZED (SELECT doc_id * 1048576 + no AS doc_id, doc_id AS parent_id, array_to_string(list_slice(w, no * 320 + 1, no * 320 + 400), ' ') AS text FROM dw),
{RERANK.replace("documents", "chunks").replace("benchmark", "asked").replace("rr AS (", "rr AS MATERIALIZED (").replace("hy AS (", "hy AS MATERIALIZED (")},
hits AS (SELECT item_id, doc_id, rank, 'sparse' AS lst FROM top UNION ALL SELECT item_id, doc_id, rank, 'dense' FROM de UNION ALL SELECT item_id, doc_id, rank, 'fused' FROM hy UNION ALL SELECT item_id, doc_id, rerank_rank, 'reranked' FROM rk),
cf AS (SELECT * FROM (VALUES {_CONFIGS}) c(config, wording, lst, sure)),
hw AS (SELECT item_id // 4 AS item_id, ['raw', 'refined', 'normalized', 'augmented'][item_id % 4 + 1] AS wording, lst, parent_id, min(rank) AS rank FROM hits JOIN chunks USING (doc_id) WHERE rank <= 6 GROUP BY ALL),
h3 AS (SELECT *, row_number() OVER (PARTITION BY item_id, wording, lst ORDER BY rank) AS n FROM hw SEMI JOIN cf USING (wording, lst) QUALIFY n <= 3),
dc AS (SELECT item_id, wording, lst, list(text ORDER BY n) AS texts, string_agg('[Source ' || n || ': ' || coalesce(source, 'Unknown') || ' — ' || coalesce(lang, 'General') || ']' || chr(10) || regexp_replace(left(text, 2000), '^\\s+|\\s+$', '', 'g'), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n) AS context FROM h3 JOIN documents ON doc_id = parent_id GROUP BY ALL),
rn AS (SELECT q.*, r.wording, r.lst, coalesce(texts, []) AS texts, context FROM full_q q CROSS JOIN (SELECT DISTINCT wording, lst FROM cf) r LEFT JOIN dc ON dc.item_id = q.item_id AND dc.wording = r.wording AND dc.lst = r.lst),
ms AS MATERIALIZED (SELECT *, list_transform(texts, lambda t: len(list_filter(keywords, lambda k: contains(lower(t), k))) > 0) AS good, len(list_filter(keywords, lambda k: contains(lower(array_to_string(texts, ' ')), k))) AS found FROM rn),
said AS MATERIALIZED (SELECT item_id, wording, lst, array_to_string(list_slice({SENT.format("texts[1]")}, 1, 2), ' ') || chr(10) || {SENT.format("f")}[1] AS answer, context, keywords, reference, options, right_no FROM ms WHERE len(texts) > 0),
{_CLAIM_ROWS},
cw AS (SELECT conv_id, turn, list_slice(w, no * 320 + 1, no * 320 + 400) AS win FROM (SELECT conv_id, turn, w, unnest(range(0, greatest(ceil((len(w) - 400) / 320), 0)::BIGINT + 1)) AS no FROM (SELECT conv_id, turn, {WORDS.format("context")} AS w FROM a))),
cs AS (SELECT conv_id, turn, line_no, pos, max({_SEEN}) AS s FROM c JOIN cw USING (conv_id, turn) GROUP BY ALL),
vd AS (SELECT conv_id, turn, count(*) AS claims, count(*) FILTER (s <= 0.1) AS bad, count(*) FILTER (s > 0.1 AND s < 0.35) AS weak FROM cs GROUP BY ALL),
tk AS MATERIALIZED (SELECT item_id, wording, lst, {_TOK.format("answer")} AS x, {_TOK.format("reference")} AS y FROM said),
lc AS (SELECT item_id, wording, lst, 0 AS i, x, y, list_transform(y, lambda t: 0) AS r FROM tk
    UNION ALL SELECT item_id, wording, lst, i + 1, x, y, list_transform(range(1, len(y) + 1), lambda j: greatest(r[j], coalesce(list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN y[k] = x[i + 1] THEN coalesce(r[k - 1], 0) + 1 ELSE 0 END)), 0))) FROM lc WHERE i < len(x)),
rg AS (SELECT item_id, wording, lst, CASE WHEN len(x) > 0 AND len(y) > 0 THEN printf('%.4f', 2 * r[len(y)] / (len(x) + len(y))::DOUBLE)::DOUBLE ELSE 0 END AS rouge_l FROM lc WHERE i = len(x)),
vv AS (SELECT item_id, wording, lst, {_VEC.format("answer")} AS av, {_VEC.format("reference")} AS rv FROM said),
sm AS (SELECT item_id, wording, lst, round(greatest(list_sum(list_transform(list_zip(av, rv), lambda p: p[1] / {_OF("av")} * (p[2] / {_OF("rv")}))), 0), 4) AS similarity FROM vv),
op AS (SELECT item_id, wording, lst, answer, substr(options[right_no + 1], 4) AS o, ['A', 'B'][right_no + 1] AS letter, right_no, {_SAID("trim(substr(options[1], 4))")} AS s1, {_SAID("trim(substr(options[2], 4))")} AS s2 FROM said WHERE len(options) > 0),
ok AS (SELECT item_id, wording, lst, regexp_matches(answer, '(?i)\\b' || letter || '\\b') OR contains(lower(answer), lower(trim(o))) OR coalesce(CASE WHEN greatest(s1, s2) > 0.4 THEN CASE WHEN s1 >= s2 THEN 0 ELSE 1 END END = right_no, false) AS correct FROM op),
every_run AS MATERIALIZED (SELECT item_id, config, len(texts) AS returned, answer, CASE WHEN answer IS NULL THEN NULL WHEN NOT sure THEN 'SKIPPED' WHEN length(answer) < 150 AND ({_REFUSED}) THEN 'PASS' WHEN coalesce(claims, 0) = 0 THEN 'PASS' WHEN bad / claims > 0.5 THEN 'FAIL' WHEN bad + weak > 0 THEN 'PARTIAL' ELSE 'PASS' END AS verdict, correct,
    CASE WHEN len(texts) > 0 AND len(ms.keywords) > 0 THEN found / len(ms.keywords) ELSE 0 END::DOUBLE AS share, CASE WHEN len(texts) > 0 THEN len(list_filter(good, lambda x: x)) / len(texts) ELSE 0 END::DOUBLE AS exact, coalesce(1 / nullif(list_position(good, true), 0), 0)::DOUBLE AS first,
    rouge_l, similarity, CASE WHEN answer IS NULL THEN NULL WHEN len(ms.keywords) = 0 THEN 1 ELSE round((len(list_filter(ms.keywords, lambda k: contains(lower(answer), k))) / len(ms.keywords))::DOUBLE, 4) END::DOUBLE AS coverage
    FROM ms JOIN cf USING (wording, lst) LEFT JOIN said USING (item_id, wording, lst) LEFT JOIN vd ON conv_id = ms.item_id AND turn = ms.wording || ' ' || ms.lst LEFT JOIN rg USING (item_id, wording, lst) LEFT JOIN sm USING (item_id, wording, lst) LEFT JOIN ok USING (item_id, wording, lst)),
rounded AS (SELECT item_id, config, returned, md5(answer) AS answer, verdict, correct, round(share, 4) AS recall, round(first, 4) AS mrr, round(exact, 4) AS precision, round(100 * share, 1) AS hit_rate, rouge_l, similarity, coverage, CASE WHEN answer IS NOT NULL THEN round((length(answer) % 5 + length(answer) % 3 + 3) / 2, 2) END AS judge FROM every_run)"""


@query(f"{_RUNS} SELECT item_id, config, returned, answer, verdict, coalesce(correct::BIGINT, -1) AS correct, recall, mrr, precision, hit_rate, rouge_l, similarity, coverage, judge FROM rounded")
def evaluation_run(spark, d):
    """Each item of the benchmark in seven configurations: what it found, its answer, whether that is grounded and right (-1 without options), and its measures."""
    return runs_of(spark, d).withColumns({"answer": F.md5("answer"), "correct": F.coalesce(F.col("correct").cast("long"), F.lit(-1).cast("long"))})


_MEANS = ", ".join(f"round(avg({m}), 4) AS mean_{m}" for m in runs.MEASURES)


@query(f"""{_RUNS} SELECT config, count(*) AS n, {_MEANS}, round(avg(correct::INT), 4) AS accuracy,
    round(avg((verdict = 'PASS')::INT) FILTER (verdict IS NOT NULL AND verdict NOT IN ('SKIPPED', 'ERROR')), 4) AS pass_rate FROM rounded GROUP BY config""")
def evaluation_compare(spark, d):
    """The seven configurations compared."""
    return runs.summarised(runs_of(spark, d))


@query(f"""SELECT conv_id, turn, array_to_string(list_filter([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, CASE WHEN NOT fundus_context THEN 12 END, CASE WHEN spot AND surface_location AND NOT fundus_context THEN 13 END,
    CASE WHEN high_risk THEN 14 END, CASE WHEN high_risk THEN 15 END, CASE WHEN conv_id % 4 = 0 THEN 17 END, 18], lambda x: x IS NOT NULL), ',') AS rules FROM ({_PROFILE}) WHERE role = 'user'""")
def prompt_rules(spark, d):
    """The rules that a model is given for each turn of a user; every fourth conversation asks for another language."""
    own = table(spark, d, "conversations").where("role = 'user'")
    numbers = prompts.applied_rules(F.col("text"), language=F.when(F.col("conv_id") % 4 == 0, "Hindi"))
    return own.select("conv_id", "turn", F.array_join(F.transform(numbers, lambda n: n.cast("string")), ",").alias("rules"))


@query()
def ask_run(spark, d):
    """Each item of the benchmark, every seventh with a red flag, answered from windows of all documents; where that fails, from the sources alone."""
    i = F.col("item_id")
    asked = table(spark, d, "benchmark").select("item_id", F.when(i % 7 == 0, F.concat("text", F.lit(" A chemical burn."))).otherwise(F.col("text")).alias("question"), F.when(i % 2 == 0, F.array(F.lit("cornea"))).alias("terms"))
    parents = docs_of(spark, d).select(F.col("doc_id").alias("parent_id"), "source", F.col("lang").alias("path"), "text")

    def answer(rows):
        source = F.split_part("user", F.lit("SOURCES:\n\n"), F.lit(2))
        return rows.withColumn("answer", F.when(F.col("correction").isNull() & (F.col("item_id") % 3 == 0), F.reverse("question")).otherwise(F.left(source, F.lit(400))))

    return ask.ask(asked, chunks_of(spark, d), parents, answer)
