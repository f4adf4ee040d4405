"""Registered queries over the given tables, and DuckDB SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import rules as R
from ..functions import text as X
from ..operators import corpus, dictionary, evaluation, grounding, memory, retrieval, sessions, vectors
from ..session import cut, small_side, table
from ..sources import readers, sinks

# The entities that the given tables may hold, the ampersand last.
_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# Shared pieces of SQL: words, the normalised text, sentences.
WORDS = r"list_filter(string_split_regex(lower({}), '\s+'), lambda x: x <> '')"
NORM = r"trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"
SENT = r"string_split(regexp_replace(trim({}), '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1))"
BM25 = f"""
w AS MATERIALIZED (SELECT doc_id, {WORDS.format("text")} AS w FROM documents),
tf AS MATERIALIZED (SELECT doc_id, len(w) AS dl, term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM w) GROUP BY ALL),
st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT avg(len(w)) FROM w) AS avgdl),
i0 AS MATERIALIZED (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS idf FROM tf, st GROUP BY term),
i AS (SELECT term, df, CASE WHEN idf < 0 THEN 0.25::DOUBLE * (SELECT avg(idf) FROM i0) ELSE idf END AS idf FROM i0),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({WORDS.format("text")}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, round(sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
    FROM q JOIN i USING (term) JOIN tf USING (term, term), st GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10)""".replace("USING (term, term)", "USING (term)")


def docs_of(spark, d):
    return table(spark, d, "documents")


@query(f"WITH {BM25} SELECT item_id, doc_id, score, rank FROM top")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25_top_k(docs_of(spark, d), table(spark, d, "benchmark"))


@query(f"WITH {BM25} SELECT term, df, round(idf, 6) AS idf FROM i")
def bm25_term_stats(spark, d):
    return retrieval.term_statistics(docs_of(spark, d)).select("term", "df", F.round("idf", 6).alias("idf"))


_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"


@query(f"""WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id AS id, round({_DOT.format(a="embedding", b="qv")}, 6) AS score FROM embeddings, q WHERE vec_id <> query_id)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 10""")
def dense_topk(spark, d):
    e = table(spark, d, "embeddings")
    items = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    return retrieval.dense_top_k(items, asked).withColumn("rank", F.col("rank").cast("long"))


_VEC = f"list_transform(range(0, 16), lambda i: len(list_filter({WORDS.format('{}')}, lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % 16 = i))::DOUBLE)"
_UNIT = "list_transform(v, lambda x: CASE WHEN n > 0 THEN x / n ELSE x END)"
HYBRID = f"""{BM25},
dv AS (SELECT doc_id, {_UNIT} AS v FROM (SELECT doc_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (SELECT doc_id, {_VEC.format("text")} AS v FROM documents))),
qv AS (SELECT item_id, {_UNIT} AS qv FROM (SELECT item_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (SELECT item_id, {_VEC.format("text")} AS v FROM benchmark))),
de AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT item_id, doc_id, round({_DOT.format(a="v", b="qv")}, 6) AS score FROM dv, qv) QUALIFY rank <= 10),
fu AS (SELECT item_id, doc_id, round(sum(w / (60 + rank)), 9) AS score FROM (SELECT item_id, doc_id, rank, 0.4::DOUBLE AS w FROM top UNION ALL SELECT item_id, doc_id, rank, 0.6::DOUBLE FROM de) GROUP BY ALL),
hy AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM fu QUALIFY rank <= 12)"""


def hybrid(spark, d):
    return retrieval.hybrid_top_k(docs_of(spark, d), table(spark, d, "benchmark"))


@query(f"WITH {HYBRID} SELECT item_id, doc_id, score, rank FROM hy")
def rrf_hybrid_topk(spark, d):
    return hybrid(spark, d).withColumn("rank", F.col("rank").cast("long"))


RERANK = f"""{HYBRID},
rr AS (SELECT item_id, doc_id, rank AS was, round(len(list_intersect(list_distinct({WORDS.format("b.text")}), {WORDS.format("d.text")})) / greatest(len(list_distinct({WORDS.format("b.text")})), 1), 6) AS rerank_score
    FROM hy JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rerank_score DESC, was) AS rerank_rank FROM rr QUALIFY rerank_rank <= 6)"""


def reranked(spark, d):
    queries, docs = table(spark, d, "benchmark"), docs_of(spark, d)
    return retrieval.rerank(hybrid(spark, d), queries, docs, 6)


@query(f"WITH {RERANK} SELECT item_id, doc_id, was, rerank_score, rerank_rank FROM rk")
def rerank_topk(spark, d):
    return reranked(spark, d).select("item_id", "doc_id", F.col("was").cast("long").alias("was"), "rerank_score", F.col("rerank_rank").cast("long").alias("rerank_rank"))


@query(f"""WITH {RERANK}, f AS (SELECT *, doc_id // 10 AS parent_id, row_number() OVER (PARTITION BY item_id, doc_id // 10 ORDER BY rerank_rank) AS n FROM rk QUALIFY n = 1)
SELECT item_id, parent_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY rerank_rank) AS parent_rank FROM f QUALIFY parent_rank <= 3""")
def expand_parents(spark, d):
    return retrieval.expand_parents(reranked(spark, d), F.floor(F.col("doc_id") / 10).cast("long"), 3)


@query(f"""WITH {BM25}, u AS (SELECT item_id, doc_id, 0 AS list_no, rank FROM top UNION ALL SELECT item_id, doc_id, 1, 11 - rank FROM top),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id // 5 ORDER BY list_no, rank) AS n FROM u QUALIFY n = 1)
SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY list_no, rank) AS rank FROM k""")
def two_anchor_merge(spark, d):
    """Two ranked lists of a query, the first of equal keys (here five neighbouring documents)."""
    top = cut(retrieval.bm25_top_k(docs_of(spark, d), table(spark, d, "benchmark")))  # read twice
    both = top.select("item_id", "doc_id", F.lit(0).alias("list_no"), "rank").unionByName(top.select("item_id", "doc_id", F.lit(1).alias("list_no"), (11 - F.col("rank")).alias("rank")))
    own = corpus.keep_first(both.withColumn("key", F.floor(F.col("doc_id") / 5)), ["item_id", "key"], ["list_no", "rank"])
    w = Window.partitionBy("item_id").orderBy("list_no", "rank")
    return own.select("item_id", "doc_id", F.row_number().over(w).cast("long").alias("rank"))


_KW = f"list_sort(list_distinct(list_filter({WORDS.format('text')}, lambda x: length(x) >= 6)))"
METRICS = f"""{BM25}, kw AS (SELECT item_id, {_KW} AS keywords FROM benchmark),
h AS (SELECT item_id, rank, keywords, list_filter(keywords, lambda k: contains(lower(text), k)) AS found FROM top JOIN documents USING (doc_id) JOIN kw USING (item_id)),
pm AS (SELECT item_id, len(list_distinct(flatten(list(found)))) AS n_found, avg((len(found) > 0)::INT) AS p, min(rank) FILTER (len(found) > 0) AS f, count(*) AS returned FROM h GROUP BY item_id),
m AS (SELECT item_id, CASE WHEN len(keywords) > 0 THEN round(coalesce(n_found, 0) / len(keywords), 4) ELSE 0 END::DOUBLE AS recall, round(coalesce(p, 0)::DOUBLE, 4) AS precision,
    round(coalesce(1 / f, 0)::DOUBLE, 4) AS mrr, coalesce(returned, 0) AS returned FROM kw LEFT JOIN pm USING (item_id))"""


def metrics_of(spark, d):
    b = table(spark, d, "benchmark")
    keywords = F.array_sort(F.array_distinct(F.filter(X.words(F.col("text")), lambda x: F.length(x) >= 6)))
    return evaluation.retrieval_metrics(retrieval.bm25_top_k(docs_of(spark, d), b), b.select("item_id", keywords.alias("keywords")), docs_of(spark, d))


@query(f"WITH {METRICS} SELECT item_id, recall, precision, mrr, returned FROM m")
def retrieval_metrics(spark, d):
    return metrics_of(spark, d)


@query(f"WITH {METRICS} SELECT round(avg(recall), 4) AS mean_recall, round(avg(precision), 4) AS mean_precision, round(avg(mrr), 4) AS mean_mrr, count(*) AS n FROM m")
def eval_summary(spark, d):
    return evaluation.summary(metrics_of(spark, d))


@query(f"""WITH {METRICS} SELECT CASE WHEN returned = 0 THEN 'no_documents' WHEN precision = 0 THEN 'off_topic' WHEN recall < 0.5 THEN 'partial' ELSE 'hit' END AS reason, count(*) AS n FROM m GROUP BY 1""")
def failure_misses(spark, d):
    return evaluation.misses(metrics_of(spark, d))


@query(f"""WITH {HYBRID}, c AS (SELECT 'bm25_only' AS config, item_id, doc_id, rank FROM top UNION ALL SELECT 'dense_only', item_id, doc_id, rank FROM de UNION ALL SELECT 'full', item_id, doc_id, rank FROM hy)
SELECT config, round(avg((lang = 'en')::INT), 4) AS english_share, round(avg(toxic), 4) AS toxic_share, count(*) AS n FROM c JOIN documents USING (doc_id) LEFT JOIN labels USING (doc_id) GROUP BY config""")
def ablation_compare(spark, d):
    """What three configurations return, compared."""
    docs, b = docs_of(spark, d), table(spark, d, "benchmark")
    sparse = cut(retrieval.bm25_top_k(docs, b))
    items = docs.select(F.col("doc_id").alias("id"), retrieval.hashed_vector(F.col("text")).alias("v"))
    asked = b.select((-F.col("item_id") - 1).alias("query_id"), retrieval.hashed_vector(F.col("text")).alias("qv"))
    dense = cut(retrieval.dense_top_k(items, asked).select((-F.col("query_id") - 1).alias("item_id"), F.col("id").alias("doc_id"), F.col("rank").cast("long").alias("rank")))
    kind = lambda df, name: df.select("item_id", "doc_id", "rank", F.lit(name).alias("kind"))
    full = retrieval.fuse(kind(sparse, "sparse").unionByName(kind(dense, "dense")), 12)
    config = lambda df, name: df.select(F.lit(name).alias("config"), "item_id", "doc_id")
    all_hits = config(sparse, "bm25_only").unionByName(config(dense, "dense_only")).unionByName(config(full, "full"))
    own = all_hits.join(docs.select("doc_id", "lang"), "doc_id").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return own.groupBy("config").agg(F.round(F.avg(F.when(F.col("lang") == "en", 1).otherwise(0)), 4).alias("english_share"), F.round(F.avg("toxic"), 4).alias("toxic_share"), F.count(F.lit(1)).alias("n"))


# Texts


@query(f"SELECT doc_id, sha256({NORM.format('text')}) AS hash FROM documents")
def normalize_hash(spark, d):
    return docs_of(spark, d).select("doc_id", X.content_hash(F.col("text")).alias("hash"))


@query(f"""WITH h AS (SELECT doc_id, source, sha256({NORM.format('text')}) AS hash FROM documents)
SELECT doc_id, source, hash, min(doc_id) OVER (PARTITION BY hash) AS first_id, row_number() OVER (PARTITION BY hash ORDER BY doc_id) AS place FROM h""")
def dedup_report(spark, d):
    return corpus.duplicates(docs_of(spark, d))


@query(f"SELECT min(doc_id) AS doc_id, sha256({NORM.format('text')}) AS hash, count(*) AS copies FROM documents GROUP BY 2")
def dedup_keep_first(spark, d):
    return docs_of(spark, d).groupBy(X.content_hash(F.col("text")).alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query(f"""WITH h AS (SELECT doc_id, source, CASE source WHEN 'src3' THEN 1 WHEN 'src1' THEN 2 ELSE 99 END AS authority, sha256({NORM.format('text')}) AS hash FROM documents)
SELECT doc_id, source, authority FROM h QUALIFY row_number() OVER (PARTITION BY hash ORDER BY authority, doc_id) = 1""")
def cross_source_dedup_rank(spark, d):
    own = docs_of(spark, d).select("doc_id", "source", F.when(F.col("source") == "src3", 1).when(F.col("source") == "src1", 2).otherwise(99).alias("authority"), X.content_hash(F.col("text")).alias("hash"))
    return corpus.keep_first(own, ["hash"], ["authority", "doc_id"]).select("doc_id", "source", "authority")


@query(r"""SELECT doc_id, length(trim(text))::BIGINT AS chars, round(length(regexp_replace(text, '[^\p{L}]', '', 'g')) / greatest(length(text), 1), 6) AS alpha_ratio,
length(trim(text)) < 60 OR length(regexp_replace(text, '[^\p{L}]', '', 'g')) / greatest(length(text), 1) < 0.4 AS noise FROM documents""")
def noise_profile(spark, d):
    t = F.col("text")
    return docs_of(spark, d).select("doc_id", F.length(F.trim(t)).cast("long").alias("chars"), F.round(X.alpha_ratio(t), 6).alias("alpha_ratio"), X.is_noise(t).alias("noise"))


@query(f"SELECT doc_id, len({SENT.format('text')})::BIGINT AS sentences, list_max(list_transform({SENT.format('text')}, lambda s: length(s)))::BIGINT AS longest FROM documents")
def sentence_stats(spark, d):
    s = X.split_sentences(F.col("text"))
    return docs_of(spark, d).select("doc_id", F.size(s).cast("long").alias("sentences"), F.array_max(F.transform(s, F.length)).cast("long").alias("longest"))


@query(f"""WITH s AS (SELECT doc_id, unnest({SENT.format('text')}) AS sentence, unnest(range(0, len({SENT.format('text')}))) AS pos FROM documents) SELECT doc_id, pos, md5(sentence) AS hash FROM s""")
def sentence_explode(spark, d):
    return corpus.sentences(docs_of(spark, d)).select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("sentence").alias("hash"))


@query(f"""WITH s AS (SELECT doc_id, unnest({SENT.format('text')}) AS sentence, unnest(range(0, len({SENT.format('text')}))) AS pos FROM documents),
v AS (SELECT *, {_VEC.format("sentence")} AS r FROM s), u AS (SELECT doc_id, pos, sentence, list_transform(r, lambda x: CASE WHEN n > 0 THEN x / n ELSE x END) AS v FROM (SELECT *, sqrt(list_sum(list_transform(r, lambda x: x * x))) AS n FROM v)),
g AS (SELECT doc_id, pos, sentence, v, lead(v) OVER (PARTITION BY doc_id ORDER BY pos) AS nv FROM u),
e AS (SELECT doc_id, pos, sentence, CASE WHEN nv IS NOT NULL THEN round(1 - greatest(least({_DOT.format(a='v', b='nv')}, 1::DOUBLE), -1::DOUBLE), 9) END AS d FROM g),
p AS (SELECT doc_id, round(quantile_cont(d, 0.75::DOUBLE), 9) AS cut, count(*) AS n FROM e GROUP BY doc_id),
c AS (SELECT doc_id, pos, sentence, coalesce(sum(CASE WHEN n > 2 AND d > cut THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS chunk_no FROM e JOIN p USING (doc_id))
SELECT doc_id, chunk_no, md5(string_agg(sentence, ' ' ORDER BY pos)) AS hash, count(*) AS sentences FROM c GROUP BY ALL HAVING length(string_agg(sentence, ' ' ORDER BY pos)) >= 60""")
def semantic_chunks(spark, d):
    return corpus.chunks(docs_of(spark, d)).select("doc_id", "chunk_no", F.md5("chunk").alias("hash"), "sentences")


_LINE = "regexp_matches({0}, '^# \\S') OR regexp_matches({0}, '^## \\S')"


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
t AS (SELECT doc_id, trim(line) AS h FROM l)
SELECT doc_id, count(*) AS lines, count(*) FILTER (length(h) > 0 AND length(h) <= 120 AND len(string_split_regex(h, '\s+')) <= 18 AND NOT regexp_matches(h, 'https?://')
    AND length(h) - length(translate(h, '.!?;', '')) < 3 AND NOT regexp_matches(h, '[.!?]\s+[a-z]')) AS plausible FROM t GROUP BY doc_id""")
def heading_profile(spark, d):
    own = corpus.lines_of(docs_of(spark, d), F.col("text"))
    return own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(X.plausible_heading(F.col("line"))).alias("plausible"))


@query(r"""WITH p AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(html, '(?i)<h1[^>]*>(.*?)</h1>', chr(10) || '# \1' || chr(10), 'g'), '(?i)<h2[^>]*>(.*?)</h2>', chr(10) || '## \1' || chr(10), 'g'), '(?s)<[^>]+>', chr(10), 'g') AS t FROM pages),
l AS (SELECT page_id, unnest(string_split(t, chr(10))) AS line, unnest(range(0, len(string_split(t, chr(10))))) AS line_no FROM p)
SELECT page_id AS doc_id, count(*) FILTER (regexp_matches(line, '^# \S')) AS h1, count(*) FILTER (regexp_matches(line, '^## \S')) AS h2, count(*) FILTER (trim(line) <> '') AS filled FROM l GROUP BY page_id""")
def section_profile(spark, d):
    own = corpus.lines_of(pages_markdown(spark, d), F.col("text"))
    level = lambda p: F.count_if(F.col("line").rlike(p))
    return own.groupBy("doc_id").agg(level(r"^# \S").alias("h1"), level(r"^## \S").alias("h2"), F.count_if(F.trim("line") != "").alias("filled"))


def pages_markdown(spark, d):
    t = F.regexp_replace(F.regexp_replace("html", r"(?i)<h1[^>]*>(.*?)</h1>", "\n# $1\n"), r"(?i)<h2[^>]*>(.*?)</h2>", "\n## $1\n")
    return table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("source"), F.regexp_replace(t, r"(?s)<[^>]+>", "\n").alias("text"))


_MARKDOWN = r"""p AS (SELECT page_id AS doc_id, url AS source, regexp_replace(regexp_replace(regexp_replace(html, '(?i)<h1[^>]*>(.*?)</h1>', chr(10) || '# \1' || chr(10), 'g'), '(?i)<h2[^>]*>(.*?)</h2>', chr(10) || '## \1' || chr(10), 'g'), '(?s)<[^>]+>', chr(10), 'g') AS text FROM pages)"""
_PLAUSIBLE = r"length(h) > 0 AND length(h) <= 120 AND len(string_split_regex(h, '\s+')) <= 18 AND NOT regexp_matches(h, 'https?://') AND length(h) - length(translate(h, '.!?;', '')) < 3 AND NOT regexp_matches(h, '[.!?]\s+[a-z]')"


@query(rf"""WITH {_MARKDOWN}, c AS (SELECT doc_id, source, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]{{2,}}', ' ', 'g'), '(?m)[ \t]+$', '', 'g'), '^\s+|\s+$', '', 'g') AS t FROM p),
l AS (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS line, unnest(range(0, len(string_split(t, chr(10))))) AS line_no FROM c),
h AS (SELECT *, trim(regexp_replace(line, '^#{{1,2}} ', '')) AS h FROM l),
v AS (SELECT *, CASE WHEN NOT ({_PLAUSIBLE}) THEN NULL WHEN regexp_matches(line, '^# \S') THEN 1 WHEN regexp_matches(line, '^## \S') THEN 2 END AS level FROM h),
i AS (SELECT *, count(level) OVER w AS island, count(*) FILTER (level = 1) OVER w AS h1s, coalesce(last_value(CASE WHEN level = 1 THEN h END IGNORE NULLS) OVER w, source) AS chapter FROM v WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
s AS (SELECT *, last_value(CASE WHEN level = 2 THEN h END IGNORE NULLS) OVER (PARTITION BY doc_id, h1s ORDER BY line_no) AS section FROM i),
b AS (SELECT doc_id, island, arg_min(chapter, line_no) AS chapter, arg_min(coalesce(section, chr(0)), line_no) AS section, regexp_replace(string_agg(line, chr(10) ORDER BY line_no) FILTER (level IS NULL), '^\s+|\s+$', '', 'g') AS body FROM s GROUP BY ALL)
SELECT doc_id, island AS section_no, chapter, CASE WHEN section = chr(0) THEN chapter ELSE section END AS section, CASE WHEN section <> chr(0) AND section <> chapter THEN chapter || ' > ' || section ELSE chapter END AS path, length(body) AS chars FROM b WHERE length(body) >= 20""")
def section_islands(spark, d):
    return corpus.sections(pages_markdown(spark, d), 20).select("doc_id", "section_no", "chapter", "section", "path", F.length("body").cast("long").alias("chars"))


@query(rf"""WITH {_MARKDOWN}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM p),
v AS (SELECT *, length(regexp_extract(line, '^(#{{1,6}})\s+(.+)$', 1)) AS level, trim(regexp_extract(line, '^(#{{1,6}})\s+(.+)$', 2)) AS h FROM l),
s AS (SELECT *, CASE WHEN level = 1 AND lower(h) = 'contents' THEN 1 WHEN level = 2 AND length(h) BETWEEN 1 AND 140 AND len(string_split_regex(h, '\s+')) <= 20 AND length(h) - length(translate(h, '.!?;', '')) < 3
    AND NOT regexp_matches(h, '(?i)https?://|www\.') AND NOT regexp_matches(h, '(?i)^\*(source|url|metadata)\*\s*:') AND NOT regexp_matches(h, '[.!?]\s+[A-Z]') THEN 2 END AS structural FROM v),
i AS (SELECT *, count(structural) OVER w AS island, coalesce(last_value(structural IGNORE NULLS) OVER w, 0) = 2 AS inside FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
b AS (SELECT *, bool_or(structural IS NULL AND NOT (level = 0 AND (trim(line) = '' OR regexp_matches(trim(line), '(?i)^\*(source|url|metadata)\*\s*:')))) OVER (PARTITION BY doc_id, island ORDER BY line_no) AS begun FROM i)
SELECT doc_id, count(*) FILTER (inside AND level > 0 AND structural IS NULL) AS neutralised, count(*) FILTER (NOT inside) AS outside, count(*) FILTER (inside AND NOT begun) AS metadata, count(*) FILTER (inside AND begun) AS body, count(*) AS lines FROM b GROUP BY doc_id""")
def sanitize_headings(spark, d):
    own = corpus.sanitized_lines(pages_markdown(spark, d), ["Contents"])
    states = [F.count_if(F.col("state") == s).alias(s) for s in ("outside", "metadata", "body")]
    return own.groupBy("doc_id").agg(F.count_if("neutralised").alias("neutralised"), *states, F.count(F.lit(1)).alias("lines"))


_UN = "html"
for _a, _b in _ENTITIES:
    _UN = f"replace({_UN}, '{_a.replace(chr(39), chr(39) * 2)}', '{_b.replace(chr(39), chr(39) * 2)}')"


def _sql_clean(x: str) -> str:
    for a, b in _ENTITIES:
        x = f"replace({x}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    for p, n in ((" ", "' '"), (r"\r\n?", "chr(10)"), (r"\t", "' '"), (r"\n{3,}", "chr(10) || chr(10)"), (" {2,}", "' '"), (r"^\s+|\s+$", "''")):
        x = f"regexp_replace({x}, '{p}', {n}, 'g')"
    return x


def _sql_strip(x: str) -> str:
    tags = "|".join(X.LINE_TAGS)
    for p, n in (
        (r"(?is)<script[^>]*>.*?</script>", "' '"), (r"(?is)<style[^>]*>.*?</style>", "' '"), (r"(?is)<noscript[^>]*>.*?</noscript>", "' '"),
        (rf"(?i)<br\s*/?>|</({tags})>", "chr(10)"), (r"(?s)<[^>]+>", "' '"), (r"[ \t]+", "' '"), (r" *\n *", "chr(10)"),
    ):
        x = f"regexp_replace({x}, '{p}', {n}, 'g')"
    return _sql_clean(x)


@query(f"SELECT page_id, md5({_sql_strip('html')}) AS hash, length({_sql_strip('html')})::BIGINT AS chars FROM pages")
def html_strip(spark, d):
    t = X.strip_html(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.md5(t).alias("hash"), F.length(t).cast("long").alias("chars"))


@query(f"SELECT doc_id, md5({_sql_clean('text')}) AS hash FROM documents")
def clean_text(spark, d):
    return docs_of(spark, d).select("doc_id", F.md5(X.clean_text(F.col("text"))).alias("hash"))


@query(r"""SELECT page_id, coalesce(nullif(trim(regexp_replace(trim(regexp_replace(""" + _UN.replace("html", r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)") + r""", '\s+', ' ', 'g')), '\s[|\-]\s[^|\-]*$', '', 'g')), ''), url) AS title FROM pages""")
def html_title(spark, d):
    return table(spark, d, "pages").select("page_id", X.extract_title(F.col("html"), F.col("url")).alias("title"))


@query(r"""SELECT page_id, md5(coalesce(nullif(regexp_extract(html, '(?is)<main[^>]*>(.*?)</main>', 1), ''), CASE WHEN length(regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1)) > 500 THEN regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1) END,
nullif(regexp_extract(html, '(?is)<body[^>]*>(.*?)</body>', 1), ''), html)) AS hash FROM pages""")
def html_region(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(X.extract_region(F.col("html"))).alias("hash"))


@query("""SELECT DISTINCT page_id, link FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)href="([^"#]+)', 1)) AS link FROM pages) WHERE link <> ''""")
def link_harvest(spark, d):
    return readers.links(table(spark, d, "pages"))


@query(r"""SELECT doc_id, CASE WHEN length(f) > 140 THEN rtrim(left(f, 137)) || '...' ELSE f END AS title FROM
(SELECT doc_id, string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?])\s+', '\1' || chr(1)), chr(1))[1] AS f FROM documents)""")
def title_from_text(spark, d):
    return docs_of(spark, d).select("doc_id", X.title_from_text(F.col("text")).alias("title"))


@query(r"""SELECT doc_id, md5(CASE WHEN length(text) <= 500 THEN text ELSE regexp_replace(left(text, 499), '\s+$', '') || chr(10) END) AS cut, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]{2,}', ' ', 'g'), '(?m)[ \t]+$', '', 'g'), '^\s+|\s+$', '', 'g')) AS md,
'wing_' || left(regexp_replace(regexp_replace(lower(source || ' / ' || lang), '[^a-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g'), 80) AS slug, left(sha256(concat_ws('|', source, doc_id::VARCHAR)), 32) AS id FROM documents""")
def text_scalars(spark, d):
    t = F.col("text")
    return docs_of(spark, d).select("doc_id", F.md5(X.truncate(t, 500)).alias("cut"), F.md5(X.clean_md(t)).alias("md"), X.slug("wing", F.concat_ws(" / ", "source", "lang")).alias("slug"), X.record_id(F.col("source"), F.col("doc_id").cast("string")).alias("id"))


@query()
def collapse_repeats(spark, d):
    return docs_of(spark, d).select("doc_id", F.length(X.collapse_repeats(F.col("text"))).cast("long").alias("chars"))


@query("SELECT source, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY source")
def manifest_counts(spark, d):
    return corpus.manifest(docs_of(spark, d))


@query("SELECT doc_id, 'lang=' || lang || '; source=' || source AS rendered FROM documents")
def render_metadata(spark, d):
    m = F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"))
    return docs_of(spark, d).select("doc_id", sinks.render_metadata(m).alias("rendered"))


@query("SELECT doc_id, contains(lower(text), 'the') AS relevant FROM documents WHERE length(text) >= 300 ORDER BY relevant DESC, doc_id LIMIT 200")
def quota_fill(spark, d):
    own = docs_of(spark, d).where(F.length("text") >= 300)
    return corpus.quota(own, F.contains(F.lower("text"), F.lit("the")), 200, ["doc_id"]).select("doc_id", "relevant")


@query("""SELECT a.doc_id FROM documents a WHERE a.lang = 'en' AND length(text) > 100 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = a.doc_id)""")
def unseen_ids(spark, d):
    return docs_of(spark, d).where((F.col("lang") == "en") & (F.length("text") > 100)).select("doc_id").join(table(spark, d, "labels"), "doc_id", "left_anti")


@query(r"""SELECT source, count(*) FILTER (regexp_matches(lower(text), '\bthe\b')) AS word_hits, count(*) FILTER (contains(lower(text), 'of the')) AS phrase_hits,
count(*) FILTER (regexp_matches(lower(text), '\bthe\b') AND contains(lower(text), 'of the')) AS gate FROM documents GROUP BY source""")
def keyword_gate(spark, d):
    word, phrase = X.keyword_hit(F.col("text"), "the"), X.keyword_hit(F.col("text"), "of the")
    return docs_of(spark, d).groupBy("source").agg(F.count_if(word).alias("word_hits"), F.count_if(phrase).alias("phrase_hits"), F.count_if(word & phrase).alias("gate"))


# Queries and rules

_QT = r"list_transform(regexp_extract_all(regexp_replace({}, '```|[\[\]{{}}\"]', ' ', 'g'), '[a-zA-Z][a-zA-Z0-9''\-]*'), lambda x: lower(x))"


def _stable_distinct(x: str) -> str:
    return f"list_filter({x}, lambda x, i: list_position({x}, x) = i)"


_NQ = _QT.format("text")
_NQ = f"list_filter(list_transform({_NQ}, lambda x: CASE x WHEN 'thee' THEN 'the' WHEN 'er' THEN 'her' ELSE x END), lambda x: x IN ('on', 'at') OR (length(x) > 2 AND x NOT IN ('the', 'and', 'that')))"


@query(f"WITH t AS (SELECT item_id, {_NQ} AS t FROM benchmark) SELECT item_id, array_to_string(list_slice({_stable_distinct('t')}, 1, 12), ' ') AS query FROM t")
def query_normalize(spark, d):
    q = R.normalize_query(F.col("text"), {"thee": "the", "er": "her"}, ("the", "and"), ("that",), ("on", "at"))
    return table(spark, d, "benchmark").select("item_id", q.alias("query"))


@query(f"""WITH t AS (SELECT item_id, list_no, unnest(t) AS token, unnest(range(0, len(t))) AS pos FROM (SELECT item_id, 0 AS list_no, {_QT.format("text")} AS t FROM benchmark UNION ALL SELECT item_id, 1, list_reverse({_QT.format("text")}) FROM benchmark)),
f AS (SELECT item_id, token, min(row(pos, list_no)) AS place_at FROM t GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY place_at) AS place, token FROM f QUALIFY place <= 28""")
def query_interleave(spark, d):
    t = R.query_tokens(F.col("text"))
    b = table(spark, d, "benchmark")
    return sessions.interleave(b.select("item_id", F.lit(0).alias("list_no"), t.alias("tokens")).unionByName(b.select("item_id", F.lit(1).alias("list_no"), F.reverse(t).alias("tokens"))), "item_id")


_LIGHT = f"(len(t) <= 3 OR (NOT list_has_any(t, ['and', 'the']) AND len(t) <= 10) OR len(list_filter(t, lambda x: x IN ('it', 'that', 'this'))) / greatest(len(t), 1) >= 0.5)"


@query(f"SELECT conv_id, turn, {_LIGHT} AS light FROM (SELECT conv_id, turn, {_QT.format('text')} AS t FROM conversations WHERE role = 'user')")
def context_light(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", sessions.light_turn(F.col("text")).alias("light"))


@query(f"""WITH u AS (SELECT conv_id, turn, text, {_LIGHT} AS light FROM (SELECT conv_id, turn, text, {_QT.format('text')} AS t FROM conversations WHERE role = 'user'))
SELECT conv_id, turn, text, light, last_value(CASE WHEN NOT light THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_substantive,
array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), ' | ') AS recent FROM u""")
def turn_history(spark, d):
    return sessions.history(table(spark, d, "conversations"), sessions.light_turn(F.col("text")))


_RULES = ((r"\bdisgust", "emergency"), (r"\bthe\b.*\bof\b", "urgent"), (r"\bthis\b", "elective"))


@query(r"""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '\bdisgust') THEN 'emergency' WHEN regexp_matches(lower(text), '\bthe\b.*\bof\b') THEN 'urgent' WHEN regexp_matches(lower(text), '\bthis\b') THEN 'elective' ELSE 'none' END AS triage,
regexp_matches(lower(text), '\b(no|without)\s+the\b') AS negated FROM conversations""")
def triage_rules(spark, d):
    t = F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", R.first_case(t, _RULES, "none").alias("triage"), R.negated(t, "the").alias("negated"))


@query(r"""SELECT event_id, CASE WHEN starts_with(event_type, 'view') THEN 'visual' ELSE 'other' END AS b, round(0.55 * c + 0.25 / (1 + h / 72.0) + 0.2 * least(n / 5.0, 1), 7) AS score,
round(greatest(c * pow(0.9::DOUBLE, n), 0.1), 6) AS decayed, c >= 0.65 OR (c >= 0.4 AND n >= 2) AS stable, round(h / 100 + 0.05 + (1 - c) * (0.1 + 0.35 * (1 - 0.75)), 6) AS distance,
CASE WHEN c >= 0.15 THEN 'probable' WHEN c >= 0.05 THEN 'possible' ELSE 'unlikely' END AS band
FROM (SELECT event_id, event_type, (event_id % 100) / 100::DOUBLE AS c, (event_id % 7)::BIGINT AS n, (event_id % 240)::DOUBLE AS h FROM events)""")
def scoring_rules(spark, d):
    c, n, h = (F.col("event_id") % 100) / 100.0, F.col("event_id") % 7, (F.col("event_id") % 240).cast("double")
    bucket = F.when(F.col("event_type").startswith("view"), "visual").otherwise("other")
    return table(spark, d, "events").select("event_id", bucket.alias("b"), F.round(R.recency_score(c, h, n), 7).alias("score"), F.round(R.decayed(c, n), 6).alias("decayed"), R.is_stable(c, n).alias("stable"),
        F.round(R.effective_distance(h / 100, F.lit(0.05), c, F.lit(0.75)), 6).alias("distance"), R.probability_band(c).alias("band"))


# Dictionaries and entities: a neutral dictionary of frequent tokens

_DICT = [("anterior", "anatomy", "the of", 0.8), ("posterior", "anatomy", "and", 0.78), ("sign", "finding", "that", 0.82), ("sight", "symptom", "with", 0.75), ("lens", "condition", "ing", 0.7), ("lens", "condition", "this", 0.86)]
_DICT_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {e}::DOUBLE)" for a, b, c, e in _DICT) + ") d(name, type, term, confidence)"
_HITS = rf"SELECT conv_id, turn, name, type, max(confidence) AS confidence FROM conversations, {_DICT_SQL} WHERE regexp_matches(lower(text), '\b' || regexp_replace(term, '\s+', '\\s+', 'g') || '\b') GROUP BY ALL"


def entities_of(spark, d):
    own = table(spark, d, "conversations").withColumn("key", F.struct("conv_id", "turn"))
    hits = dictionary.pattern_hits(own, "key", "text", spark.createDataFrame(_DICT, "name string, type string, term string, confidence double"))
    return hits.select("key.conv_id", "key.turn", "name", "type", "confidence")


@query(_HITS)
def pattern_entities(spark, d):
    return entities_of(spark, d)


@query(rf"""WITH h AS ({_HITS}), r AS (SELECT h.*, CASE role WHEN 'user' THEN 'patient' WHEN 'assistant' THEN 'answer' ELSE 'other' END AS source FROM h JOIN conversations USING (conv_id, turn)),
k AS (SELECT *, CASE source WHEN 'patient' THEN 2 WHEN 'answer' THEN 1 ELSE 0 END AS rk, count(*) OVER (PARTITION BY conv_id, name, type) AS mentions FROM r)
SELECT conv_id, name, type, source, confidence, turn, mentions FROM k QUALIFY row_number() OVER (PARTITION BY conv_id, name, type ORDER BY rk DESC, confidence DESC, turn) = 1""")
def entity_merge(spark, d):
    roles = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", "patient").when(F.col("role") == "assistant", "answer").otherwise("other").alias("source"))
    return dictionary.merge_entities(entities_of(spark, d).join(roles, ["conv_id", "turn"]), ["conv_id", "name", "type"])


@query(rf"""SELECT conv_id, turn, term FROM conversations, (VALUES ('the'), ('of'), ('and')) w(term) WHERE contains(lower(text), term) AND NOT ({" OR ".join(f"contains(lower(text), '{n}' || term)" for n in dictionary.NEGATIONS)})""")
def negation_filter(spark, d):
    own = table(spark, d, "conversations").withColumn("key", F.struct("conv_id", "turn"))
    terms = spark.createDataFrame([("the",), ("of",), ("and",)], "term string")
    hits = own.select("key", F.lower("text").alias("t")).join(F.broadcast(terms), F.contains("t", F.col("term"))).drop("t")
    return dictionary.not_negated(hits, own, "key", "text", "term").select("key.conv_id", "key.turn", "term")


@query(rf"""WITH h AS ({_HITS}), e AS (SELECT conv_id, name, list(struct_pack(type := type, c := confidence) ORDER BY turn, type, confidence) AS es FROM h GROUP BY ALL)
SELECT conv_id, name, round((list_reduce(es, lambda a, x: struct_pack(type := x.type, c := CASE WHEN x.type = 'symptom' THEN x.c WHEN x.type = 'finding' AND a.c > 0.7 THEN least(a.c + 0.05, 1) ELSE least(0.6 * greatest(a.c, x.c) + 0.4 * least(a.c, x.c), 1) END)))['c'], 6) AS confidence FROM e""")
def entity_fold(spark, d):
    """Confidence of each entity of a conversation after its mentions were folded in turn order."""
    own = entities_of(spark, d).groupBy("conv_id", "name").agg(F.array_sort(F.collect_list(F.struct("turn", "type", "confidence"))).alias("e"))
    return own.select("conv_id", "name", F.round(dictionary.weighted_fold(F.transform("e", lambda x: F.struct(x["type"].alias("type"), x["confidence"].alias("confidence")))), 6).alias("confidence"))


_GROUPS = [("toxic", 0, 0, "idiot"), ("toxic", 0, 1, "moron"), ("legal", 1, 0, "license"), ("legal", 1, 1, "copyright"), ("contact", 2, 0, "@")]
_GROUPS_SQL = "(VALUES " + ", ".join(f"('{g}', {o}, {k}, '{w}')" for g, o, k, w in _GROUPS) + ") g(grp, group_ord, kw_ord, keyword)"


@query(f"""WITH h AS (SELECT doc_id, grp, row_number() OVER (PARTITION BY doc_id ORDER BY group_ord, kw_ord) AS n FROM documents, {_GROUPS_SQL} WHERE contains(lower(text), keyword) QUALIFY n = 1)
SELECT doc_id, coalesce(grp, 'other') AS "group" FROM documents LEFT JOIN h USING (doc_id)""")
def first_match_taxonomy(spark, d):
    return dictionary.first_match(docs_of(spark, d), "doc_id", "text", spark.createDataFrame(_GROUPS, "group string, group_ord int, kw_ord int, keyword string"), "other")


@query("""WITH l AS (SELECT DISTINCT lang || ', ' || source AS label FROM documents)
SELECT label, CASE WHEN starts_with(label, 'en,') THEN 'en' WHEN starts_with(label, 'fr,') THEN 'fr' END AS prefix, trim(CASE WHEN starts_with(label, 'en,') OR starts_with(label, 'fr,') THEN substr(label, 4) ELSE label END) AS rest FROM l""")
def prefix_parse(spark, d):
    labels = docs_of(spark, d).select(F.concat_ws(", ", "lang", "source").alias("label")).distinct()
    return dictionary.longest_prefix(labels, "label", spark.createDataFrame([("en",), ("fr",)], "prefix string"))


# Vectors

_CENT = """p AS (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings) GROUP BY ALL),
c AS (SELECT label, list(m / n ORDER BY i) AS centroid FROM p JOIN (SELECT label, sqrt(sum(m * m)) AS n FROM p GROUP BY label) USING (label) GROUP BY label),
sc AS (SELECT vec_id, e.label, c.label AS candidate, round(""" + _DOT.format(a="embedding", b="centroid") + """, 6) AS score FROM embeddings e, c)"""


@query(f"WITH {_CENT} SELECT label, i, round(x, 6) AS x FROM (SELECT label, unnest(range(0, len(centroid))) AS i, unnest(centroid) AS x FROM c)")
def label_centroids(spark, d):
    return vectors.centroids(table(spark, d, "embeddings")).select("label", F.posexplode("centroid").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


def scores_of(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.label_scores(e, vectors.centroids(e))


@query(f"WITH {_CENT} SELECT vec_id, label, candidate AS predicted, score FROM sc QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, candidate) = 1")
def centroid_classify(spark, d):
    best = retrieval.top_k(scores_of(spark, d), "vec_id", [F.desc("score"), F.asc("candidate")], 1)
    return best.select("vec_id", "label", F.col("candidate").alias("predicted"), "score")


@query(f"""WITH {_CENT}, z AS (SELECT vec_id, candidate % 2 AS mask, candidate, score, score * 200 AS z FROM sc),
e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id, mask)) AS e FROM z)
SELECT vec_id, mask, candidate, round(e / sum(e) OVER (PARTITION BY vec_id, mask), 6) AS p, row_number() OVER (PARTITION BY vec_id, mask ORDER BY score DESC, candidate) AS rank FROM e QUALIFY rank <= 3""")
def masked_softmax(spark, d):
    return vectors.masked_softmax(scores_of(spark, d).withColumn("mask", F.col("candidate") % 2), "mask")


@query(f"""WITH {_CENT}, b AS (SELECT vec_id, label, candidate FROM sc QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, candidate) = 1)
SELECT count(*) FILTER (candidate = label) AS "right", count(*) AS n, round(100.0::DOUBLE * count(*) FILTER (candidate = label) / count(*), 2) AS accuracy FROM b""")
def centroid_accuracy(spark, d):
    return evaluation.accuracy(centroid_classify(spark, d).select("vec_id", "predicted"), table(spark, d, "embeddings").select("vec_id", "label"), "vec_id", "label")


# Conversations, grounding, memory


def answers_of(spark, d):
    """Each assistant turn with the text before it as its context."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    own = table(spark, d, "conversations").withColumn("context", F.coalesce(F.lag("text").over(w), F.lit("")))
    return own.where("role = 'assistant'").select(F.struct("conv_id", "turn").alias("key"), "text", "context")


_ANS = "a AS (SELECT * FROM (SELECT conv_id, turn, role, text, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS context FROM conversations) WHERE role = 'assistant')"
_CLAIMS = rf"""{_ANS},
l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM a),
s AS (SELECT conv_id, turn, line_no, unnest({SENT.format("line")}) AS claim, unnest(range(0, len({SENT.format("line")}))) AS pos FROM l WHERE trim(line) <> '' AND NOT regexp_matches(line, '^\s*#')),
c AS (SELECT conv_id, turn, line_no, pos, regexp_replace(trim(claim), '^[-*•]\s*', '') AS claim FROM s WHERE length(trim(claim)) >= 25 AND len({WORDS.format("claim")}) > 4
    QUALIFY row_number() OVER (PARTITION BY conv_id, turn, lower(regexp_replace(trim(claim), '^[-*•]\s*', '')) ORDER BY line_no, pos) = 1)"""


@query(f"WITH {_CLAIMS} SELECT conv_id, turn, line_no, pos, md5(claim) AS hash FROM c")
def claim_extract(spark, d):
    return grounding.claims(answers_of(spark, d), "key", "text").select("key.conv_id", "key.turn", F.col("line_no").cast("long").alias("line_no"), F.col("pos").cast("long").alias("pos"), F.md5("claim").alias("hash"))


@query(f"""WITH w AS (SELECT doc_id, {WORDS.format("text")} AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, greatest(ceil((len(w) - 400) / 320), 0)::BIGINT + 1)) AS window_no FROM w WHERE len(w) > 0)
SELECT doc_id, window_no, md5(array_to_string(list_slice(w, window_no * 320 + 1, window_no * 320 + 400), ' ')) AS hash FROM s""")
def token_windows(spark, d):
    return grounding.windows(docs_of(spark, d), "doc_id", "text").select("doc_id", F.col("window_no").cast("long").alias("window_no"), F.md5(F.array_join("window", " ")).alias("hash"))


@query(f"""WITH {_CLAIMS}, o AS (SELECT conv_id, turn, c.claim, a.context, round(len(list_intersect(list_distinct({WORDS.format("claim")}), {WORDS.format("context")})) / greatest(len(list_distinct({WORDS.format("claim")})), 1), 6) AS s FROM c JOIN a USING (conv_id, turn)),
p AS (SELECT conv_id, turn, count(*) AS claims, count(*) FILTER (s <= 0.1) AS unsupported, count(*) FILTER (s > 0.1 AND s < 0.35) AS weak FROM o GROUP BY ALL),
r AS (SELECT conv_id, turn, text, context, coalesce(claims, 0) AS claims, coalesce(unsupported, 0) AS unsupported, coalesce(weak, 0) AS weak FROM a LEFT JOIN p USING (conv_id, turn))
SELECT conv_id, turn, claims, unsupported, weak, CASE WHEN length(text) < 150 AND ({" OR ".join(f"contains(lower(text), '{x.replace(chr(39), chr(39) * 2)}')" for x in grounding.REFUSALS)}) THEN 'PASS' WHEN trim(context) = '' THEN 'FAIL' WHEN claims = 0 THEN 'PASS'
WHEN unsupported / greatest(claims, 1) > 0.5 THEN 'FAIL' WHEN unsupported + weak > 0 THEN 'PARTIAL' ELSE 'PASS' END AS verdict FROM r""")
def grounding_verdict(spark, d):
    return grounding.verdicts(answers_of(spark, d), "key", "text", "context").select("key.conv_id", "key.turn", "claims", "unsupported", "weak", "verdict")


@query("""SELECT conv_id, turn, contains(lower(text), 'the') OR contains(lower(text), 'may') AS hedged, contains(lower(text), 'always') OR contains(lower(text), 'tion') AS sure FROM conversations""")
def ambiguity_flags(spark, d):
    return evaluation.flags(table(spark, d, "conversations"), ["conv_id", "turn"], {"hedged": ["the", "may"], "sure": ["always", "tion"]})


_TOPIC = "CASE WHEN contains(lower(text), 'thing') THEN 'thing' WHEN contains(lower(text), 'ation') THEN 'ation' END"


@query(f"""WITH t AS (SELECT conv_id, turn, last_value({_TOPIC} IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS topic FROM conversations)
SELECT conv_id, turn, topic, coalesce(lag(topic) OVER (PARTITION BY conv_id ORDER BY turn) <> topic, false) AS drift FROM t""")
def topic_drift(spark, d):
    t = F.lower("text")
    return sessions.topic_drift(table(spark, d, "conversations"), F.when(F.contains(t, F.lit("thing")), "thing").when(F.contains(t, F.lit("ation")), "ation"))


def turn_entities(spark, d):
    e = F.array_sort(F.collect_list(F.struct("type", F.col("name").alias("value"), "confidence")))
    return entities_of(spark, d).groupBy("conv_id", "turn").agg(e.alias("entities"))


@query()
def session_fold(spark, d):
    return sessions.fold(turn_entities(spark, d))


def observations(spark, d):
    room = F.when(F.col("event_id") % 3 == 0, "hall").when(F.col("event_id") % 3 == 1, "study")
    kind = F.when(F.col("event_type") == "click", "condition").otherwise("symptom")
    return table(spark, d, "events").select(F.col("user_id").alias("subject"), room.alias("room"), kind.alias("type"), F.col("event_type").alias("word"), (F.col("event_id") % 4).cast("string").alias("value"), ((F.col("event_id") % 90 + 10) / 100.0).alias("confidence"), F.col("event_id").alias("ord"), "ts")


_OBS = """o AS (SELECT user_id AS subject, CASE event_id % 3 WHEN 0 THEN 'hall' WHEN 1 THEN 'study' END AS room, CASE WHEN event_type = 'click' THEN 'condition' ELSE 'symptom' END AS type, event_type AS word,
(event_id % 4)::VARCHAR AS value, (event_id % 90 + 10) / 100.0::DOUBLE AS confidence, event_id AS ord, ts FROM events)"""


@query(f"""WITH RECURSIVE {_OBS}, s AS (SELECT *, CASE WHEN type = 'condition' AND room IS NOT NULL THEN '' ELSE value END AS slot FROM o),
n AS (SELECT *, CASE WHEN lag(value) OVER (PARTITION BY subject, room, type, slot ORDER BY ord) IS NOT DISTINCT FROM value THEN 0 ELSE 1 END AS new FROM s),
r AS (SELECT *, sum(new) OVER (PARTITION BY subject, room, type, slot ORDER BY ord) AS run FROM n),
k AS (SELECT subject, room, type, slot, run, value, list(confidence ORDER BY ord) AS cs, min(ord) AS first_ord, max(ord) AS last_ord FROM r GROUP BY ALL),
f AS (SELECT first_ord AS id, cs, 1 AS i, greatest(least(cs[1], 1), 0.05)::DOUBLE AS c, 1 AS n FROM k
    UNION ALL SELECT id, cs, i + 1, greatest(least((1 - CASE WHEN n < 3 THEN 0.35 ELSE 0.2 END) * c + CASE WHEN n < 3 THEN 0.35 ELSE 0.2 END * cs[i + 1], 1), 0.05)::DOUBLE, least(n + 1, 12) FROM f WHERE i < len(cs)),
e AS (SELECT id, c, n FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY i DESC) = 1)
SELECT subject, room, type, value, round(c, 6) AS confidence, n::BIGINT AS evidence, first_ord, last_ord, coalesce(lead(first_ord) OVER (PARTITION BY subject, room, type, slot ORDER BY run), -1) AS superseded_by FROM k JOIN e ON id = first_ord""")
def memory_upsert(spark, d):
    return memory.upsert(observations(spark, d))


_MEM = f"{_OBS}, rc AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY ts DESC, ord DESC) AS age_rank FROM o)"


@query(f"""WITH {_MEM}, sc AS (SELECT subject, ord, ts, round(0.55 * confidence + 0.25 / (1 + greatest((epoch_us(TIMESTAMP '2030-01-01') - epoch_us(ts)) / 3.6e9, 0) / 72.0) + 0.2 * least((ord % 6) / 5.0, 1), 6) AS score FROM rc WHERE age_rank <= 64)
SELECT subject, ord, score, row_number() OVER (PARTITION BY subject ORDER BY score DESC, ts DESC, ord DESC) AS rank FROM sc QUALIFY rank <= 8""")
def memory_fetch_topk(spark, d):
    m = observations(spark, d).withColumn("evidence", F.col("ord") % 6)
    return memory.fetch(m, F.to_timestamp(F.lit("2030-01-01"))).select("subject", "ord", "score", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_MEM}, f AS (SELECT subject, type, value, min(age_rank) AS r FROM rc WHERE age_rank <= 12 GROUP BY ALL)
SELECT subject, type, string_agg(value, ',' ORDER BY r) AS distinct_values, count(*) AS n FROM f GROUP BY ALL""")
def patient_summary(spark, d):
    return memory.summary(observations(spark, d))


@query(f"""WITH {_OBS} SELECT DISTINCT subject, CASE word WHEN 'click' THEN 'clicked' WHEN 'view' THEN 'viewed' WHEN 'purchase' THEN 'bought' ELSE 'has' END AS predicate, value AS object FROM o
UNION SELECT DISTINCT subject, 'in_room', room FROM o WHERE room IS NOT NULL""")
def kg_triples(spark, d):
    return memory.triples(observations(spark, d).withColumn("type", F.col("word")))


@query()
def rouge_l(spark, d):
    """ROUGE-L of each assistant turn against the text before it."""
    own = answers_of(spark, d)
    return own.select("key.conv_id", "key.turn", M.rouge_l(F.col("text"), F.col("context")).alias("rouge_l"))


@query("""WITH k AS (SELECT conv_id, turn, len(list_filter(['the', 'of', 'zz'], lambda k: contains(lower(text), k))) / 3 AS c, text FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, round(c::DOUBLE, 4) AS coverage FROM k""")
def keyword_coverage(spark, d):
    own = table(spark, d, "conversations").where("role = 'assistant'")
    return evaluation.keyword_coverage(own, ["conv_id", "turn"], "text", F.array(*[F.lit(k) for k in ("the", "of", "zz")]))


@query(r"""SELECT conv_id, turn, regexp_matches(text, '(?i)\bA\b') OR contains(lower(text), 'thing') AS correct FROM conversations WHERE role = 'assistant'""")
def mcq_loose(spark, d):
    return table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", M.mcq_loose(F.col("text"), F.lit("A"), F.lit("thing")).alias("correct"))


# Generic relational checks and streams


@query("""SELECT n_name, o_orderpriority, count(*) AS n, sum(round(l_extendedprice * (1 - l_discount) * 100)::BIGINT)::BIGINT AS cents FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey WHERE l_returnflag = 'R' GROUP BY ALL""")
def revenue_by_nation(spark, d):
    li = table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("long").alias("r"))
    o, c, n = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "nation")
    own = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return own.groupBy("n_name", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("cents"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    from ..streaming.turns import event_windows as windows

    return windows(table(spark, d, "events"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, sid""")
def event_sessions(spark, d):
    from ..streaming.turns import sessions as own

    return own(table(spark, d, "events"))

from . import clinical, evidence, runs, turns  # noqa: E402,F401  register their queries
