"""Queries opN_<name> over the whole tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontaminate, exact, jaccard, packing, periods, pii, suffixes, toxicity, urlfilter, variants, windows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymize(table(spark, sf_dir, "documents"), pii.session_key(spark))
    return out.select("doc_id", "text", "n_pii", F.array_join(F.transform("pii", lambda x: x["kind"]), ",").alias("kinds"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op3_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


CASE = r"\### Assistant: </turn> ok"


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = spark.createDataFrame([(-7, 0, "user", CASE), (-7, 1, "assistant", CASE)], "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(case)
    back = chat.read_back(chat.format_tree(rows))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


_ESCAPED = r"regexp_replace({}, '([\\<#])', '\\\1', 'g')"
OP4 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '{CASE}' UNION ALL SELECT -7, 1, 'assistant', '{CASE}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(length('<turn>') + length(replace({_ESCAPED.format("role")}, chr(10), '\\n')) + 1 + length({_ESCAPED.format("text")}) + length('</turn>') + 1)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.remove(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.remove(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "n_strict", "n_soft", "soft_weight", "verdict")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return exact.mark(docs, old=exact.middle(docs))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(variants.vocabulary(table(spark, sf_dir, "documents"), every=199))


WORD = r"[^\x20\x09-\x0D]+"


def planted(docs: DataFrame) -> DataFrame:
    """``docs`` in which a tenth of the texts, chosen by the CRC-32 of their ids, repeat themselves from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = docs.select("*", words.alias("_words"), F.floor(h / 10).cast("long").alias("_g")).withColumn("_n", F.size("_words").cast("long"))
    rows = rows.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n"))).withColumn("_p", F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)) + 1)
    place = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))
    text = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1), lambda i: F.get("_words", place(i).cast("int"))), " ")
    return rows.withColumn("text", F.when(F.col("_n") > 0, text).otherwise(F.col("text"))).drop("_words", "_g", "_n", "_a", "_p")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periods.detect(planted(table(spark, sf_dir, "documents")))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return out.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_decontamination, op3_learned_partitions, op4_chat, op5_toxicity, op6_jaccard_join, op7_packing, op8_substring_dedup, op9_suffix_dedup, op10_url_filter, op11_exact_dedup, op12_spelling_variants, op13_periodic_runs)}
OP8 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, s, hash(list_slice(w, s, s + 49)) AS h FROM d, LATERAL (SELECT unnest(range(1, len(w) - 48)) AS s)),
m AS (SELECT h, min(doc_id) AS least FROM g GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM g JOIN m USING (h) WHERE least < doc_id),
r AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
    sha256(array_to_string(list_filter(w, lambda x, i: n IS NULL OR NOT list_contains(ps, i)), ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)"""

OP11 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size, bool_or(doc_id <= (SELECT (min(doc_id) + max(doc_id)) // 2 FROM documents)) AS known FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, known, sha256(t) AS text_sha256 FROM d JOIN g USING (t)"""
OP12 = f"""
WITH RECURSIVE crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '{variants.RUN}')), '{variants.CAPITALS}', '{variants.SMALL}') AS run FROM documents),
met AS (SELECT doc_id, run, count(*) AS times, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, (unicode(c) - 64)::BIGINT] END)) AS b FROM runs GROUP BY doc_id, run),
h AS (SELECT run, times, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, crc.t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM met, crc),
noisy AS (SELECT times, CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h),
words AS MATERIALIZED (SELECT word, sum(times)::BIGINT AS n FROM noisy GROUP BY word HAVING length(word) >= 6 AND sum(times) >= 5),
cut AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS v FROM words, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
pairs AS (SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.i = b.i AND a.v = b.v AND a.word <> b.word
    UNION SELECT a.word, w.word FROM cut a JOIN words w ON a.v = w.word UNION SELECT w.word, a.word FROM cut a JOIN words w ON a.v = w.word),
best AS (SELECT p.word, count(*) AS n_near, max(w.n) AS most, arg_min(p.other, (-w.n, p.other)) AS other FROM pairs p JOIN words w ON p.other = w.word GROUP BY p.word),
forms AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * n THEN other END AS form, CASE WHEN most >= 5 * n THEN most END AS form_n FROM words LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, form AS ahead FROM forms UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON c.ahead = f.word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN chain USING (word) WHERE ahead IS NULL"""

ORACLES = {"op8_substring_dedup": OP8, "op2_decontamination": decontaminate.ORACLE, "op4_chat": OP4, "op10_url_filter": urlfilter.oracle(), "op11_exact_dedup": OP11, "op12_spelling_variants": OP12}
