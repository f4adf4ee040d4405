"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

An item's windows are its runs of ``size`` words (the whole item where it is shorter).  A window is contained in a document
only if all of its words are, so under any global order one prefix word is a necessary match: words are ordered by how
rarely the documents hold them, each window is joined by its rarest word, and windows with a word that no document holds
are dropped.  Place and length bounds of the candidate follow from where that word stands in the window; the words of the
document over a stretch of the window's size are then compared exactly.

The windows are broadcast up to ``broadcast_rows`` of them; beyond that they are joined by a shuffle on the prefix word.

``mark`` returns one row for each row of ``docs`` with the columns listed there.  Null or empty texts have no words and no
hits; items without words have no windows; repeated rows, ids and items are kept apart; an empty benchmark marks nothing;
an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import materialize, small_side

UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: what stands between words, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words after lower-casing A-Z only; ASCII texts take the faster way."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOW))
    return F.array_remove(F.split(low, BETWEEN), "")


def windows(items: DataFrame, size: int = 10) -> DataFrame:
    """Distinct windows with the ids of the items that hold them."""
    own = items.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - (size - 1), F.lit(1))))
    own = own.select("item_id", "words", at.alias("at")).select("item_id", F.slice("words", F.col("at"), size).alias("window"))
    return own.groupBy("window").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))


def keyed(own: DataFrame, docs: DataFrame, small: bool) -> DataFrame:
    """Windows with their rarest word ``key`` and its place ``off`` (from 0) in the window."""
    hint = F.broadcast if small else (lambda x: x)
    vocabulary = own.select(F.explode("window").alias("word")).distinct()
    found = docs.select(F.explode(words_of(F.col("text"))).alias("word")).join(hint(vocabulary), "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    terms = own.select("window", F.posexplode("window").alias("off", "word")).join(hint(found), "word", "left")
    # a word that no document holds has no count
    best = terms.groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("off"), F.col("word"))).alias("best"))
    return own.join(best, "window").where(F.col("best.n") > 0).select("window", "items", F.col("best.word").alias("key"), F.col("best.off").alias("off"))


def mark(docs: DataFrame, items: DataFrame, size: int = 10, broadcast_rows: int = 500_000) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and text_hash: a document word inside any window that occurs is hit."""
    own = windows(items, size).persist()
    small = own.count() <= broadcast_rows
    keys = keyed(own, docs, small)
    row = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words"))
    tokens = F.posexplode(F.concat("words", F.array(F.lit("")))).alias("pos", "key")
    if small:
        # one token more than the text has carries the number of words, so that each document keeps a row
        end = keys.sparkSession.range(1).select(F.lit(None).cast("array<string>").alias("window"), F.lit(None).cast("array<string>").alias("items"), F.lit("").alias("key"), F.lit(0).alias("off"))
        near = row.select("row", "doc_id", "text_hash", "words", F.lit(0).alias("base"), tokens)
        found = near.join(F.broadcast(keys.unionByName(end)), "key")
    else:
        first = F.greatest(F.col("pos") - (size - 1), F.lit(0))
        near = row.select("row", "doc_id", "text_hash", "words", F.posexplode("words").alias("pos", "key")).select("row", "doc_id", "text_hash", "pos", "key", F.slice("words", first + 1, 2 * size - 1).alias("words"), first.alias("base"))
        found = near.join(keys, "key")
        # a row that meets no window carries the number of words; it is not joined, so no key gathers all documents
        none = {c: F.lit(None).cast(t) for c, t in (("words", "array<string>"), ("window", "array<string>"), ("items", "array<string>"))}
        ends = row.select("row", "doc_id", "text_hash", F.size("words").alias("pos"), F.lit("").alias("key"), F.lit(0).alias("base"), F.lit(0).alias("off")).withColumns(none)
        found = found.unionByName(ends)
    start = F.col("pos") - F.col("off")
    length = F.size("window")
    fits = (start >= F.col("base")) & (start - F.col("base") + length <= F.size("words"))
    same = F.slice("words", F.when(fits, start - F.col("base") + 1).otherwise(1), F.when(fits, length).otherwise(0)) == F.col("window")
    found = found.where((F.col("key") == "") | (fits & same))
    hit = F.when(F.col("key") != "", F.struct(start.alias("s"), (start + length).alias("e")))
    per = found.groupBy("row", "doc_id", "text_hash").agg(
        F.max(F.when(F.col("key") == "", F.col("pos"))).cast("long").alias("n_words"),
        F.array_sort(F.collect_set(hit)).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("ids"),
    )
    covered = F.aggregate(
        "hits",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, h: F.struct(F.greatest(a["end"], h["e"]).alias("end"), (a["n"] + F.greatest(h["e"] - F.greatest(h["s"], a["end"]), F.lit(0))).alias("n")),
    )["n"]
    return per.select(
        "doc_id",
        "n_words",
        covered.alias("n_hit"),
        F.size("ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        "text_hash",
    )


def clean(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """The rows of ``docs`` that hold no window of an item."""
    bad = mark(docs, items, size).where("contaminated").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    bad = small_side(materialize(bad, "contaminated"))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(docs["text"]) == bad["_hash"]), "left_anti").select(*[docs[c] for c in docs.columns])


_W = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_W} AS w FROM documents),
i AS (SELECT item_id, {_W} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, list_slice(w, s, s + 9) AS g FROM i, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s) WHERE len(w) > 0),
ls AS (SELECT DISTINCT len(g) AS l FROM iw),
dw AS (SELECT doc_id, s, l, list_slice(w, s, s + l - 1) AS g FROM d, ls, LATERAL (SELECT unnest(range(1, len(w) - l + 2)) AS s)),
hit AS (SELECT doc_id, s, l, item_id FROM dw JOIN iw USING (g)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + l)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)"""
