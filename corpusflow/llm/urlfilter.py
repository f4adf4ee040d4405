"""Filter of URLs by host rules and by a weighted vocabulary that Aho-Corasick counts.

A vocabulary gives terms weights, in hundredths: 100 and more is strict, less is soft.  ``judge`` keeps every row and every column
of its input and adds ``host``, ``path``, ``rule``, ``n_strict``, ``n_soft``, ``soft_weight`` and ``verdict``.  The longest
fitting rule decides; where none fits, one strict term rejects, or distinct soft terms (two at least) whose weights reach 100.  A
term counts where it stands between boundaries: the ends of the URL or characters other than a-z and 0-9.  Null and empty URLs
have an empty host and path, no rule, and verdict ``allow``; URLs of any length are read whole; repeated rows are judged alike;
an added column replaces one of its name.  ``vocabulary`` reads terms from a table or file that Spark reads.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules in the form (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Terms by weight.  One strict term rejects; of the soft ones, two telling or three weak ones.
STRICT = tuple(
    "porn porno pornstar xxx hentai escort escorts camgirl camgirls camsex milf nsfw onlyfans redtube bdsm fetish hardcore-sex sexcam sexchat sextube nudes warez keygen keygens serialz crackz "
    "nulled phishing malware ransomware spyware botnet carding fullz cvv-shop darkmarket fake-id fakeid".split()
)
TELLING = tuple(
    "casino casinos poker blackjack roulette baccarat slots slot-machine betting bet bets bookmaker sportsbook jackpot lottery loan loans payday payday-loan viagra cialis levitra kamagra xanax "
    "tramadol pharmacy adult adults sex sexy dating hookup singles nude naked erotic lingerie torrent torrents crack cracked serial-key activator rapidshare megaupload replica replicas counterfeit "
    "essay-writing backlinks seo-services forex binary-options crypto-doubler giveaway miracle weight-loss".split()
)
WEAK = tuple("cheap discount coupon coupons promo deals free-download download clickbait popup redirect affiliate tracking utm_source feed proxy mirror sponsored win prize bonus".split())
VOCABULARY = tuple((t, w) for terms, w in ((STRICT, 100), (TELLING, 50), (WEAK, 34)) for t in terms)


def vocabulary(terms: DataFrame, most: int = 1_000_000) -> tuple[tuple[str, int], ...]:
    """A vocabulary from a table of ``term`` and ``weight`` (of repeated terms the heaviest); it goes to all tasks, so a larger
    one than ``most`` terms is refused."""
    own = terms.where("length(term) > 0 and weight > 0").groupBy(F.translate("term", UPPER, LOW).alias("term")).agg(F.max("weight").cast("int").alias("weight"))
    rows = own.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} terms")
    return tuple(sorted((r.term, r.weight) for r in rows))


def automaton(terms: Sequence[tuple[str, int]]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for t, weight in terms:
        a.add_word(t, (t, weight))
    if len(a):
        a.make_automaton()
    return a


def count_terms(url: str | None, a: ahocorasick.Automaton) -> tuple[int, int, int]:
    """Distinct strict and distinct soft terms of a URL that stand between boundaries, and the weight of the soft ones."""
    if not url or not len(a):
        return 0, 0, 0
    hits: dict[str, int] = {}
    for end, (term, weight) in a.iter(url):
        start = end + 1 - len(term)
        before, after = url[start - 1 : start] if start else "", url[end + 1 : end + 2]
        if not (before.isascii() and before.isalnum()) and not (after.isascii() and after.isalnum()):
            hits[term] = weight
    soft = [w for w in hits.values() if w < 100]
    return len(hits) - len(soft), len(soft), sum(soft)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOW)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The text and the verdict of the longest rule that fits; null where none does."""
    text = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, kind).otherwise(verdict)
    return text, verdict


def judge(pages: DataFrame, url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, terms: Sequence[tuple[str, int]] = VOCABULARY) -> DataFrame:
    """Every row of ``pages`` with its host, path, rule, counts of terms and verdict."""
    sent = pages.sparkSession.sparkContext.broadcast(tuple(terms))

    @F.pandas_udf("strict bigint, soft bigint, weight bigint")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        a = automaton(sent.value)
        for urls in batches:
            yield pd.DataFrame([count_terms(u, a) for u in urls], columns=["strict", "soft", "weight"], dtype="int64")

    parts = F.struct(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), counted(F.translate(F.col(url), UPPER, LOW)).alias("terms"))
    text, own = rule_of(F.col("own.host"), F.col("own.path"), rules)
    hits = {"n_strict": "strict", "n_soft": "soft", "soft_weight": "weight"}
    rejected = (F.col("own.terms.strict") >= 1) | ((F.col("own.terms.soft") >= 2) & (F.col("own.terms.weight") >= 100))
    added = {
        "host": F.col("own.host"),
        "path": F.col("own.path"),
        "rule": text,
        **{name: F.col(f"own.terms.{field}") for name, field in hits.items()},
        "verdict": F.coalesce(own, F.when(rejected, "block").otherwise("allow")),
    }
    kept = [F.col("row").getField(c).alias(c) for c in pages.columns if c not in added]
    return pages.select(F.struct(*pages.columns).alias("row"), parts.alias("own")).select(*kept, *[c.alias(n) for n, c in added.items()])


def oracle() -> str:
    """The same judgement in DuckDB's SQL, for the default rules and terms."""
    hit = lambda t: f"regexp_matches(u, '(^|[^a-z0-9]){t}($|[^a-z0-9])')::INT"
    total = lambda terms: "(" + " + ".join(map(hit, terms)) + ")::BIGINT"
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    return f"""
    WITH a AS (SELECT page_id, translate(coalesce(url, ''), '{UPPER}', '{LOW}') AS u,
        translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOW}') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    b AS (SELECT page_id, host, path, {total(STRICT)} AS n_strict, {total(TELLING)} AS n_telling, {total(WEAK)} AS n_weak,
        CASE {" ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in rules)} END AS rule,
        CASE {" ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in rules)} END AS v FROM a)
    SELECT page_id, host, path, rule, n_strict, n_telling + n_weak AS n_soft, 50 * n_telling + 34 * n_weak AS soft_weight,
        coalesce(v, CASE WHEN n_strict >= 1 OR (n_telling + n_weak >= 2 AND 50 * n_telling + 34 * n_weak >= 100) THEN 'block' ELSE 'allow' END) AS verdict FROM b"""
