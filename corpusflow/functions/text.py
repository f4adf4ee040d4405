"""Text cleaning as column expressions."""

from __future__ import annotations

import re
from html.entities import name2codepoint

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NAMED = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}
#: What browsers read numbers from 128 to 159 as, where Windows-1252 has a character.
C1 = {n: t for n in range(0x80, 0xA0) if (t := bytes([n]).decode("cp1252", "ignore"))}
#: Closing tags that end a line.
LINE_TAGS = ("p", "div", "li", "ul", "ol", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table")


def unescape(c: Column) -> Column:
    """Entities of HTML decoded once: the named ones of HTML 4 and ``&apos;``, decimal and hexadecimal ones; each needs its semicolon.

    Numbers of the C1 range are read as Windows-1252, as browsers do; what is no character becomes U+FFFD. Unknown names stay. The no-break
    space becomes a blank.
    """
    names = F.create_map(*[F.lit(x) for kv in NAMED.items() for x in kv])
    windows = F.create_map(*[F.lit(x) for kv in C1.items() for x in kv])

    def once(value: Column, body) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def decoded(piece: Column) -> Column:
        return once(F.regexp_extract(piece, r"^(#[xX][0-9a-fA-F]+|#[0-9]+|[a-zA-Z][a-zA-Z0-9]*);", 1), lambda head: replaced(piece, head))

    def replaced(piece: Column, head: Column) -> Column:
        text = F.when(head.startswith("#"), once(number(head, F.regexp_replace(head, r"^#[xX]?0*", "")), char)).otherwise(F.try_element_at(names, head))
        return F.coalesce(F.concat(F.replace(text, F.lit("\u00a0"), F.lit(" ")), F.substr(piece, F.length(head) + 2)), F.concat(F.lit("&"), piece))

    def char(code: Column) -> Column:
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(~valid, "\ufffd").otherwise(F.coalesce(F.try_element_at(windows, code), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")))

    def number(head: Column, digits: Column) -> Column:
        own = F.when(digits == "", "0").otherwise(digits)
        read = F.when(head.rlike("^#[xX]"), F.conv(own, 16, 10)).otherwise(own).try_cast("long")
        return F.when(F.length(digits) > 8, -1).otherwise(read)  # more digits are no character

    # the text stands here once, so that what made it is not computed again for each use
    return F.array_join(F.transform(F.split(c, "&", -1), lambda x, i: F.when(i == 0, x).otherwise(decoded(x))), "")


def clean_text(c: Column) -> Column:
    """Entities, no-break spaces, line ends, tabs; at most one blank line and single blanks."""
    c = F.regexp_replace(F.regexp_replace(unescape(c), " ", " "), r"\r\n?", "\n")
    c = F.regexp_replace(F.regexp_replace(c, r"\t", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(c, r" {2,}", " "), r"^\s+|\s+$", "")


def normalize_for_hash(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", " "), r"\s+", " "))


def content_hash(c: Column) -> Column:
    return F.sha2(normalize_for_hash(c), 256)


def strip_html(c: Column) -> Column:
    """Visible text of a page."""
    c = F.regexp_replace(c, r"(?is)<script[^>]*>.*?</script>", " ")
    c = F.regexp_replace(c, r"(?is)<style[^>]*>.*?</style>", " ")
    c = F.regexp_replace(c, r"(?is)<noscript[^>]*>.*?</noscript>", " ")
    c = F.regexp_replace(c, rf"(?i)<br\s*/?>|</({'|'.join(LINE_TAGS)})>", "\n")
    c = F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]+>", " "), r"[ \t]+", " ")
    return clean_text(F.regexp_replace(c, r" *\n *", "\n"))


def extract_title(html: Column, fallback: Column) -> Column:
    t = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    t = F.trim(F.regexp_replace(unescape(t), r"\s+", " "))
    t = F.regexp_replace(t, r"\s[|\-]\s[^|\-]*$", "")
    return F.coalesce(F.nullif(F.trim(t), F.lit("")), fallback)


def extract_region(html: Column) -> Column:
    """The content part of a page: main, then article of some length, then body, then all."""
    part = lambda tag: F.nullif(F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), F.lit(""))
    article = part("article")
    return F.coalesce(part("main"), F.when(F.length(article) > 500, article), part("body"), html)


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.regexp_replace(F.left(c, F.lit(n - 1)), r"\s+$", ""), F.lit("\n")))


def title_from_text(c: Column) -> Column:
    first = F.element_at(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), r"(?<=[.!?])\s+", 2), 1)
    return F.when(F.length(first) > 140, F.concat(F.rtrim(F.left(first, F.lit(137))), F.lit("..."))).otherwise(first)


def clean_md(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " ")
    return F.regexp_replace(F.regexp_replace(c, r"(?m)[ \t]+$", ""), r"^\s+|\s+$", "")


def clean_article(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", ""), r"#|```", ""), r"\s+", " "))


def sanitize_heading(c: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(c, r"^[.\-:; ]+|[.\-:; ]+$", ""), F.lit("")), F.lit("Untitled"))


def strip_wikitext(c: Column) -> Column:
    """Templates (up to five within each other, innermost first), tables, files, references, links, headings and emphasis, in that order."""
    for pattern, new in (
        *[(r"(?s)\{\{[^{}]*\}\}", "")] * 5,
        (r"(?s)\{\{.*?\}\}", ""),  # deeper ones, and those with single braces
        (r"(?s)\{\|.*?\|\}", ""),
        (r"(?is)\[\[(?:File|Image):[^\]]*\]\]", ""),
        (r"(?is)<ref[^>]*/>|<ref[^>]*>.*?</ref>", ""),
        (r"\[\[[^|\]]*\|([^\]]*)\]\]", r"$1"),
        (r"\[\[([^\]]*)\]\]", r"$1"),
        (r"\[https?://\S+\s?([^\]]*)\]", r"$1"),
        (r"(?m)^=+\s*(.*?)\s*=+\s*$", r"$1"),
        (r"'{2,}", ""),
        (r"<[^>]+>", ""),
    ):
        c = F.regexp_replace(c, pattern, new)
    return clean_text(c)


def split_sentences(c: Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` and white space before an ASCII capital."""
    return F.split(F.trim(c), r"(?<=[.!?])\s+(?=[A-Z])")


def collapse_repeats(c: Column) -> Column:
    """A sentence that begins with a capital, has 26 characters or more before its mark and follows itself, or a sentence that ends in it, stands once."""

    @F.pandas_udf("string")
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(without_repeats, na_action="ignore")

    return apply(c)


def without_repeats(text: str) -> str:
    """The fix point in one pass: each sentence is compared with the last that was kept."""
    kept = [""]
    for s in re.findall(r"[^.!?]*[.!?]|[^.!?]+$", text):
        body = s.lstrip()
        if not (26 < len(body) < len(s) and "A" <= body[0] <= "Z" and body[-1] in ".!?" and kept[-1].endswith(body)):
            kept.append(s)
    return "".join(kept)


def slug(prefix: str, c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9_]+", "_"), r"^_+|_+$", "")
    return F.concat(F.lit(prefix + "_"), F.left(s, F.lit(80)))


def record_id(*parts: Column) -> Column:
    return F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(32))


def alpha_ratio(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}]", "")) / F.greatest(F.length(c), F.lit(1))


def is_noise(c: Column, least: int = 60, ratio: float = 0.4) -> Column:
    return (F.length(F.trim(c)) < least) | (alpha_ratio(c) < ratio)


def words(c: Column) -> Column:
    """Lower-cased tokens between white space."""
    return F.array_remove(F.split(F.lower(c), r"\s+"), "")


def keyword_hit(text: Column, keyword: str) -> Column:
    """A phrase or hyphenated keyword by substring, a word by its bounds."""
    if " " in keyword or "-" in keyword:
        return F.contains(F.lower(text), F.lit(keyword))
    return F.lower(text).rlike(rf"\b{keyword}\b")


def plausible_heading(c: Column, chars: int = 120, most_words: int = 18) -> Column:
    c = F.trim(c)
    marks = F.length(c) - F.length(F.translate(c, ".!?;", ""))
    return (F.length(c) > 0) & (F.length(c) <= chars) & (F.size(F.split(c, r"\s+")) <= most_words) & ~c.rlike(r"https?://") & (marks < 3) & ~c.rlike(r"[.!?]\s+[a-z]")


def strip_option(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s*[A-Z][.)]\s*", "")
