"""Format-preserving pseudonyms for personal data.

Validated values (cards by Luhn, IBANs by mod 97, social security numbers, telephone numbers, IPv4 addresses, dates of the
calendar, e-mail addresses, access keys and labelled passwords) are permuted by a keyed Feistel network within their format:
equal values give equal pseudonyms in all documents, different values of a format different ones, and a pseudonym passes the same
validation.  Formatting (spaces, dashes, brackets) is laid over the permuted value again, so two spellings of one number
stay linked.  Dates keep their separators, widths and the order of day and month, and years of 1900 to 2099 stay among
themselves.  Decimal digits of any script are read as 0 to 9, so a number is linked with its spelling in another script; its
pseudonym has the digits of the script that stood there.  Of e-mail addresses the local part changes (letters and digits of any script,
each within its block of Unicode and its category), the domain stays in clear.  Every text is searched that holds what all patterns need:
a digit, an ``@`` or a key word.  A permutation may map a value to itself, by chance once in as many values as the format has.
The key is the caller's: whoever has it can undo the pseudonyms.

``pseudonymize`` keeps every row and column, replaces the text column and adds ``pii`` (kind, place in the new text,
original length) and ``n_pii``; added columns replace those of the same name.  Null texts stay null with no findings, empty
texts stay empty, long texts are scanned whole, repeated rows are treated alike, an empty table gives an empty one.
"""

from __future__ import annotations

import functools
import hashlib
import re
import secrets
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import text_batches

ROUNDS = 8
DIGITS, HEX = "0123456789", "0123456789abcdef"
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def feistel(value: int, left: int, right: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of ``range(left * right)``: alternating modular additions of a keyed function."""
    a, b = divmod(value, right)
    for r in range(ROUNDS):
        other = b if r % 2 == 0 else a
        f = int.from_bytes(hashlib.blake2b(f"{tweak}|{r}|{left}|{right}|{other}".encode(), key=key, digest_size=24).digest(), "big")
        if r % 2 == 0:
            a = (a + f) % left
        else:
            b = (b + f) % right
    return a * right + b


@functools.cache
def block_of(c: str) -> str | None:
    """All characters of a letter's or digit's block of 256 code points and category; null for other characters."""
    if not c.isalnum():
        return None
    start, kind = ord(c) & ~255, unicodedata.category(c)
    return "".join(x for x in map(chr, range(start, start + 256)) if x.isalnum() and unicodedata.category(x) == kind)


def permute(chars: str, key: bytes, tweak: str, alphabets: tuple[str, ...] = (DIGITS, LOWER, UPPER), other: Callable[[str], str | None] = lambda c: None) -> str:
    """Permute a string within its character classes; characters of no class, nor of one that ``other`` gives, stay."""
    own = [next((a for a in alphabets if c in a), None) or other(c) for c in chars]
    value, sizes = 0, [len(a) for a in own if a]
    for c, a in zip(chars, own, strict=True):
        if a:
            value = value * len(a) + a.index(c)
    half, left, right = len(sizes) // 2, 1, 1
    for s in sizes[:half]:
        left *= s
    for s in sizes[half:]:
        right *= s
    # a single class position has no left half: it is added to
    value = feistel(value, left, right, key, f"{tweak}|{''.join(str(s) + ',' for s in sizes)}") if sizes else 0
    out = []
    for c, a in zip(reversed(chars), reversed(own), strict=True):
        if a:
            value, i = divmod(value, len(a))
            c = a[i]
        out.append(c)
    return "".join(reversed(out))


def walk(chars: str, key: bytes, tweak: str, valid: Callable[[str], bool], **kw) -> str:
    """Permute until the value is valid again (cycle walking), which stays a permutation of the valid values."""
    chars = permute(chars, key, tweak, **kw)
    while not valid(chars):
        chars = permute(chars, key, tweak, **kw)
    return chars


def lay(original: str, plain: str) -> str:
    """``plain`` in the punctuation of ``original``."""
    it = iter(plain)
    return "".join(next(it) if c.isalnum() else c for c in original)


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def _card(m: str, key: bytes) -> str | None:
    d = re.sub(r"[^0-9]", "", m)
    if not 13 <= len(d) <= 19 or not luhn(d) or len(set(d)) == 1:
        return None
    new = d[0] + permute(d[1:-1], key, f"card{d[0]}")
    return lay(m, new + next(c for c in DIGITS if luhn(new + c)))


def _ip(m: str, key: bytes) -> str | None:
    parts = m.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    v = feistel(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 16, 1 << 16, key, "ip")
    return ".".join(map(str, v.to_bytes(4, "big")))


def _phone(m: str, key: bytes) -> str | None:
    d = re.sub(r"[^0-9]", "", m)
    if not 10 <= len(d) <= 15:
        return None
    keep = len(d) - 10 if m.startswith("+") else 0
    return lay(m.replace("+", ""), d[:keep] + permute(d[keep:], key, "phone")) if not m.startswith("+") else "+" + lay(m[1:], d[:keep] + permute(d[keep:], key, "phone"))


def _ssn_ok(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _ssn(m: str, key: bytes) -> str | None:
    d = m.replace("-", "")
    return lay(m, walk(d, key, "ssn", _ssn_ok)) if _ssn_ok(d) else None


def _mod97(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s)) % 97


def _iban(m: str, key: bytes) -> str | None:
    s = m.replace(" ", "")
    if not 15 <= len(s) <= 34 or _mod97(s[4:] + s[:4]) != 1:
        return None
    body = permute(s[4:], key, f"iban{s[:2]}")
    return lay(m, f"{s[:2]}{98 - _mod97(body + s[:2] + '00'):02d}{body}")


#: Years whose dates are permuted among themselves, so that common dates stay plausible; all others form the second band.
NEAR = range(1900, 2100)


@functools.cache
def _days(order: str, wide: tuple[int, int]) -> tuple[tuple[int, int], ...]:
    """Pairs of the first and second short field of these widths that a calendar has under an order: ``md``, ``dm`` (no ``md``) or ``both``."""
    fits = lambda m, d: 1 <= m <= 12 and 1 <= d <= (31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[m - 1]
    values = [range(1, 10) if w == 1 else range(1, 32) for w in wide]
    kind = {(True, True): "both", (True, False): "md", (False, True): "dm"}
    return tuple((a, b) for a in values[0] for b in values[1] if kind.get((fits(a, b), fits(b, a))) == order)


def _date(m: str, key: bytes) -> str | None:
    parts = re.split(r"[-/.]", m)
    year_first = len(parts[0]) == 4
    year, one, two = parts if year_first else (parts[2], parts[0], parts[1])
    wide, pair, y = (len(one), len(two)), (int(one), int(two)), int(year)
    order = next((o for o in ("md", "dm", "both") if pair in _days(o, wide)), None)
    if year_first and order == "both":
        days = tuple(sorted(_days("md", wide) + _days("both", wide)))
    elif order is None or (year_first and order == "dm"):
        return None
    else:
        days = tuple(sorted(_days("md", wide) + _days("both", wide))) if year_first else _days(order, wide)
    leap = lambda y: y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)
    ok = lambda p, y: leap(y) or p not in ((2, 29), (29, 2))
    if not y or not ok(pair, y):
        return None
    near = y in NEAR
    years = len(NEAR) if near else 9999 - len(NEAR)
    at = y - NEAR[0] if near else (y - 1 if y < NEAR[0] else y - 1 - len(NEAR))
    value = days.index(pair) * years + at
    while True:
        value = feistel(value, len(days), years, key, f"date{year_first}{order if not year_first else ''}{wide}{near}")
        i, at = divmod(value, years)
        y = at + NEAR[0] if near else (at + 1 if at + 1 < NEAR[0] else at + 1 + len(NEAR))
        if ok(days[i], y):
            break
    short = [f"{v:0{w}d}" for v, w in zip(days[i], wide, strict=True)]
    seps = re.findall(r"[-/.]", m)
    out = [f"{y:04d}", *short] if year_first else [*short, f"{y:04d}"]
    return out[0] + seps[0] + out[1] + seps[1] + out[2]


def _email(m: str, key: bytes) -> str | None:
    local, _, domain = m.rpartition("@")
    return f"{permute(local, key, 'mail' + domain.lower(), other=block_of)}@{domain}"


def _key(m: str, key: bytes) -> str | None:
    return m[:4] + permute(m[4:], key, "key", (DIGITS + UPPER,))


def _secret(m: str, key: bytes) -> str | None:
    head = re.match(r"(?i)\w+\s*[:=]\s*[\"']?", m)[0]
    body = m[len(head) :]
    return head + (permute(body, key, "secret", (HEX,)) if re.fullmatch(r"[0-9a-f]+", body) else permute(body, key, "secret"))


#: Kinds in the order in which they are tried at a place.
KINDS: tuple[tuple[str, str, Callable[[str, bytes], str | None]], ...] = (
    ("secret", r"(?i:\b(?:password|passwd|pwd|token|api_key|apikey|secret)\s{0,2}[:=]\s{0,2}[\"']?)[A-Za-z0-9+/_\-]{8,}", _secret),
    ("key", r"\bA[KS]IA[0-9A-Z]{16}\b", _key),
    ("email", r"(?<![\w.%+\-])\w[\w.%+\-]{0,63}@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}", _email),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", _iban),
    ("ip", r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9])", _ip),
    ("date", r"(?<![\w./\-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{1,2}[/.][0-9]{1,2}[/.][0-9]{4}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4})(?=T[0-9]{2}:|(?![\w/]|[.\-][0-9]))", _date),
    ("ssn", r"(?<![\w\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w\-])", _ssn),
    ("card", r"(?<![\w.+\-])[0-9](?:[ \-]?[0-9]){12,18}(?![\w\-])", _card),
    ("phone", r"(?<![\w.])(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{3}\)|\b[0-9]{3})[ .\-]?[0-9]{3}[ .\-][0-9]{4}(?!\w|[\-.][0-9])|(?<![\w.])\+[0-9]{10,15}(?!\w)", _phone),
)
PATTERNS = [(k, re.compile(p), f) for k, p, f in KINDS]
#: What each of the patterns needs at least: a text without any of these holds nothing of the kinds above.
HINT = re.compile(r"[0-9@]|A[KS]IA|(?i:passw|pwd|token|api_?key|secret)")
#: Decimal digits of other scripts than 0-9.
OTHER_DIGIT = re.compile(r"(?![0-9])\d")


#: Lengths of IBANs by country.
_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN_LENGTHS = {country: n for n, names in _LENGTHS.items() for country in names.split()}


def shorter(kind: str, m: str) -> Iterator[str]:
    """Starts of a match that may be the value where the whole isn't, longest first: they end at the bounds of its groups."""
    if kind == "card":
        yield from (m[:i] for i in range(len(m) - 1, 12, -1) if not m[i].isdigit())
    elif kind == "iban":
        ends = [i for i in range(len(m) - 1, 14, -1) if m[i] == " "]
        full = IBAN_LENGTHS.get(m[:2])
        # a known country's length says where the value ends
        yield from (m[:i] for i in ends if full is None or i - m[:i].count(" ") == full)


def matches(text: str, kind: str, pattern: re.Pattern, make: Callable[[str, bytes], str | None], key: bytes) -> Iterator[tuple[int, int, str, str]]:
    """Start, end, kind and pseudonym of a kind's values; the search goes on after the value taken."""
    if kind not in ("card", "iban"):
        for m in pattern.finditer(text):
            new = make(m[0], key)
            if new is not None:
                yield m.start(), m.end(), kind, new
        return
    m = pattern.search(text)
    while m:
        at = None
        for own in (m[0], *shorter(kind, m[0])):
            new = make(own, key)
            if new is not None:
                at = m.start() + len(own)
                yield m.start(), at, kind, new
                break
        if at is None:
            # a value may begin at a later group of the match
            at = m.start() + min((i for i in (m[0].find(c) for c in " -") if i > 0), default=len(m[0]))
        m = pattern.search(text, at)


def in_script(was: str, new: str) -> str:
    """``new`` with its digits in the scripts of the digits of ``was``, in order; further ones in that of the last."""
    zeros = [ord(c) - unicodedata.decimal(c) for c in was if c.isdecimal()]
    places = iter(zeros)
    return "".join(chr(next(places, zeros[-1]) + int(c)) if c in DIGITS else c for c in new)


def find(text: str, key: bytes) -> list[tuple[int, int, str, str]]:
    """Start, end, kind and pseudonym of each value; earlier kinds win where two overlap."""
    own = text if not text or text.isascii() else OTHER_DIGIT.sub(lambda m: str(unicodedata.decimal(m[0])), text)
    if not own or not HINT.search(own):
        return []
    found: list[tuple[int, int, str, str]] = []
    for kind, pattern, make in PATTERNS:
        if kind == "email" and "@" not in own:
            continue
        found += matches(own, kind, pattern, make, key)
    if own is not text and own != text:
        found = [(a, b, kind, in_script(text[a:b], new) if own[a:b] != text[a:b] else new) for a, b, kind, new in found]
    rank = {k: i for i, (k, _, _) in enumerate(KINDS)}
    found.sort(key=lambda x: (rank[x[2]], x[0]))
    taken, covered = [], bytearray(len(text))
    for x in found:
        if covered.find(1, x[0], x[1]) < 0:
            covered[x[0] : x[1]] = b"\x01" * (x[1] - x[0])
            taken.append(x)
    return sorted(taken)


def rewrite(text: str, key: bytes) -> tuple[str, list[dict]]:
    out, at, spans, size = [], 0, [], 0
    for start, end, kind, new in find(text, key):
        out += [text[at:start], new]
        size += start - at
        spans.append({"kind": kind, "start": size, "end": size + len(new), "was_length": end - start})
        size += len(new)
        at = end
    return "".join([*out, text[at:]]) if spans else text, spans


@functools.cache
def _own_key() -> str:
    return secrets.token_hex(32)


def session_key(spark: SparkSession) -> str:
    """``spark.corpusflow.pii.key``; where it is unset, a random key that lives as long as the driver."""
    return spark.conf.get("spark.corpusflow.pii.key", None) or _own_key()


def pseudonymize(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in the text column, and ``pii`` and ``n_pii``."""
    if not key:
        raise ValueError("a key is needed")
    text_batches(docs.sparkSession)
    secret = hashlib.sha256(key.encode()).digest()
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("was_length", pa.int32())]))

    @F.arrow_udf("struct<text:string,pii:array<struct<kind:string,start:int,end:int,was_length:int>>>")
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            pairs = [(None, []) if t is None else rewrite(t, secret) for t in batch.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], spans)], ["text", "pii"])

    rows = docs.select(F.struct(*docs.columns).alias("row"), apply(F.col(text)).alias("new"))
    own = [(F.col("new.text") if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns if c not in ("pii", "n_pii")]
    return rows.select(*own, F.col("new.pii").alias("pii"), F.size("new.pii").cast("long").alias("n_pii"))
