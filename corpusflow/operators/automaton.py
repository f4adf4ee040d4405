"""Many phrases at once: an Aho-Corasick automaton of a table of phrases, walked once over each text.

The work is one pass over the texts and one row for each phrase that a text holds, however many phrases there are; a join on a
pattern would compare each text with each phrase.  Phrases are collected in shares of at most ``most`` and broadcast as automata, one pass
for each share, so what the driver holds is bounded too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import text_batches

BLANKS = re.compile(r"[ \t\n\x0b\f\r]+")


def needle(phrase: Column | str, words: bool = True) -> Column:
    """What is looked for: the phrase in lower case with single blanks, or the phrase as it is."""
    c = F.col(phrase) if isinstance(phrase, str) else phrase
    return F.trim(F.regexp_replace(F.lower(c), r"[ \t\n\x0B\f\r]+", " ")) if words else c


def _in_word(c: str) -> bool:
    return c == "_" or c.isalpha() or c.isdecimal()


def bounded(text: str, start: int, end: int, open_end: bool) -> bool:
    """Whether a word's bound (a change between word and other characters) lies at both ends; ``open_end``: at the start."""
    first = start == 0 or _in_word(text[start - 1]) != _in_word(text[start])
    first = first and (start > 0 or _in_word(text[start]))
    if open_end or not first:
        return first
    return _in_word(text[end - 1]) if end == len(text) else _in_word(text[end - 1]) != _in_word(text[end])


def build(needles: list[str], words: bool):
    """The automaton of ``needles``; in words a final ``*`` lets any letters follow."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for i, n in enumerate(needles):
        own = n[:-1] if words and n.endswith("*") else n
        if own:
            # a phrase and the same with a star end in one state
            out.add_word(own, (*out.get(own, ()), (i, len(own), own != n)))
    out.make_automaton()
    return out


def scan(automaton, text: str, words: bool) -> dict[int, list[int]]:
    """Number of hits and place of the first for each phrase that the text holds."""
    own = BLANKS.sub(" ", text) if words else text
    hits: dict[int, list[int]] = {}
    if not len(automaton):
        return hits
    for last, found in automaton.iter(own):
        for i, size, open_end in found:
            start = last + 1 - size
            if words and not bounded(own, start, last + 1, open_end):
                continue
            seen = hits.get(i)
            if seen is None:
                hits[i] = [1, start]
            else:
                seen[0] += 1
                seen[1] = min(seen[1], start)
    return hits


def phrase_hits(texts: DataFrame, keys: list[str], text: str, phrases: DataFrame, phrase: str, words: bool = True, most: int = 1_000_000) -> DataFrame:
    """``keys, needle, hits, first``: the phrases that each text, in lower case, holds, how often, and where first (in code points).

    ``words``: blanks count alike, and phrases begin and end at bounds of words (a final ``*`` leaves the end open). Otherwise any
    occurrence counts. Null texts and empty phrases have no hits; hits of one phrase may overlap; equal phrases are one.
    """
    spark = texts.sparkSession
    text_batches(spark)
    own = phrases.select(needle(phrase, words).alias("needle")).where("needle != '' AND needle != '*'").distinct()
    shares = max(1, -(-own.count() // most))
    held = texts.select(*keys, F.lower(text).alias("_text")).where("_text IS NOT NULL")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields[:-1]] + ["needle string, hits bigint, first bigint"])
    out = None
    for share in range(shares):
        part = own.where(F.pmod(F.xxhash64("needle"), F.lit(shares)) == share) if shares > 1 else own
        names = sorted(r.needle for r in part.collect())  # of bounded size
        sent = spark.sparkContext.broadcast((names, build(names, words)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, automaton = sent.value
            for batch in batches:
                rows, found, hits, first = [], [], [], []
                for r, t in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                    for i, (n, at) in scan(automaton, t, words).items():
                        rows.append(r)
                        found.append(names[i])
                        hits.append(n)
                        first.append(at)
                if rows:
                    kept = batch.select(batch.schema.names[:-1]).take(pa.array(rows, pa.int64()))
                    columns = [*kept.columns, pa.array(found, pa.string()), pa.array(hits, pa.int64()), pa.array(first, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, [*kept.schema.names, "needle", "hits", "first"])

        got = held.mapInArrow(run, schema)
        out = got if out is None else out.unionByName(got)
    return out
