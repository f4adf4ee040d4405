"""Toxicity of texts behind noise: lattices of characters are decoded under a character language model, then scored.

A text is lower-cased.  A word that holds digits or signs, characters three times in a row or several doubled ones, and a run of
single characters that blanks or punctuation set apart, become lattices.  In a lattice a sign or digit may stand for each letter
that it imitates or for itself, a character that stands several times in a row for one letter or for two, and what sets
characters apart for nothing or for the edge of a word.  A Viterbi search keeps the likeliest path under a bigram model of
characters that is counted from the words of all documents; where a character stands three times or more, the likeliest path with
two letters there is scored too, as bigrams always like one letter better.  A second search cuts the letters of a run into the
likeliest words of the labelled rows, and what they don't know is left to the bigrams.  The restored words are scored by their
word starts and whole words under a log-linear model learned from labelled rows.  Texts of any length are read whole.

Fitting reads all labelled rows that are not held out, and their lattices once; the language model counts all words of all
documents.  Nulls and empty texts get the score of no evidence; an empty
table gives an empty one; repeated rows score alike; columns are kept, those of the added names are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import materialize, small_side, text_batches

#: Letters that a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou", "#": "h"}
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
SIZE = len(ALPHABET) + 1  # and the edge of a word
EDGE = SIZE - 1
#: Log-probabilities of arcs: a sign standing for a letter, a digit or sign standing for itself, a doubled character standing for
#: one letter, characters set apart.
NOISE, ITSELF, TWICE, APART = -2.0, -4.0, -2.5, -0.2
UNKNOWN = -4.6  # log-probability of a word that the labelled rows don't hold twice
BUCKETS = 1 << 18
STARTS = (4, 5, 6)  # letters of word starts
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_]|[@$!|+(*#€£])(?:[ ._\-*~]{1,2}(?:[^\W_]|[@$!|+(*#€£])){3,}(?![^\W_])")
#: What every match of ``_SPACED`` holds, which most texts lack and which is found sooner.
_SOME_SPACED = re.compile(r"[ ._\-*~](?:[^\W_]|[@$!|+(*#€£])[ ._\-*~]{1,2}(?:[^\W_]|[@$!|+(*#€£])[ ._\-*~]")
_WORD = re.compile(r"[^\W_](?:[^\s]*[^\W_@$!|+(*#€£])?|[@$!|+(*#€£][^\s]*[^\W_]")
_NOISY = re.compile(r"[0-9@$!|+(*#€£._\-~]")
_LONG = re.compile(r"(.)\1{2,}|(?:(\w)\2){2}")
#: A character with its repetitions, which may be set apart; or what sets apart.
_RUN = re.compile(r"([^\s._\-~*])(?:[\s._\-~*]{0,2}\1)*|.", re.S)
_APART = re.compile(r"[\s._\-~]")
_PLAIN = re.compile(r"[^\W\d_]+")
#: Signs after a word that say nothing of it.
_MARKS = ".,;:!?$*)]}'\""
#: Tokens that a task remembers.
REMEMBERED = 200_000


def char_counts(words: list[str]) -> np.ndarray:
    """Bigrams of the letters a-z in words, with their edges."""
    out = np.zeros((SIZE, SIZE), np.int64)
    for w in words:
        last = SIZE - 1
        for c in w:
            i = ALPHABET.find(c)
            if i >= 0:
                out[last, i] += 1
            last = i if i >= 0 else SIZE - 1
        out[last, SIZE - 1] += 1
    return out


#: Log-probabilities of a letter (column) after another (row), as lists, which single look-ups read faster.
Chars = list[list[float]]


def log_model(counts: np.ndarray) -> Chars:
    counts = counts + 0.5
    return np.log(counts / counts.sum(1, keepdims=True)).tolist()


def readings(c: str) -> str:
    return c if c in ALPHABET else LEET.get(c, "")


def arcs(c: str, n: int, last: int, double: bool, model: Chars) -> list[tuple[int, str, float]]:
    """The ways to read a character that stands ``n`` times, after the letter ``last``: the next letter, the text and the score."""
    out = []
    apart = _APART.fullmatch(c) is not None
    if apart or c == "*":
        out += [(last, "", APART), (EDGE, " ", (model[last][EDGE] if last != EDGE else 0.0) + APART)]
    if not apart:
        to_edge = model[last][EDGE] if last != EDGE else 0.0
        letters = readings(c)
        for x in letters:
            i = ALPHABET.index(x)
            once = model[last][i] + (0.0 if x == c else NOISE)
            if n == 1 or not (double and n > 2):
                out.append((i, x, once + (TWICE if n == 2 else 0.0)))
            if n == 2 or (double and n > 2):
                out.append((i, x + x, once + model[i][i]))
        if c not in ALPHABET:
            # a letter of another alphabet is itself; what stands for letters may be, and other signs are passed over
            if c.isalpha():
                out.append((EDGE, c * min(n, 2 if double or n == 2 else 1), to_edge))
            elif letters or c.isdigit():
                out.append((EDGE, f" {c * n} ", to_edge + ITSELF))
            else:
                out.append((last, "", APART))
    return out


def runs_of(word: str) -> list[tuple[str, int]]:
    """The characters of a word, and how often each stands in a row."""
    return [(m[0][0], m[0].count(m[0][0])) for m in _RUN.finditer(word)]


def best_path(word: str, model: Chars, double: bool = False) -> tuple[float, str]:
    """Viterbi: the score and the text of the likeliest path through the lattice of a noisy word."""
    best, back = {EDGE: 0.0}, []
    for c, n in runs_of(word):
        new: dict[int, float] = {}
        own: dict[int, tuple[int, str]] = {}
        for last, score in best.items():
            for i, x, step in arcs(c, n, last, double, model):
                if i not in new or score + step > new[i]:
                    new[i], own[i] = score + step, (last, x)
        best = new
        back.append(own)
    total = {i: best[i] + (model[i][EDGE] if i != EDGE else 0.0) for i in best}
    at = max(total, key=total.get)
    score, out = total[at], []
    for own in reversed(back):
        at, x = own[at]
        out.append(x)
    return score, " ".join("".join(reversed(out)).split())


def decode(word: str, model: Chars) -> list[str]:
    """The likeliest readings of a noisy word: with one letter, and with two, where a character stands three times or more."""
    out = [best_path(word, model)[1]]
    if any(n > 2 for _, n in runs_of(word)):
        out.append(best_path(word, model, True)[1])
    return list(dict.fromkeys(out))


def segment(letters: str, model: Chars, words: dict[str, float], longest: int) -> list[str]:
    """The likeliest words that letters without blanks consist of; unknown words may be of any length."""
    edge = SIZE - 1
    at = [i if (i := ALPHABET.find(c)) >= 0 else edge for c in letters]
    best, start = [0.0], [0]
    inner, begun, begun_at = 0.0, -np.inf, 0  # bigrams so far; the best begin of an unknown word, less the bigrams before it
    for j in range(1, len(letters) + 1):
        if j > 1:
            inner += model[at[j - 2]][at[j - 1]]
        if (value := best[j - 1] + UNKNOWN + model[edge][at[j - 1]] - inner) > begun:
            begun, begun_at = value, j - 1
        score, since = begun + inner + model[at[j - 1]][edge], begun_at
        for i in range(max(0, j - longest), j):
            known = words.get(letters[i:j])
            if known is not None and best[i] + known > score:
                score, since = best[i] + known, i
        best.append(score)
        start.append(since)
    out, j = [], len(letters)
    while j:
        out.append(letters[start[j] : j])
        j = start[j]
    return out


#: Base of the hash of words, modulo 2^64.
BASE = np.uint64(0x9E3779B97F4A7C15)


def sums_of(letters: str) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial hashes of the prefixes of ``letters``, and the powers of the base."""
    codes = np.frombuffer(letters.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    powers = np.cumprod(np.append(np.uint64(1), np.full(len(codes), BASE)), dtype=np.uint64)
    # the hash of a prefix, times a power that all its characters share, is a sum; an odd base has an inverse
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    down = np.cumprod(np.append(np.uint64(1), np.full(len(codes), inverse)), dtype=np.uint64)
    return np.append(np.uint64(0), np.cumsum(codes * down[:-1], dtype=np.uint64)), powers


def hashes(words: list[str]) -> list[int]:
    out = []
    for w in words:
        sums, _ = sums_of(w)
        out.append(int(sums[-1]))
    return out


@dataclass
class Words:
    """Log-probabilities of the words of labelled rows, by their sorted hashes: some bytes a word, however many there are."""

    keys: np.ndarray
    logs: np.ndarray
    longest: int

    def within(self, letters: str) -> dict[str, float]:
        """The known words among the substrings of ``letters``."""
        out: dict[str, float] = {}
        if not len(self.keys):
            return out
        sums, powers = sums_of(letters)
        for size in range(1, min(self.longest, len(letters)) + 1):
            own = (sums[size:] - sums[:-size]) * powers[: len(letters) - size + 1]
            at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
            for i in np.flatnonzero(self.keys[at] == own):
                out[letters[i : i + size]] = float(self.logs[at[i]])
        return out


NO_WORDS = Words(np.zeros(0, np.uint64), np.zeros(0), 0)


def pieces(texts: Iterable[str], most: int = 1 << 20) -> Iterator[list[str]]:
    """Texts in lists of about ``most`` characters, whose new tokens are handled at once."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def restored(tokens: list[str], model: Chars) -> list[str]:
    """``restore`` of each token; those of letters alone that no lattice reads otherwise, which most are, are found together."""
    cores = [t.rstrip(_MARKS) for t in tokens]
    codes = np.frombuffer("\n".join(cores).encode("utf-32-le", "surrogatepass"), np.uint32)
    same = np.append(codes[1:] == codes[:-1], [False, False, False])
    # three in a row, or two doubled ones next to each other: at least what _LONG finds
    at = np.flatnonzero(same[:-2] & (same[1:-1] | same[2:]))
    first = np.cumsum([0, *(len(c) + 1 for c in cores)])
    long = set((np.searchsorted(first, at, "right") - 1).tolist())
    return [c if c.isalpha() and i not in long else restore(t, model) for i, (t, c) in enumerate(zip(tokens, cores, strict=True))]


def token_buckets(tokens: list[str], model: Chars) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The restored words of each token, and the number of the token and the bucket of each bucket of these words."""
    own = restored(tokens, model)
    owner = np.repeat(np.arange(len(own)), [r.count(" ") + 1 if r else 0 for r in own])
    word, bucket = word_buckets(" ".join(own).split())
    return own, owner[word], bucket


class Tokens:
    """What a task remembers of tokens: their restored words, joined by spaces, and the buckets of these, end to end in one array."""

    def __init__(self, model: Chars):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.words: list[str] = []
        self.first, self.buckets = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def add(self, tokens: list[str]) -> None:
        own, owner, bucket = token_buckets(tokens, self.model)
        self.place.update(zip(tokens, range(len(self.words), len(self.words) + len(tokens)), strict=True))
        self.words += own
        self.first = np.append(self.first, self.first[-1] + np.cumsum(np.bincount(owner, minlength=len(tokens))))
        self.buckets = np.append(self.buckets, bucket[np.argsort(owner, kind="stable")].astype(np.int32))

    def of(self, lows: list[str]) -> Iterator[tuple[list[str], np.ndarray]]:
        """The distinct restored words of the tokens of lower-cased texts, and their buckets in order."""
        if len(self.words) > REMEMBERED:
            self.clear()
        sets = [set(low.split()) for low in lows]
        if new := set().union(*(own.difference(self.place) for own in sets)):
            self.add(list(new))
        for own in sets:
            at = np.fromiter(map(self.place.__getitem__, own), np.int64, len(own))
            first, n = self.first[at], self.first[at + 1] - self.first[at]
            # the ranges of all tokens: a number for each bucket, which starts anew with each token
            ranges = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            yield list(set(" ".join([self.words[i] for i in at.tolist()]).split())), np.unique(self.buckets[ranges])


def token_words(low: str, model: Chars) -> set[str]:
    """The distinct restored words of the tokens of a lower-cased text."""
    return {w for token in set(low.split()) for w in restore(token, model).split()}


def spaced_paths(low: str, model: Chars) -> list[str]:
    """The likeliest readings of the runs of single characters of a lower-cased text."""
    out: dict[str, None] = {}
    if not _SOME_SPACED.search(low):
        return []
    for m in _SPACED.finditer(low):
        # letters set apart one by one are read together too; what a wider gap sets apart, by itself as well
        for run in {m[0], *re.split(r"[ ._\-*~]{2}", m[0])}:
            if sum(c.isalpha() for c in run) >= 2:
                out.update(dict.fromkeys(decode(run, model)))
    return list(out)


def spaced_words(paths: list[str], model: Chars, words: Words) -> set[str]:
    """The words of readings, and the likeliest words that their letters consist of."""
    out: set[str] = set()
    for path in paths:
        letters = "".join(c for c in path if not c.isspace())
        out.update(path.split())
        out.update(segment(letters, model, words.within(letters), words.longest))
    return out


def lattice_words(text: str, model: Chars, words: Words = NO_WORDS) -> set[str]:
    """The distinct restored words of a text."""
    low = text.lower()
    return token_words(low, model) | spaced_words(spaced_paths(low, model), model, words)


def restore(token: str, model: Chars) -> str:
    """Words that a token without white space may stand for, joined by spaces."""
    out = _PLAIN.findall(token)
    noisy = _NOISY.search(token)
    if noisy or _LONG.search(token):
        m = _WORD.search(token)
        core = m[0] if m else ""
        if sum(c.isalpha() for c in core) >= 2 and (_NOISY.search(core) or _LONG.search(core)):
            out = [w for path in decode(core, model) for w in path.split()] + out
    return " ".join(dict.fromkeys(out))


def buckets(words: Iterable[str]) -> set[int]:
    """Buckets of whole words and of word starts of 4 to 6 letters."""
    names = set()
    for w in words:
        names.add("=" + w)
        for k in STARTS:
            if len(w) > k:
                names.add(w[:k])
    return {zlib.crc32(n.encode()) % BUCKETS for n in names}


def crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


CRC = crc_table()


def word_buckets(words: list[str], most: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """The number of the word and the bucket of each of the ``buckets`` of each word: the CRC-32 of all words goes on byte by byte.

    Words of more than ``most`` bytes are taken one by one.
    """
    column = pa.array(words, pa.string())
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends, data = np.frombuffer(column.buffers()[1], np.int32)[: len(words) + 1], np.frombuffer(column.buffers()[2], np.uint8)
    size = np.diff(ends)
    long = np.flatnonzero(size > most)
    at = np.argsort(-size, kind="stable")[long.size :]
    first, size = ends[at], size[at]
    step = lambda state, byte: CRC[(state ^ byte) & 0xFF] ^ (state >> 8)
    start = np.full(at.size, 0xFFFFFFFF, np.uint32)
    whole, letters = step(start, np.uint32(ord("="))), np.zeros(at.size, np.int64)
    out = []
    for j in range(int(size.max(initial=0))):
        n = int(np.searchsorted(-size, -j, "left"))  # words of more than j bytes
        byte = data[first[:n] + j].astype(np.uint32)
        begins = (byte & 0xC0) != 0x80
        for k in STARTS:
            if j >= k and (own := np.flatnonzero(begins & (letters[:n] == k))).size:
                out.append((at[own], start[own]))
        letters[:n] += begins
        whole[:n], start[:n] = step(whole[:n], byte), step(start[:n], byte)
    out.append((at, whole))
    by_one = [(i, b) for i in long.tolist() for b in buckets([words[i]])]
    word = np.concatenate([*(o for o, _ in out), np.array([i for i, _ in by_one], np.int64)])
    return word, np.concatenate([*(~c % np.uint32(BUCKETS) for _, c in out), np.array([b for _, b in by_one], np.uint32)]).astype(np.int64)


def features(words: Iterable[str]) -> np.ndarray:
    """The buckets of words, as an array."""
    own = buckets(words)
    return np.fromiter(own, np.int64, len(own))


@dataclass
class Model:
    chars: Chars
    weights: np.ndarray  # log-odds of each bucket where they speak for label 1 reliably, else 0
    bias: float
    scale: float
    words: Words

    def evidence(self, batches: Iterable[Iterable[str | None]]) -> Iterator[np.ndarray]:
        """The sums of the weights of the buckets of each text, by batch.

        Most tokens have no bucket with a weight: they are kept as a set, so that one difference leaves the few tokens of a text that speak or are new.
        """
        silent: set[str] = set()
        speak: dict[str, list[int]] = {}
        for texts in batches:
            totals = []
            for own in pieces(t or "" for t in texts):
                if len(silent) + len(speak) > REMEMBERED:
                    silent.clear()
                    speak.clear()
                lows = [t.lower() for t in own]
                sets = [set(low.split()) - silent for low in lows]
                new = list(set().union(*sets).difference(speak))
                _, owner, bucket = token_buckets(new, self.chars)
                weighted = self.weights[bucket] != 0
                for i, b in zip(owner[weighted].tolist(), bucket[weighted].tolist(), strict=True):
                    speak.setdefault(new[i], []).append(b)
                silent.update(set(new).difference(speak))
                for low, tokens in zip(lows, sets, strict=True):
                    found = {b for t in tokens - silent for b in speak[t]}
                    if paths := spaced_paths(low, self.chars):
                        found |= buckets(spaced_words(paths, self.chars, self.words))
                    totals.append(self.weights[sorted(found)].sum(dtype=np.float64) if found else 0.0)
            yield np.array(totals, np.float64)


def byte_pairs(texts: list[bytes], piece: int = 1 << 20) -> np.ndarray:
    """How often each byte (256 times the first and the second) follows another within a text: all texts are counted as one, in pieces, less the pairs across texts."""
    total = np.zeros(65536, np.int64)
    b = np.frombuffer(b"".join(texts), np.uint8)
    for at in range(0, max(0, b.size - 1), piece):
        own = b[at : at + piece + 1].astype(np.uint16)
        total += np.bincount((own[:-1] << 8) | own[1:], minlength=65536)
    ends = np.cumsum([len(t) for t in texts if t], dtype=np.int64)[:-1]
    return total - np.bincount((b[ends - 1].astype(np.int64) << 8) | b[ends], minlength=65536) if ends.size else total


def fit_chars(docs: DataFrame, text: str = "text") -> Chars:
    """The character model from all words of all documents: each task sums its bigrams, Spark adds the sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(65536, np.int64)
        for batch in batches:
            total += byte_pairs([t.lower().encode() for t in batch.column(0).to_pylist() if t])
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], ["pair", "n"])

    rows = docs.select(text).mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect()  # 65,536 rows at most
    out = np.zeros((SIZE, SIZE), np.int64)
    at = {ord(c): i for i, c in enumerate(ALPHABET)}
    for pair, n in rows:
        a, b = divmod(pair, 256)
        i, j = at.get(a, SIZE - 1), at.get(b, SIZE - 1)
        if (i, j) != (SIZE - 1, SIZE - 1):
            out[i, j] += n
    return log_model(out)


LATTICES = "words array<string>, at array<int>, paths array<string>, label int"


def lattices(labelled: DataFrame, chars: Chars, text: str, label: str) -> DataFrame:
    """Of each labelled text the words of its tokens, their buckets, and the readings of its runs of single characters."""
    sent = labelled.sparkSession.sparkContext.broadcast(chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(sent.value)
        for batch in batches:
            words, at, paths = [], [], []
            for texts in pieces(batch.column(0).to_pylist()):
                lows = [t.lower() for t in texts]
                for own, buckets_of_own in tokens.of(lows):
                    words.append(own)
                    at.append(buckets_of_own)
                paths += [spaced_paths(low, sent.value) for low in lows]
            kinds = pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.string())
            columns = [pa.array(c, kind) for c, kind in zip((words, at, paths), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(1)], ["words", "at", "paths", "label"])

    return labelled.select(text, (F.col(label) > 0).cast("int").alias("label")).mapInArrow(run, LATTICES)


def buckets_of(batch: pa.RecordBatch, chars: Chars, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (at, paths, label) of lattices the number in the batch and the bucket of each occurrence, and the labels of all."""
    at, paths = batch.column(0), batch.column(1)
    row, own = np.repeat(np.arange(batch.num_rows), at.value_lengths().to_numpy(zero_copy_only=False)), at.flatten().to_numpy().astype(np.int64)
    more_rows, more = [], []
    for i in np.flatnonzero(paths.value_lengths().to_numpy(zero_copy_only=False)):  # few rows have spaced runs
        new = np.setdiff1d(features(spaced_words(paths[int(i)].as_py(), chars, words)), own[row == i])
        more.append(new)
        more_rows.append(np.full(new.size, i))
    return np.concatenate([row, *more_rows]), np.concatenate([own, *more]), batch.column(2).to_numpy()


def fit(labelled: DataFrame, chars: Chars, most: int = 4096, text: str = "text", label: str = "toxic") -> Model:
    """Learn from all labelled texts.  Copies count once.

    Words that stand in two rows or more cut joined runs.  Tasks count in how many rows of either label a bucket occurs; the ``most`` buckets that stand out most in label 1 get
    weights by L1 logistic regression, which leaves a bucket out that others explain. Rows that hold the same of these buckets are one with a weight.
    """
    spark = labelled.sparkSession
    text_batches(spark)
    own = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull()).groupBy(F.sha2(text, 256).alias("_h")).agg(F.any_value(text).alias(text), F.max(F.col(label).cast("int")).alias(label))
    own = materialize(lattices(own, chars, text, label), "lattices")
    words = fit_words(own)
    sent = spark.sparkContext.broadcast((chars, words))
    own = own.select("at", "paths", "label")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            row, at, label = buckets_of(batch, *sent.value)
            n += np.bincount(label, minlength=2)
            both += np.bincount(label[row] * np.int64(BUCKETS) + at, minlength=2 * BUCKETS).reshape(2, BUCKETS)
        for y in (0, 1):
            i = np.flatnonzero(both[y])
            yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1)), pa.array(np.full(len(i) + 1, y)), pa.array(np.append(both[y, i], n[y]))], ["bucket", "label", "n"])

    rows = own.mapInArrow(count, "bucket bigint, label bigint, n bigint").groupBy("bucket", "label").agg(F.sum("n").alias("n")).toPandas()
    counts, total = np.zeros((2, BUCKETS)), np.zeros(2)
    for y in (0, 1):
        of = rows[rows.label == y]
        counts[y, of.bucket[of.bucket >= 0].to_numpy(int)] = of.n[of.bucket >= 0]
        total[y] = of.n[of.bucket < 0].sum()
    chosen = standouts(counts, total, most)
    if not len(chosen):
        return Model(chars, np.zeros(BUCKETS, np.float32), -3.0 if total[0] else 0.0, 1.0, words)
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, label = buckets_of(batch, *sent.value)
            row, at = row[place[at] >= 0], place[at][place[at] >= 0]
            order = np.lexsort((at, row))
            ends = np.append(0, np.cumsum(np.bincount(row, minlength=batch.num_rows)))
            own = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at[order], pa.int32()))
            yield pa.RecordBatch.from_arrays([own, pa.array(label, pa.int32())], ["at", "label"])

    found = materialize(own.mapInArrow(occurrences, "at array<int>, label int").groupBy("at", "label").agg(F.count(F.lit(1)).alias("n")), "occurrences")
    weights, bias = regress(found, len(chosen), total)
    out = np.zeros(BUCKETS, np.float32)
    out[chosen] = weights
    return Model(chars, out, bias, 1.0, words)


def fit_words(own: DataFrame) -> Words:
    """The words that stand in two rows or more of lattices, outside of joined runs; their hashes come to the driver."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.array(hashes(batch.column(0).to_pylist()), np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(1), batch.column(2)], ["key", "n", "size"])

    rows = own.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = rows.select("word", "n", F.length("word").alias("size")).mapInArrow(hashed, "key bigint, n bigint, size int").toArrow()
    if not rows.num_rows:
        return NO_WORDS
    keys, n = rows["key"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(keys)
    return Words(keys[order], np.log(n[order] / n.sum()), int(rows["size"].to_numpy().max()))


def standouts(counts: np.ndarray, total: np.ndarray, most: int) -> np.ndarray:
    """The buckets whose count in label 1 lies highest above what their frequency leads one to expect."""
    n0, n1 = total
    if not n0 or not n1:
        return np.zeros(0, np.int64)
    share = n1 / (n0 + n1)
    seen = counts.sum(0)
    z = (counts[1] - seen * share) / np.sqrt(np.maximum(seen * share * (1 - share), 1e-9))
    good = np.flatnonzero((z > 2.5) & (counts[1] >= 2) & (counts[1] > 2 * share * seen))
    return good[np.argsort(-z[good], kind="stable")[:most]]


#: Occurrences that the driver may hold for the regression; more stay in tasks.
HELD = 8_000_000


@dataclass
class Rows:
    """Rows of equal buckets, as columns of their occurrences."""

    row: np.ndarray
    col: np.ndarray
    y: np.ndarray
    n: np.ndarray

    @staticmethod
    def of(at: list, y: np.ndarray, n: np.ndarray) -> Rows:
        col = np.concatenate([*(np.asarray(a, np.int32) for a in at), np.zeros(0, np.int32)])
        return Rows(np.repeat(np.arange(len(at), dtype=np.int32), [len(a) for a in at]), col, y.astype(float), n.astype(float))

    def gradient(self, z: np.ndarray, b: float) -> np.ndarray:
        """The sums of the errors for each bucket, and of all."""
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(self.row, weights=z[self.col], minlength=len(self.y)), -30, 30)))
        error = (p - self.y) * self.n
        return np.append(np.bincount(self.col, weights=error[self.row], minlength=len(z)), error.sum())


def regress(found: DataFrame, width: int, total: np.ndarray, steps: int = 400, l1: float = 2.0) -> tuple[np.ndarray, float]:
    """Logistic regression of rows (at, label, n) with non-negative weights under an L1 penalty, by accelerated proximal steps.

    Up to ``HELD`` occurrences of distinct rows are summed by the driver; more stay in tasks, of which each step adds up the gradients.
    """
    size = F.size("at")
    seen, most = found.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    degree = np.zeros(width)
    for at, n in found.select(F.explode("at").alias("at"), "n").groupBy("at").agg(F.sum("n")).collect():  # as many as there are chosen buckets
        degree[at] = n
    packed = None
    if seen <= HELD:
        held = found.toPandas()
        gradient = Rows.of(list(held["at"]), held["label"].to_numpy(), held["n"].to_numpy()).gradient
    else:

        def pack(rows: Iterator) -> Iterator[Rows]:
            rows = list(rows)
            yield Rows.of([r.at for r in rows], np.array([r.label for r in rows]), np.array([r.n for r in rows]))

        packed = found.rdd.mapPartitions(pack).persist(StorageLevel.MEMORY_AND_DISK)
        gradient = lambda z, b: packed.map(lambda r: r.gradient(z, b)).treeReduce(np.add)
    rows = total.sum()
    w, b = np.zeros(width), float(np.log((total[1] + 0.5) / (total[0] + 0.5)))
    # a bound of the curvature for each coordinate block
    step = 4.0 / max(1.0, most) / np.maximum(degree, 1)
    z, zb, t = w.copy(), b, 1.0
    for _ in range(steps):
        g = gradient(z, zb)
        new = np.maximum(0.0, z - step * (g[:-1] + l1))
        nb = zb - 2.0 * float(g[-1] / rows)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb = new + (t - 1) / s * (new - w), nb + (t - 1) / s * (nb - b)
        w, b, t = new, nb, s
    if packed is not None:
        packed.unpersist()
    return w, b


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Every row with ``score`` (0 to 1) and ``predicted``."""
    text_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = sent.value
        for total in own.evidence(batches):
            yield pd.Series(1 / (1 + np.exp(-np.clip(own.bias + own.scale * total, -30, 30))), dtype="float64")

    return docs.withColumn("score", apply(F.col(text))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Both models.  Labels of held-out rows (crc32 of the id mod 4 is 2) are not read; all others are.  Conflicting labels of one id: the highest."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return fit(docs.select("doc_id", "text").join(small_side(own), "doc_id"), fit_chars(docs))


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2
