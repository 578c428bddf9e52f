"""Secret scans: patterns of keys, and values judged by the guesses they would take.

The base finds assignments, access keys and long hexadecimal runs. Beside it,
the value that follows a word for a credential is cut, by dynamic programming,
into the segments that cost an attacker least: words, dates, repeats, keyboard
walks, addresses and single characters tried by brute force. The cost alone decides: a value
that takes many guesses even so is a secret, of whatever characters it is; a word or a date
after ``password is`` is not.

Null and empty texts have no spans. Repeated rows are scanned each, also those without a
doc_id. Texts of any length are scanned whole, in time that grows with their length. An empty table gives
no rows. Other columns of the input, whatever their names, play no part. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from bisect import bisect_left
from collections.abc import Iterator, Mapping
from itertools import accumulate
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import map_slices
from tidewell.llm.packing import byte_letters

#: Fixed patterns of the base; a match of each kind must be long enough too.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_VALUE = 8
#: The kinds in the order that spans of one start are listed in.
KINDS = ("assign", "access", "hex", "guess")

#: A word for a credential, and what stands between it and its value. Letters, digits, ``_`` and ``-`` may stand before
#: the word, and parts of a name behind it. Separators may follow one another, and so may the scheme of a header.
CONTEXT = re.compile(
    r"(?:pass(?:word|wd|phrase|code|key)?|pwd|pin|secret|token|credentials?|login|auth(?:orization)?|bearer"
    r"|(?:api|access|private|signing|encryption)[ _-]?key)s?(?:[_-][a-z0-9]+|(?-i:[A-Z])[a-z0-9]*|[0-9]+)*+[\"'`)\]]{0,2}"
    r"(?:(?:[ \t]*(?:=>|:=|->|[:=])|[ \t]+(?:is|was)(?=[ \t:=]))++(?:[ \t]*[\"'`(\[]{0,2}(?:bearer|basic|digest|token)[ \t]+(?![:=]|->))?"
    r"|(?<=bearer)[ \t]+)[ \t]*[\"'`(\[]{0,2}(?=[^\s\"'`,;()\[\]{}<>])",
    re.IGNORECASE | re.ASCII,
)
VALUE = re.compile(r"[^\s\"'`,;()\[\]{}<>]+")
#: What ends a sentence or a clause behind a value and is no part of it.
AFTER = ".:"
#: Parts of which every text with a context has one, in lower case.
STEMS = ("pass", "pwd", "pin", "secret", "token", "credential", "login", "auth", "bearer", "key")
#: A value is a secret from so many guesses on, as a power of ten.
GUESSES = 8.0

#: Words that attackers try first, most common first. Fixed values.
COMMON = (
    "password 123456 qwerty letmein admin welcome monkey dragon master login abc123 iloveyou sunshine princess "
    "football shadow secret root test guest user hello freedom whatever trustno1 superman batman baseball default "
    "changeme example sample your here none null true false token key the and for with not please enter value "
    "required optional string hidden redacted unknown placeholder summer winter spring autumn january february "
    "march april may june july august september october november december monday friday london paris love money"
).split()
#: Letters that stand for others in words.
LEET = str.maketrans("@4310$5!7", "aaeiossit")
#: Rows of a keyboard, and the digits and letters in their own order.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz", "0123456789")
NEXT = {r[i : i + 2] for row in ROWS for r in (row, row[::-1]) for i in range(len(row) - 1)}
DATES = re.compile(r"\d{1,4}([-/._])\d{1,2}\1\d{1,4}|(?:19|20)\d\d(?:[01]\d[0-3]\d)?|[0-3]\d[01]\d(?:19|20)\d\d")
REPEATS = re.compile(r"(.{1,8}?)\1{2,}", re.DOTALL)
#: Addresses are known and not guessed: of mail, and of hosts behind a scheme.
ADDRESS = re.compile(r"(?<![\w.+-])[\w.+-]++@(?:[\w-]{3,}+\.)+(?:com|org|net|edu|gov|info|io|eu|uk|de|fr|es)\b|https?://[\w.-]++(?::\d++)?(?![\w@:])", re.ASCII)
ADDRESS_COST = 4.0
#: What joins words takes few guesses.
JOINTS = "-_./"


def brute(c: str) -> float:
    """Guesses for one character, as a power of ten, by the class it is of."""
    if c.isdigit():
        return 1.0
    if c.isascii() and c.isalpha():
        return math.log10(26)
    if c in JOINTS:
        return math.log10(5)
    return math.log10(33) if c.isascii() else 2.0


class Words:
    """Ranked words that attackers try, found in a value in one pass."""

    def __init__(self, ranks: Mapping[str, int]):
        self.ranks = dict(ranks)
        self.pass_over = ahocorasick.Automaton()
        for word, rank in self.ranks.items():
            self.pass_over.add_word(word, (len(word), math.log10(rank + 1)))
        self.pass_over.make_automaton()

    def __reduce__(self):
        return Words, (self.ranks,)

    def within(self, text: str) -> Iterator[tuple[int, int, float]]:
        for last, (length, cost) in self.pass_over.iter(text):
            yield last + 1 - length, last + 1, cost


WORDS = Words({w: i + 1 for i, w in enumerate(COMMON)})


def segments(value: str, words: Words = WORDS) -> list[tuple[int, int, float]]:
    """Start, end and power of ten of the guesses of each cheap segment of a value."""
    found = []
    # Letters that grow when lowered keep their places.
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(LEET)
    for text, more in ((low, 0.0), (plain, 0.5)) if plain != low else ((low, 0.0),):
        for i, k, cost in words.within(text):
            found.append((i, k, cost + more + (0.5 if value[i:k] != low[i:k] else 0.0)))
    for m in DATES.finditer(value):
        found.append((m.start(), m.end(), 2.1 if m.end() - m.start() == 4 else 4.6))
    for m in ADDRESS.finditer(value):
        found.append((m.start(), m.end(), ADDRESS_COST))
    for m in REPEATS.finditer(value):
        unit = m[1]
        found.append((m.start(), m.end(), least_guesses(unit, words) + math.log10(len(m[0]) / len(unit))))
    start = 0
    for i in range(1, len(low) + 1):
        if i == len(low) or low[i - 1 : i + 1] not in NEXT:
            if i - start >= 3:
                found.append((start, i, math.log10(94) + math.log10(i - start)))
            start = i
    return found


def least_guesses(value: str, words: Words = WORDS) -> float:
    """The power of ten of the guesses that the cheapest segmentation of a value takes."""
    ending: dict[int, list[tuple[int, float]]] = {}
    for a, b, cost in segments(value, words):
        ending.setdefault(b, []).append((a, cost))
    best = [0.0] * (len(value) + 1)
    for k in range(1, len(value) + 1):
        best[k] = best[k - 1] + brute(value[k - 1])
        for a, cost in ending.get(k, ()):
            # Each segment costs a little more: the attacker must guess that it is there.
            best[k] = min(best[k], best[a] + cost + 0.3)
    return best[-1]


def ranked_words(path: str) -> Words:
    """WORDS, and behind them the whole words of a public vocabulary, some 30,000, by their order in it."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    byte = {c: b for b, c in enumerate(byte_letters())}
    ranks = dict(WORDS.ranks)
    for word in sorted(vocab, key=vocab.get):
        if word.endswith("</w>"):
            word = bytes(byte[c] for c in word[:-4]).decode("utf-8", "replace")
            if len(word) >= 3 and word.isalpha():
                ranks.setdefault(word, len(ranks) + 1)
    return Words(ranks)


class Span(NamedTuple):
    start: int
    rank: int
    end: int

    def __str__(self) -> str:
        return f"{KINDS[self.rank]}:{self.start}:{self.end}"


def base_spans(text: str) -> list[Span]:
    low = text.lower()
    found = []
    if any(w in low for w in ("password", "passwd", "secret", "token", "api")):
        found += [Span(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    found += [Span(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [Span(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def guessed_spans(text: str, base: list[Span], words: Words = WORDS, guesses: float = GUESSES) -> list[Span]:
    """Values after a word for a credential that take many guesses and that the base lacks.

    ``base`` is sorted. A value is costed once, however many contexts lie in it.
    """
    low = text.lower()
    if not any(s in low for s in STEMS):
        return []
    starts = [s.start for s in base]
    reach = list(accumulate((s.end for s in base), max))
    found: list[Span] = []
    at = end = trimmed = 0
    costed = False
    while m := CONTEXT.search(text, at):
        # A value that is none may be the word before another one.
        a = at = m.end()
        if a >= end:
            value = VALUE.match(text, a)
            end, trimmed, costed = value.end(), a + len(value[0].rstrip(AFTER)), False
        before = bisect_left(starts, trimmed)
        # What ends a value that takes few guesses takes few.
        if costed or trimmed <= a or before and reach[before - 1] > a:
            continue
        costed = True
        if least_guesses(text[a:trimmed], words) >= guesses:
            found.append(Span(a, 3, trimmed))
            at = end
    return found


SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_assign", pa.int64()),
        ("n_access", pa.int64()),
        ("n_hex", pa.int64()),
        ("base_sha256", pa.string()),
        ("spans", pa.string()),
    ]
)


def scan(docs: DataFrame, words: Words = WORDS, guesses: float = GUESSES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    ``words`` has the rank of each word that attackers try; it is broadcast, so it should be a list
    that someone has written and not grow with the documents.
    """
    held = docs.sparkSession.sparkContext.broadcast(words)

    def make():
        known = held.value

        def apply(rows: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {n: [] for n in SCHEMA.names}
            for doc_id, text in zip(rows["doc_id"], rows["text"], strict=True):
                base = base_spans(text or "")
                more = guessed_spans(text or "", base, known, guesses)
                counts = [sum(s.rank == k for s in base) for k in range(3)]
                told = hashlib.sha256(",".join(map(str, base)).encode()).hexdigest()
                row = (doc_id, *counts, told, ",".join(map(str, sorted(base + more))))
                for n, v in zip(SCHEMA.names, row, strict=True):
                    out[n].append(v)
            return out

        return apply

    ddl = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return map_slices(docs.select(F.col("doc_id").cast("long"), "text"), make, SCHEMA, ddl)
