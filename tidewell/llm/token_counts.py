"""Token counts by a map-side two-tier lookup.

A text is cut into pre-tokens at places that no vocabulary entry crosses, so the
number of its tokens is the sum over its pre-tokens. The first tier is a
broadcast table of the lengths of frequent pre-tokens, the second a cache in
each worker; what misses both is encoded by the library. Pre-tokens are never
shuffled.

Null texts count as empty. Repeated rows are counted each, and texts of any length whole. An empty table gives no
rows. A text that the cut can't be proven right for (it
holds the library's own space mark) goes to the library whole.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import map_slices

MARK = "▁"
#: A run of spaces with the word after it, for texts with more than single spaces.
RUNS = re.compile(r" +[^ ]*|[^ ]+")
#: Texts, and their length, that the table of frequent pre-tokens is taken from. The table
#: changes speed only: whatever it lacks is encoded by the workers.
TABLE_ROWS, TABLE_CHARS = 2000, 10_000
TABLE_SIZE = 65536
#: Entries of a worker's cache; a full cache starts anew.
CACHE_SIZE = 400_000

_CODERS: dict[str, object] = {}
_COUNTERS: dict[str, TokenCounter] = {}


def coder(path: str):
    if path not in _CODERS:
        import sentencepiece

        _CODERS[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _CODERS[path]


def crossing(model) -> bool:
    """Whether a vocabulary entry has the space mark after another character, or a line feed."""
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces)


#: Characters that normal forms, folding of case or of blanks would change.
CHANGEABLE = "A  Ｂ ﬁ ① e\u0301 \u3000 \u00a0 ² \u200b K Ǆ x"


def changing(model) -> bool:
    """Whether the model changes characters before it cuts a text, so that a word's tokens depend on more than the word."""
    return model.normalize(CHANGEABLE) != MARK + CHANGEABLE.replace(" ", MARK)


def pretokens(text: str) -> list[str]:
    """Cut ``text``, which has no line feed, into words that carry the spaces before them.

    The first word carries the space that the library puts before a text.
    """
    text = " " + text
    if "  " in text or text[-1] == " ":
        return RUNS.findall(text)
    return [" " + w for w in text[1:].split(" ")]


def closers(model) -> str:
    """``.,`` if no vocabulary entry has one of them behind a letter, else nothing.

    A tail of them behind a letter is then cut off without a token being split.
    """
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_byte(i)]
    joined = any(a.isalpha() and b in ".," for p in pieces for a, b in zip(p, p[1:], strict=False))
    return "" if joined else ".,"


class TokenCounter:
    """Counts tokens through the two tiers. One for each worker process."""

    def __init__(self, path: str, table: tuple[str, bytes]):
        words, lengths = table
        self.model = coder(path)
        self.closers = closers(self.model)
        self.known: dict[str, int] = dict(zip(words.split("\n") if words else [], lengths, strict=True))
        self.hold = dict(self.known)
        size = self.model.get_piece_size()
        self.starts = np.array([self.model.id_to_piece(i).startswith(MARK) for i in range(size)])
        self.after_feed = len(self.model.encode("\n"))

    def lengths(self, words: list[str]) -> list[int]:
        """Lengths of pre-tokens by the library.

        Words with one space before them go in one text: each begins with the
        only piece of it that has the space mark. The rest go one by one; a word
        at a line's start is measured behind a line feed.
        """
        found = dict.fromkeys(words, 0)
        plain = [w for w in words if w[0] == " " and len(w) > 1 and w[1] != " "]
        if plain:
            ids = np.array(self.model.encode("".join(plain)[1:]))
            ends = np.append(np.flatnonzero(self.starts[ids])[1:], len(ids))
            found.update(zip(plain, np.diff(ends, prepend=0).tolist(), strict=True))
        for w in words:
            if w[0] == "\n":
                found[w] = len(self.model.encode(w)) - self.after_feed
            elif not found[w]:
                found[w] = len(self.model.encode(w[1:])) if len(w) > 1 else 1
        return list(found.values())

    def count(self, text: str) -> int:
        if not text:
            return 0
        if MARK in text or "\0" in text:
            return len(self.model.encode(text))
        lines = text.split("\n")
        # A line feed is one token of its own, and no space is put after it.
        total = len(lines) - 1
        words = pretokens(lines[0]) if lines[0] else [" "]
        for line in lines[1:]:
            head, gap, rest = line.partition(" ")
            if head:
                words.append("\n" + head)
                words += pretokens(rest) if gap and rest else [" "] if gap else []
            elif line:
                words += RUNS.findall(line)
        found = list(map(self.hold.get, words))
        if None not in found:
            return total + sum(found)
        total += sum(filter(None, found))
        return total + self.encoded([w for w, n in zip(words, found, strict=True) if n is None])

    def encoded(self, missing: list[str]) -> int:
        total = 0
        fresh: Counter[str] = Counter()
        for w in missing:
            core = w.rstrip(self.closers) if self.closers else w
            if len(core) < len(w) and core[-1:].isalpha():
                # The tail is a word of its own that has no space before it.
                for part in (core, "\n" + w[len(core) :]):
                    n = self.hold.get(part)
                    if n is None:
                        fresh[part] += 1
                    else:
                        total += n
            else:
                fresh[w] += 1
        if len(self.hold) + len(fresh) > CACHE_SIZE:
            self.hold = dict(self.known)
        for (w, k), n in zip(fresh.items(), self.lengths(list(fresh)), strict=True):
            self.hold[w] = n
            total += n * k
        return total


def frequent(docs: DataFrame, path: str, rows: int = TABLE_ROWS, size: int = TABLE_SIZE) -> tuple[str, bytes]:
    """The compact table: pre-tokens in one string, their lengths in one array.

    Taken from about ``rows`` texts that a hash chooses over all rows, of long ones from their
    beginning; bounded by ``size`` entries.
    """
    counts: Counter[str] = Counter()
    share = min(1.0, rows / max(1, docs.count()))
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # Rows that are repeated hash alike: no more than twice the texts come to the driver even so.
    for (text,) in chosen.where(F.length("text") > 0).select(F.substring("text", 1, TABLE_CHARS)).take(2 * rows):
        if MARK not in text and "\0" not in text:
            for line in text.split("\n"):
                counts.update(pretokens(line))
    words = [w for w, n in counts.most_common(size) if n > 1 and w.strip(" ")]
    lengths = TokenCounter(path, ("", b"")).lengths(words)
    fit = [(w, n) for w, n in zip(words, lengths, strict=True) if n < 256]
    return "\n".join(w for w, _ in fit), np.array([n for _, n in fit], dtype=np.uint8).tobytes()


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    Null and empty texts have no bytes and no tokens. Repeated rows are counted
    each; other columns of ``docs`` are not read.
    """
    if crossing(coder(path)) or changing(coder(path)):
        raise ValueError("this vocabulary joins words, or its normaliser changes them: the cut into pre-tokens would not be exact")
    held = docs.sparkSession.sparkContext.broadcast(frequent(docs, path))

    def make():
        if path not in _COUNTERS:
            _COUNTERS[path] = TokenCounter(path, held.value)
        count = _COUNTERS[path].count

        def apply(rows: dict[str, list]) -> dict[str, list]:
            texts = [t or "" for t in rows["text"]]
            return {
                "doc_id": rows["doc_id"],
                "n_bytes": [len(t) if t.isascii() else len(t.encode()) for t in texts],
                "n_tokens": [count(t) for t in texts],
            }

        return apply

    out = map_slices(
        docs.select(F.col("doc_id").cast("long"), "text"), make, SCHEMA, "doc_id long, n_bytes long, n_tokens long"
    )
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
