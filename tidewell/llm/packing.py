"""Best-fit packing of documents into token sequences by minimum bin slack.

The bins are planned on the histogram of piece lengths, which has at most
``capacity`` entries however many documents there are. For each bin, a bitset
subset-sum over the lengths still available finds the fullest combination that
goes with the longest of them; the combination is then removed, as often as
the histogram holds it. The plan is a list of such combinations. A piece finds
its place in it by its rank among the pieces of its length, so no task ever
sees more than its own rows.

The order of the documents takes effect where a window is given: then the pieces of so many
neighbours in the input are packed by themselves, with a plan of their own, and sequences are numbered along the
input. A sequence holds pieces of one window only.

Null and empty texts become a piece with the end id alone. Repeated rows are
packed each, and rows without a doc_id too. Texts of any length are cut whole. An empty table gives no rows.
Other columns, whatever their names, play no part.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import ORDER, in_order, map_slices, materialise, numbered, positions, ranked

#: A text of nothing but these can be lower-cased and cut by the standard library's
#: expressions just as the tokenizer does it: ASCII without most controls, and
#: the letters of Latin-1. No mark in it composes with another.
PLAIN = re.compile(r"[^\t\n\r -~À-ÖØ-öø-ÿ]|<\|")
#: How the vocabulary's tokenizer cuts lower-cased text. Fixed values of its file.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:_|[^\w\s])+")
CACHE_SIZE = 400_000

_ENCODERS: dict[str, Encoder] = {}


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if it
    prints in Latin-1, else the next free one from U+0100."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in prints else next(rest)) for b in range(256)]


class Encoder:
    """Token ids of texts as little-endian bytes, words through a cache. One for each worker."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = dict(enumerate(byte_letters()))
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        if PLAIN.search(text):
            ids = self.whole.encode(text, add_special_tokens=False).ids
            return np.array(ids, dtype="<u4").tobytes()
        # No word has a blank in it, so what lies between blanks is cut by itself.
        chunks = text.lower().split()
        found = list(map(self.chunks.get, chunks))
        if None in found:
            for cache in (self.chunks, self.words):
                if len(cache) > CACHE_SIZE:
                    cache.clear()
            for i, (c, ids) in enumerate(zip(chunks, found, strict=True)):
                if ids is None:
                    found[i] = self.chunk(c)
        return b"".join(found)

    def chunk(self, chunk: str) -> bytes:
        """Ids of what lies between blanks. It is kept once its words are known, so that rare ones don't fill the cache."""
        words = WORDS.findall(chunk)
        found = list(map(self.words.get, words))
        if None not in found:
            ids = self.chunks[chunk] = b"".join(found)
            return ids
        for i, w in enumerate(words):
            if found[i] is None:
                found[i] = self.words[w] = self.word(w)
        return b"".join(found)

    def word(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return struct.pack(f"<{len(ids := [t.id for t in self.model.tokenize(word)])}I", *ids)


SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
    ]
)
DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"
def pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """Tokenize, end each document with ``end_id`` and cut what is longer than ``capacity``. Keeps further columns, of longs."""
    schema = pa.schema([*SCHEMA, *((c, pa.int64()) for c in keep)])
    end = np.array([end_id], dtype="<u4").tobytes()

    def make():
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        encode = _ENCODERS[path].encode

        def apply(rows: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {n: [] for n in schema.names}
            for doc_id, text, *place in zip(*(rows[n] for n in ("doc_id", "text", *keep)), strict=True):
                ids = encode(text or "") + end
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row = (doc_id, i, at // 4, len(part) // 4, zlib.crc32(part), *place)
                    for n, v in zip(schema.names, row, strict=True):
                        out[n].append(v)
            return out

        return apply

    slim = docs.select(F.col("doc_id").cast("long"), "text", *keep)
    return map_slices(slim, make, schema, DDL + "".join(f", {c} long" for c in keep))


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How often to take which length, so that their sum is the largest up to ``room``.

    The bits of ``reach`` are the sums that the lengths so far can make. Longer
    lengths come first, and the search ends when ``room`` itself is reached.
    """
    mask = (1 << (room + 1)) - 1
    reach = 1
    steps: list[tuple[int, int]] = []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        steps.append((length, reach))
        left, take = min(counts[length], room // length), 1
        while left > 0:
            use = min(take, left)
            reach |= (reach << (use * length)) & mask
            left -= use
            take *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, before in reversed(steps):
        uses = 0
        while not before >> total & 1:
            total -= length
            uses += 1
        if uses:
            chosen[length] = uses
    return chosen


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Combinations of lengths and the number of bins that each fills, by minimum bin slack.

    Each step uses up a length, but for fewer pieces than the step's bin takes of
    it, so the number of steps is bounded by the capacity and not by the pieces.
    """
    left = dict(counts)
    out = []
    while left:
        longest = max(left)
        others = dict(left)
        others[longest] -= 1
        chosen = fullest({k: n for k, n in others.items() if n}, capacity - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        bins = min(left[k] // n for k, n in chosen.items())
        for k, n in chosen.items():
            left[k] -= n * bins
            if not left[k]:
                del left[k]
        out.append((chosen, bins))
    return out


#: A length's ranks stand behind it in the keys of the plan's table.
RANKS = 1 << 45


def places(combinations: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """The plan as a table sorted by (length, first rank): key, first bin, uses a bin, offset."""
    taken: dict[int, int] = {}
    rows, bin_no = [], 0
    for chosen, bins in combinations:
        offset = 0
        for length, uses in chosen.items():
            first = taken.get(length, 0)
            rows.append((length * RANKS + first, bin_no, uses, offset))
            taken[length] = first + uses * bins
            offset += uses * length
        bin_no += bins
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def located(table: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each piece, by its length and its rank among the pieces of that length."""
    keys, bins, uses, offsets = table.T
    at = np.searchsorted(keys, length * RANKS + rank, side="right") - 1
    nth = length * RANKS + rank - keys[at]
    return bins[at] + nth // uses[at], offsets[at] + nth % uses[at] * length


OUT = pa.schema([*SCHEMA, ("sequence_id", pa.int64()), ("offset", pa.int64())])
OUT_DDL = DDL + ", sequence_id long, offset long"


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, window: int | None = None) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The pieces of a sequence lie behind one another from offset 0 without gaps. With a ``window``, each
    ``window`` pieces that follow one another in the input fill sequences of their own.
    """
    if window is None:
        return packed(materialise(pieces(docs, path, capacity, end_id), "pieces"), capacity)
    return packed_in_windows(materialise(pieces(in_order(docs), path, capacity, end_id, ORDER), "pieces"), capacity, window)


def packed(cut: DataFrame, capacity: int) -> DataFrame:
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}
    table = cut.sparkSession.sparkContext.broadcast(places(plan(counts, capacity)))

    def make():
        def apply(rows: dict[str, list]) -> dict[str, list]:
            length, rank = (np.array(rows[n], dtype=np.int64) for n in ("length", "rank"))
            bins, offsets = located(table.value, length, rank)
            return {n: rows[n] for n in SCHEMA.names} | {"sequence_id": bins, "offset": offsets}

        return apply

    return map_slices(ranked(cut, "length", ["doc_id", "piece"], "rank"), make, OUT, OUT_DDL)


def packed_in_windows(cut: DataFrame, capacity: int, window: int) -> DataFrame:
    """The same for windows of the input: each has at most ``window`` rows, so a group is bounded."""
    # Numbered once and stored, so that every later step sees the same positions.
    cut = materialise(positions(cut, [*ORDER, "piece"], "_at").drop(*ORDER), "positions")
    placed = numbered(cut, "_at", "_position").withColumn("_window", F.expr(f"_position div {window}"))

    def fill(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values("_position")
        rank = pieces.groupby("length").cumcount().to_numpy()
        table = places(plan(pieces["length"].value_counts().to_dict(), capacity))
        bins, offsets = located(table, pieces["length"].to_numpy(), rank)
        # Sequences come by the first of their pieces.
        _, first, nth = np.unique(bins, return_index=True, return_inverse=True)
        along = np.argsort(np.argsort(first))[nth]
        out = pieces[SCHEMA.names]
        return out.assign(sequence_id=pieces["_window"].to_numpy() * window + along, offset=offsets)

    return placed.groupBy("_window").applyInPandas(fill, OUT_DDL)
