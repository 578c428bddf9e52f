from __future__ import annotations

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import documents, empty, texts
from tidewell.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text() | st.text(alphabet="aB é'sdlv<|12_.\n\t"))
def test_ids_are_the_librarys(library, value):
    ids = np.frombuffer(packing._ENCODERS.setdefault(PATH, packing.Encoder(PATH)).encode(value), dtype="<u4").tolist()
    assert ids == library.encode(value, add_special_tokens=False).ids


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=6), st.integers(0, 40))
def test_fullest(counts, room):
    def sums(left):
        return {sum(c) for c in itertools.product(*([k * i for i in range(n + 1)] for k, n in left.items()))}

    chosen = packing.fullest(counts, room)
    assert all(n <= counts[k] for k, n in chosen.items())
    assert sum(k * n for k, n in chosen.items()) == max(s for s in sums(counts) if s <= room)


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_plan_uses_each_piece_once(counts):
    plan = packing.plan(counts, 64)
    used = Counter()
    for chosen, bins in plan:
        assert sum(k * n for k, n in chosen.items()) <= 64
        for k, n in chosen.items():
            used[k] += n * bins
    assert used == Counter(counts)
    # Not far from first-fit decreasing even on a few pieces of odd lengths.
    bins: list[int] = []
    for k in sorted(Counter(counts).elements(), reverse=True):
        at = next((i for i, b in enumerate(bins) if b + k <= 64), None)
        if at is None:
            bins.append(k)
        else:
            bins[at] += k
    assert sum(b for _, b in plan) <= 1.25 * len(bins) + 1


@pytest.mark.parametrize(("capacity", "window"), [(4096, None), (50, None), (4096, 4096), (50, 7), (50, 100)])
def test_pack(spark, library, capacity, window):
    docs = documents(spark)
    rows = packing.pack(docs, PATH, capacity, window=window).collect()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    for i, t in enumerate(texts()[:-1]):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        cut = [ids[a : a + capacity] for a in range(0, len(ids), capacity)]
        got = sorted(by_doc[i], key=lambda r: r["piece"])
        told = [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got]
        assert told == [(p, p * capacity, len(c), zlib.crc32(np.array(c, dtype="<u4").tobytes())) for p, c in enumerate(cut)]
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in sequences.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= capacity
    lower = -(-sum(r["length"] for r in rows) // capacity)
    assert lower <= len(sequences) <= lower * 1.1 + 1 + (len(rows) / window if window else 0)
    last = len(texts()) - 1
    assert len(by_doc[last]) == 2 * len({r["piece"] for r in by_doc[last]}) and len(by_doc[None]) >= 1


def test_the_order_of_the_input_takes_effect(spark, tmp_path):
    """Sequences follow the rows as they were written, also where file sizes would turn them round."""
    words = ["a b c d", "e f g h " * 3, "i j k l " * 5]
    rows = [(i, words[i * 7 % 3].strip()) for i in range(300)]
    r = random.Random(1)
    for given in (rows, rows[::-1], r.sample(rows, len(rows))):
        folder = f"{tmp_path}/{given[0][0]}"
        docs = spark.createDataFrame([(n, *row, "x" * n * n) for n, row in enumerate(given)], "n int, doc_id long, text string, more string")
        docs.repartitionByRange(5, "n").sortWithinPartitions("n").write.option("maxRecordsPerFile", 17).parquet(folder)
        found = packing.pack(spark.read.parquet(folder), PATH, 21, window=20).collect()
        place = {i: n for n, (i, _) in enumerate(given)}
        held = defaultdict(list)
        for x in found:
            held[x["sequence_id"]].append(place[x["doc_id"]])
        assert len(found) == len(rows)
        # A sequence has neighbours only, and sequences come by the first row that they hold in each window.
        assert all(min(v) // 20 == max(v) // 20 for v in held.values())
        firsts = [min(held[s]) for s in sorted(held)]
        assert firsts == sorted(firsts)


def test_empty(spark):
    assert packing.pack(empty(spark), PATH).collect() == []
