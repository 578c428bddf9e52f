"""Mixing of sources, and the pipeline."""

from __future__ import annotations

import random
from collections import Counter
from fractions import Fraction

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tests.llm.helpers import documents, empty
from tests.oracle import SF
from tidewell.llm import mixing

WEIGHTS = st.dictionaries(st.sampled_from("abcdef"), st.integers(1, 9), min_size=1)


@given(WEIGHTS)
def test_a_period_strays_by_less_than_a_block(weights):
    whole = sum(weights.values())
    slots = mixing.period(weights)
    assert Counter(slots) == Counter(weights)
    had = Counter()
    for t, s in enumerate(slots, 1):
        had[s] += 1
        assert all(abs(had[x] - Fraction(t * w, whole)) < 1 for x, w in weights.items())


@given(WEIGHTS, st.dictionaries(st.sampled_from("abcdef"), st.integers(0, 40), min_size=1))
def test_schedule_places_all_blocks_and_keeps_weights_in_each_phase(weights, blocks):
    weights = {s: weights.get(s, 1) for s in blocks}
    plan = mixing.schedule(blocks, weights)
    got = {}
    for s, phases in plan.items():
        for b in range(blocks[s]):
            first, slot, shares, whole, at = [p for p in phases if p[0] <= b][-1]
            got[slot + (b - first) // shares * whole + at[(b - first) % shares]] = (s, b)
    assert sorted(got) == list(range(sum(blocks.values())))
    for s, n in blocks.items():
        assert [b for _, (x, b) in sorted(got.items()) if x == s] == list(range(n))
    starts = sorted({p[1] for phases in plan.values() for p in phases})
    for start, end in zip(starts, [*starts[1:], len(got)], strict=False):
        live = {s: weights[s] for s, phases in plan.items() if any(p[1] == start for p in phases)}
        # A phase has all sources that have blocks left, by their weights.
        assert set(live) == {got[i][0] for i in range(start, len(got))}
        had = Counter()
        for t in range(start, end):
            had[got[t][0]] += 1
            assert all(abs(had[s] - Fraction((t - start + 1) * w, sum(live.values()))) < 1 for s, w in live.items())


def test_slots(spark):
    r = random.Random(0)
    sources = [r.choice(["a"] * 6 + ["b", "c", "d", None]) for _ in range(900)]
    docs = spark.createDataFrame([(i, s, i) for i, s in enumerate(sources)], "doc_id long, source string, slot long")
    rows = mixing.slots(docs, {"a": 2, "b": 1, "*": 3}, ["doc_id"], block=4).collect()
    assert sorted(x["doc_id"] for x in rows) == list(range(900))
    assert len({x["position"] for x in rows}) == 900 and all(x["position"] // 4 == x["slot"] for x in rows)
    blocks = Counter((x["group"], x["block"]) for x in rows)
    assert max(blocks.values()) == 4 and len({(x["slot"]) for x in rows}) == len(blocks)
    first = {x["slot"]: x["group"] for x in rows if x["phase"] == 0}
    had = Counter()
    for t in range(max(first) + 1):
        had[first[t]] += 1
        assert all(abs(had[s] - (t + 1) * w / 6) < 1 for s, w in (("a", 2), ("b", 1), ("*", 3)))


def test_edges(spark):
    docs = documents(spark)
    assert mixing.slots(docs, {"src0": 3}, ["doc_id"]).count() == docs.count()
    assert mixing.slots(empty(spark), {"src0": 3}, ["doc_id"]).collect() == []
    with pytest.raises(ValueError):
        mixing.slots(docs, {"src0": 0}, ["doc_id"])


def test_mixed_rows_are_all_there_in_order(spark):
    docs = documents(spark)
    out = mixing.mixed(docs, {"src0": 3}, block=2)
    assert out.columns == docs.columns
    assert sorted(map(repr, out.collect())) == sorted(map(repr, docs.collect()))
    place = {r["doc_id"]: r["position"] for r in mixing.slots(docs.dropDuplicates(["doc_id"]), {"src0": 3}, ["doc_id"], 2).collect()}
    assert place.keys() == {r["doc_id"] for r in docs.collect()}
    groups = ["src0" if r["source"] == "src0" else "*" for r in mixing.mixed(docs.dropDuplicates(["doc_id"]), {"src0": 1}, block=1).collect()]
    assert all(abs(groups[:n].count("src0") - n / 2) < 1 for n in range(1, 2 * min(groups.count("src0"), groups.count("*"))))


def test_pipeline(spark):
    """The stages by the brute-force versions of their operators' tests."""
    import corpus_pipeline
    from tests.llm.test_dedup import fingerprint, kept_lines, linked
    from tidewell.llm import packing, quality_rules

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = dict(docs.select("doc_id", "text").collect())
    kept = {r["doc_id"] for r in quality_rules.judge(docs).where("kept").collect()}
    text = {i: "\n".join(k) for i, k in kept_lines({i: t for i, t in text.items() if i in kept}).items()}
    ids = sorted(text)
    named = linked([fingerprint(text[i]) for i in ids], ids)
    left = {i: text[i] for i, c in zip(ids, named, strict=True) if i == c}
    encode = packing.Encoder(corpus_pipeline.tokenizer(corpus_pipeline.WORD_BPE)).encode
    wanted = {i: len(encode(t)) // 4 + 1 for i, t in left.items()}
    rows = corpus_pipeline.run(spark, SF).collect()
    got = Counter()
    for r in rows:
        got[r["doc_id"]] += r["length"]
    assert got == Counter(wanted)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash", "mixing", "packing"]


def test_pipeline_packs_in_the_order_of_the_mix(spark, monkeypatch):
    import corpus_pipeline

    found = []
    for weights in ({"src0": 99, "*": 1}, {"src0": 1, "*": 99}):
        monkeypatch.setattr(corpus_pipeline, "WEIGHTS", weights)
        monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[-2:])
        found.append(corpus_pipeline.run(spark, SF).collect())
    contents = [Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rows) for rows in found]
    assert contents[0] == contents[1]
    of = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source").collect()}
    means = []
    for rows in found:
        at = [r["sequence_id"] for r in rows if of[r["doc_id"]] == "src0"]
        means.append(sum(at) / len(at))
    assert means[0] < means[1]


def test_sequences_follow_the_weights(spark, tmp_path):
    """In any prefix of sequences a source's share of pieces is its weight's to within a window and a block, while sources last;
    files that are dealt anew on the way in change nothing."""
    from tidewell.llm import packing
    from tidewell.llm.queries import WORD_BPE, tokenizer

    r = random.Random(3)
    rows = [(i, "word " * r.randint(3, 40), "en", f"s{0 if i % 2 else i % 3}", 1) for i in range(3000)]
    weights = {"s0": 2, "s1": 1, "s2": 1}
    of, window, block = {x[0]: x[3] for x in rows}, 50, 4
    found = []
    for n, given in enumerate((rows, r.sample(rows, len(rows)))):
        docs = spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars int").repartition(3 + 4 * n)
        mixing.mixed(docs, weights, block).write.parquet(f"{tmp_path}/{n}")
        mixed = spark.read.parquet(f"{tmp_path}/{n}")
        found.append(sorted(tuple(x) for x in packing.pack(mixed, tokenizer(WORD_BPE), 128, window=window).select("sequence_id", "doc_id", "offset").collect()))
    assert found[0] == found[1]
    least = min(Counter(of.values()).values())
    had, placed = Counter(), 0
    for _, doc_id, _ in found[0]:
        had[of[doc_id]] += 1
        placed += 1
        if placed <= 2 * least:
            assert all(abs(had[s] - placed * w / 4) <= window + block for s, w in weights.items())
    assert placed == 3000


def test_each_source_of_the_table_has_its_own_deadlines(spark):
    from tidewell.llm.queries import QUERIES

    rows = QUERIES["op8_mixing"](spark, SF.replace("0.001", "0.01")).collect()
    assert all(r["group"] == r["source"] for r in rows) and len({r["doc_id"] for r in rows}) == len(rows)
    named = {"src0": 5, "src1": 3, "src2": 2}
    sources = {r["source"] for r in rows}
    shares = {s: Fraction(named.get(s, Fraction(10, len(sources) - 3)), 20) for s in sources}
    first = {r["slot"]: r["source"] for r in rows if r["phase"] == 0}
    had = Counter()
    for t in range(max(first) + 1):
        had[first[t]] += 1
        assert all(abs(had[s] - (t + 1) * share) < 1 for s, share in shares.items())


def test_weights_by_source(spark, monkeypatch):
    sources = ["a"] * 5 + ["b"] * 3 + ["c"] * 2 + ["d"]
    docs = spark.createDataFrame([(s,) for s in sources], "source string")
    assert mixing.by_source(docs, {"a": 2, "*": 3}) == {"a": 6, "b": 3, "c": 3, "d": 3, "*": 3}
    assert mixing.by_source(docs.union(spark.createDataFrame([(None,)], "source string")), {"a": 2, "*": 3})["a"] == 8
    monkeypatch.setattr(mixing, "MOST_SOURCES", 4)
    assert mixing.by_source(docs, {"a": 2, "*": 3}) == {"a": 4, "b": 3, "*": 3}
    assert mixing.by_source(empty(spark), {"a": 2}) == {"a": 2, "*": 1}
