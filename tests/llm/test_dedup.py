"""Line dedup and SimHash near-dedup."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tests.llm.helpers import BLANKS, ascii_lower, documents, empty, rows_of, texts
from tests.oracle import SF, assert_same
from tidewell.llm import line_dedup, simhash
from tidewell.llm.queries import ORACLE_SQL, QUERIES


def kept_lines(docs: dict) -> dict:
    holders = defaultdict(set)
    key = lambda line: ascii_lower(line.strip(BLANKS))
    for i, t in docs.items():
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    gone = lambda i, k: len(k) >= 10 and len(holders[k]) > 1 and min(holders[k]) < i
    return {i: [x for x in (t or "").split("\n") if not gone(i, key(x))] for i, t in docs.items()}


def test_lines(spark):
    docs = dict(enumerate(texts()))
    rows = rows_of(line_dedup.digests(documents(spark)))
    wanted = [(i, len((docs[i] or "").split("\n")), len((docs[i] or "").split("\n")) - len(k), hashlib.sha256("\n".join(k).encode()).hexdigest()) for i, k in kept_lines(docs).items()]
    last = texts().index("x" * 5000)
    assert [r for r in rows if r[0] is not None] == sorted([*wanted, wanted[last]], key=repr)
    assert line_dedup.digests(empty(spark)).collect() == []


def test_many_lines_of_a_document(spark):
    """Positions beyond a bitmap's first words, and a line that most documents hold."""
    r = random.Random(3)
    pool = [f"line number {n} of the pool" for n in range(400)]
    docs = {i: "\n".join(["a line that all of them hold", *(r.choice(pool) for _ in range(300))]) for i in range(40)}
    rows = line_dedup.digests(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    want = kept_lines(docs)
    assert {r["doc_id"]: r["kept_sha256"] for r in rows} == {i: hashlib.sha256("\n".join(k).encode()).hexdigest() for i, k in want.items()}


def test_deduplicated_documents(spark):
    docs = documents(spark)
    out = line_dedup.deduplicated(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    want = kept_lines(dict(enumerate(texts())))
    for r in out.where("doc_id IS NOT NULL").collect():
        if texts()[r["doc_id"]] is None:
            assert r["text"] is None
        else:
            assert r["text"] == "\n".join(want[r["doc_id"]]) and r["n_chars"] == len(r["text"])


def test_sql(spark):
    assert_same(QUERIES["op6_line_dedup"](spark, SF), ORACLE_SQL["op6_line_dedup"])


def test_main_path_has_no_python(spark):
    plan = line_dedup.digests(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval|MapInArrow", plan)


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(fps: list[int], least: list) -> list:
    """component_id by comparing all pairs."""
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(fps)):
        groups[find(i)].append(least[i])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(fps))]


def test_fingerprints_and_components(spark):
    rows = simhash.near_duplicates(documents(spark)).collect()
    fps = [int(r["fingerprint"], 16) for r in rows]
    for r in rows:
        if r["doc_id"] is not None:
            assert int(r["fingerprint"], 16) == fingerprint(texts()[r["doc_id"]])
    assert [r["component_id"] for r in rows] == linked(fps, [r["doc_id"] for r in rows])
    assert simhash.near_duplicates(empty(spark)).collect() == []


def test_long_texts_in_blocks(monkeypatch):
    wanted = fingerprint(texts()[6])
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprint(texts()[6]) == wanted


@pytest.mark.parametrize(("seed", "crowded"), [(0, 64), (1, 64), (0, 1), (1, 1), (2, 2), (3, 4)])
def test_no_link_is_lost(spark, seed, crowded, monkeypatch):
    """Fingerprints at all distances around a few centres, in every segment; buckets are cut by pieces or not."""
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    r = random.Random(seed)
    fps = set()
    for _ in range(12):
        centre = r.getrandbits(64)
        for d in (0, 1, 2, 3, 4, 4, 4, 5, 5, 6):
            fps.add(centre ^ sum(1 << b for b in r.sample(range(64), d)))
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    counted = spark.createDataFrame([(f, r.randint(1, 3)) for f in signed], "fp long, n long")
    pairs = [tuple(p) for p in simhash.links(counted).collect()]
    distance = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    assert len(set(pairs)) == len(pairs) and all(a > b and distance(a, b) <= 4 for a, b in pairs)
    assert joined(signed, pairs) == joined(signed, [(a, b) for a in signed for b in signed if a > b and distance(a, b) <= 4])


def test_crowded_buckets_are_cut(spark, monkeypatch):
    """Few bits of the first segment vary, so its buckets are as full as in a large corpus: the same links from far fewer comparisons."""
    r = random.Random(4)
    fps = {sum(1 << b for b in [*range(0, 21, 3), *range(21, 64)] if r.random() < 0.5) for _ in range(1000)}
    fps |= {f ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 4))) for f in sorted(fps)[::3]}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f, 1) for f in signed], "fp long, n long")
    found, met = [], []
    for crowded in (10**9, 8):
        monkeypatch.setattr(simhash, "CROWDED", crowded)
        found.append(joined(signed, [tuple(p) for p in simhash.links(nodes).collect()]))
        keys = simhash.variants(nodes)
        members = keys.join(keys.groupBy("key").count().withColumnRenamed("count", "members"), "key")
        sizes = [simhash.cut(members).groupBy("key", "piece", "part").count(), members.where(f"members <= {crowded}").groupBy("key").count()]
        met.append(sum(s.selectExpr("coalesce(sum(count * count), 0)").first()[0] for s in sizes))
    distance = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    assert found[0] == found[1] == joined(signed, [(a, b) for a in signed for b in signed if a > b and distance(a, b) <= 4])
    assert met[1] < met[0] / 2, met


def joined(nodes: list[int], pairs: list[tuple[int, int]]) -> dict[int, int]:
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return least


def test_a_group_of_copies_gives_a_star(spark):
    """300 fingerprints within two bits of the most frequent one: links to it, not all 44,850 pairs."""
    r = random.Random(9)
    centre = r.getrandbits(63)
    fps = {centre}
    while len(fps) < 300:
        fps.add(centre ^ 1 << r.randrange(63) ^ 1 << r.randrange(63))
    counted = spark.createDataFrame([(f, 9 if f == centre else 1) for f in fps], "fp long, n long")
    pairs = [tuple(p) for p in simhash.links(counted).collect()]
    assert len(set(joined(sorted(fps), pairs).values())) == 1 and len(pairs) < 10 * len(fps)


def test_components_of_chains(spark):
    r = np.random.default_rng(1)
    order = r.permutation(60).tolist()
    edges = [(a, b) for chain in (order[:25], order[25:40], order[40:]) for a, b in zip(chain, chain[1:], strict=False)]
    rooted = simhash.components(spark.createDataFrame([(max(e), min(e)) for e in edges], "a long, b long")).collect()
    want = {n: min(chain) for chain in (order[:25], order[25:40], order[40:]) for n in chain}
    assert {x["node"]: x["root"] for x in rooted} == want and len(rooted) == 60


def test_representatives(spark):
    docs = documents(spark)
    near = simhash.near_duplicates(docs).collect()
    out = simhash.representatives(docs)
    assert out.columns == docs.columns
    kept = [r["doc_id"] for r in out.collect()]
    assert sorted(k for k in kept if k is not None) == sorted({r["component_id"] for r in near if r["component_id"] is not None})
    assert kept.count(None) == 1
