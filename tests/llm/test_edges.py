"""Very long texts and lines, repeated rows, clashing columns and empty tables, for the operators that share them."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import SCHEMA, documents, empty
from tests.oracle import SF
from tidewell.llm import common, line_dedup, media, mixing, packing, quality_classifier, simhash, token_counts
from tidewell.storage import discard, materialise

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def long_texts() -> list[str]:
    r = random.Random(8)
    prose = " ".join(r.choice("the river runs under an old stone bridge and été wörter".split()) for _ in range(300_000))
    return [prose, prose, "y" * 1_000_000, "\n".join(f"line number {i % 999} of a long text" for i in range(60_000)), "z " * 500_000]


@pytest.fixture(scope="module")
def long_docs(spark):
    rows = [(i, t, "en", "src0", len(t), "k", 1, "p", 2) for i, t in enumerate(long_texts())]
    return spark.createDataFrame(rows, SCHEMA)


def test_slices_are_bounded_in_rows_and_bytes():
    sizes = [3_000_000 if i in (5, 6, 300) else 10 for i in range(600)]
    batch = pa.RecordBatch.from_pydict({"n": list(range(600)), "t": ["x" * s if i % 7 else None for i, s in enumerate(sizes)]})
    parts = list(common.slices(batch))
    assert [n for p in parts for n in p.column("n").to_pylist()] == list(range(600))
    for p in parts:
        held = sum(len(t or "") for t in p.column("t").to_pylist())
        assert p.num_rows <= common.SLICE and (held <= common.SLICE_BYTES or p.num_rows == 1)
    assert list(common.slices(batch.slice(0, 0))) == []


def test_packing_of_long_texts(spark, long_docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    rows = packing.pack(long_docs, WORDS, 4096).collect()
    for i, t in enumerate(long_texts()):
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        got = sorted((r["piece"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == i)
        cut = [ids[a : a + 4096] for a in range(0, len(ids), 4096)]
        assert got == [(p, len(c), zlib.crc32(np.array(c, dtype="<u4").tobytes())) for p, c in enumerate(cut)]


def test_counts_of_long_texts(spark, long_docs):
    model = token_counts.coder(PIECES)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(long_docs, PIECES).collect()}
    assert got == {i: len(model.encode(t)) for i, t in enumerate(long_texts())}


def test_models_that_change_characters_are_refused():
    class Folding:
        def normalize(self, text):
            return token_counts.MARK + text.lower().replace(" ", token_counts.MARK)

    assert token_counts.changing(Folding()) and not token_counts.changing(token_counts.coder(PIECES))


def test_lines_of_long_texts(spark, long_docs):
    first = {}
    for i, t in enumerate(long_texts()):
        for line in t.split("\n"):
            first.setdefault(line.strip(" ").lower(), i)
    for r in line_dedup.digests(long_docs).collect():
        lines = long_texts()[r["doc_id"]].split("\n")
        kept = [x for x in lines if first[x.strip(" ").lower()] == r["doc_id"]]
        assert (r["n_lines"], r["n_dropped"]) == (len(lines), len(lines) - len(kept))
        assert r["kept_sha256"] == hashlib.sha256("\n".join(kept).encode()).hexdigest()


def test_media_of_long_texts(spark, long_docs):
    rows = {r["doc_id"]: r for r in media.digests(media.encode(long_docs.where("doc_id < 3"))).collect()}
    for i in range(3):
        payload = media.padded(long_texts()[i])[0]
        assert rows[i]["payload_sha256"] == hashlib.sha256(payload).hexdigest()
    assert tuple(rows[0])[1:] == tuple(rows[1])[1:]


def test_fingerprints_of_long_texts(spark, long_docs):
    found = {r["doc_id"]: r for r in simhash.near_duplicates(long_docs).collect()}
    assert [found[i]["component_id"] for i in (0, 1)] == [0, 0]
    ones = np.zeros(64)
    words = long_texts()[0].split()
    import xxhash

    n = len(words) - 3
    for i in range(n):
        h = xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42)
        ones += np.array([h >> b & 1 for b in range(64)])
    assert int(found[0]["fingerprint"], 16) == sum(1 << b for b in range(64) if 2 * ones[b] > n)


def test_repeated_rows_are_answered_each(spark):
    docs = documents(spark)
    wanted = Counter(r["doc_id"] for r in docs.collect())
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(8)], "doc_id long, quality int, toxic int")
    for made in (
        token_counts.token_counts(docs, PIECES), media.digests(media.encode(docs)), simhash.near_duplicates(docs), line_dedup.digests(docs),
        quality_classifier.score(docs, labels),
    ):
        rows = made.collect()
        assert Counter(r["doc_id"] for r in rows) == wanted and len({tuple(r) for r in rows}) == len(wanted)


def test_labels_that_contradict_and_repeated_rows(spark):
    """The smallest label counts, and of repeated rows the trees see one, so neither changes a score."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    more = labels.union(labels.withColumn("quality", F.lit(1))).union(labels.withColumn("quality", F.lit(7)))
    of = lambda d, l: {tuple(r) for r in quality_classifier.score(d, l).collect()}
    assert of(docs, labels) == of(docs, more) == of(docs.union(docs), labels)


def test_samples_are_those_of_a_plain_inverse_transform():
    r = np.random.default_rng(2)
    held = r.integers(0, 256, (5, media.HELD), dtype=np.uint8)
    got = media.samples(held)
    for block, values in zip(got, held, strict=True):
        grid = np.zeros((8, 8))
        for k, v in enumerate(values.tolist(), start=1):
            grid[divmod(int(media.ZIGZAG[k]), 8)] = v if v >= 128 else v - 255
        scale = lambda u: 1 / np.sqrt(2) if u == 0 else 1.0
        for y in range(8):
            for x in range(8):
                total = sum(
                    scale(u) * scale(v) * grid[v, u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16)
                    for u in range(8)
                    for v in range(8)
                )
                assert abs(int(block.reshape(8, 8)[y, x]) - min(255, max(0, total / 4 + 128))) <= 0.51


def test_intermediate_tables_are_deleted(spark):
    held = materialise(spark.range(5), "held")
    assert held.count() == 5
    discard(held, spark.range(3))
    with pytest.raises(Exception, match="(?i)path|file"):
        spark.read.parquet(held.stored_at).count()


def test_pipeline_on_odd_and_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    for name, docs in (("odd", documents(spark)), ("empty", empty(spark))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        now = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for step, stage in corpus_pipeline.STAGES[:-1]:
            after = materialise(stage(spark, now, f"{tmp_path}/{name}"), step)
            assert after.columns == docs.columns
            assert {r["doc_id"] for r in after.collect()} <= {r["doc_id"] for r in now.collect()}
            now = after
        rows = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in now.collect()}
        assert (name == "empty") == (not rows)


def test_mixing_keeps_columns_of_any_name(spark):
    docs = documents(spark).withColumns({"position": F.lit(1), "group": F.lit("g"), "slot": F.lit(2), "block": F.lit(3), "_tw_i": F.lit(4)})
    out = mixing.mixed(docs, {"src0": 1})
    assert out.columns == docs.columns
    key = lambda rows: Counter(re.sub(r"\s+", " ", str(tuple(r))) for r in rows)
    assert key(out.collect()) == key(docs.collect())
