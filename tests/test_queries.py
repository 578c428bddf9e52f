"""Each registered query against its SQL."""

from __future__ import annotations

import pytest

from tests.oracle import SF, assert_same
from tidewell.functions import codecs
from tidewell.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, name):
    assert_same(QUERIES[name](spark, SF), ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["bech32_decode", "bech32_fields", "content_parts", "invoice_decode"])
def test_one_file_fills_all_cores(spark, name):
    assert QUERIES[name](spark, SF).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 100
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_blocks_of_all_documents(spark, tmp_path):
    """Documents put together from known blocks."""
    npub = codecs.bech32_encode("npub", bytes(range(32)))
    told = [
        [("text", "plain words")],
        [("text", "see "), ("url", "https://a.example/p?q=1"), ("text", " and "), ("hashtag", "tag"), ("text", " end")],
        [("mention_index", "#[3]"), ("text", " by "), ("mention_bech32", npub)],
        [("text", "pay "), ("text", "lnbcxx"), ("text", " ## #")],
        [("hashtag", "été"), ("text", "\n"), ("url", "HTTP://b.example")],
    ]
    rows, wanted = [(90, "", "s"), (91, None, "s")], []
    for i, blocks in enumerate(told):
        content = ""
        for idx, (kind, value) in enumerate(blocks):
            content += "#" * (kind == "hashtag")
            wanted.append((i, idx, kind, value, len(content), len(value)))
            content += value
        rows.append((i, content, "s"))
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, QUERIES["document_blocks_all"](spark, str(tmp_path)).collect())) == wanted
    assert sorted(map(tuple, QUERIES["document_blocks"](spark, str(tmp_path)).collect())) == sorted((i, kind, value) for i, _, kind, value, _, _ in wanted)


def test_entities_and_envelopes_of_all_notes(spark):
    from tidewell.sources import adapt

    notes = {r["id"]: r for r in adapt.notes(spark, SF).collect()}
    told = QUERIES["bech32_decode"](spark, SF).collect()
    assert len(told) == 2 * len(notes) and {r["type"] for r in told} == set(codecs.ENTITIES)
    assert {r["id"] for r in told if r["id"]} == set(notes) and {r["pubkey"] for r in told if r["pubkey"]} <= {r["pubkey"] for r in notes.values()}
    opened = QUERIES["envelope_unwrap"](spark, SF).collect()
    assert sorted(r["envelope_id"] for r in opened) == sorted(notes) and {"00", "01"} <= {i[:2] for i in notes}
    for r in opened:
        note = notes[r["envelope_id"]]
        assert (r["created_at"], r["content"]) == (note["created_at"], note["content"] or "")
