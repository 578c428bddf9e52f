"""Filters and the order of results, on a corpus made by formula."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewell.plans.filters import Filter, minimal
from tidewell.plans.query import plan_name, query, visit

BASE = 1_700_000_000


def hex_id(n: int) -> str:
    return f"{n:064x}"


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [
        (i, f"{(i * 37 + 11) & 255:02x}" * 32, hex_id(i % 2 + 1), BASE + i, (1, 6, 7)[i % 3], f"note {i}", [["t", f"x{i % 5}"], ["t"]])
        for i in range(60)
    ]
    schema = "note_key long, id string, pubkey string, created_at long, kind long, content string, tags array<array<string>>"
    relays = [(i, "wss://one" if i % 4 < 2 else "wss://two") for i in range(60)]
    return spark.createDataFrame(rows, schema), spark.createDataFrame(relays, "note_key long, relay string")


def keys(df):
    return [r["note_key"] for r in df.collect()]


def test_until_is_exclusive_and_since_is_not(corpus):
    assert keys(query(corpus[0], Filter(since=BASE + 35, until=BASE + 39))) == [38, 37, 36, 35]


def test_newest_first_over_kinds_and_authors(corpus):
    wanted = [i for i in range(59, -1, -1) if i % 3 in (0, 2) and i % 2 == 0][:7]
    assert keys(query(corpus[0], Filter(kinds=[1, 7], authors=[hex_id(1)], limit=7))) == wanted


def test_relays(corpus):
    notes, relays = corpus
    wanted = [i for i in range(59, -1, -1) if i % 4 >= 2 and i % 3 == 1]
    assert keys(query(notes, Filter(kinds=[6], relays=["wss://two"]), relays)) == wanted
    with pytest.raises(ValueError):
        query(notes, Filter(relays=["wss://two"]))


def test_limits_of_each_filter_and_of_the_whole(corpus):
    both = [Filter(kinds=[1], limit=2), Filter(kinds=[1, 6], limit=3)]
    assert keys(query(corpus[0], both)) == [58, 57, 57, 55, 54]
    assert keys(query(corpus[0], both, capacity=3)) == [58, 57, 57]
    assert keys(query(corpus[0], both, distinct=True)) == [58, 57, 55, 54]


def test_limit_zero_is_none(corpus):
    assert len(keys(query(corpus[0], Filter(kinds=[1], limit=0)))) == 20


def test_empty_filter_with_capacity_reads_the_first_stored(corpus):
    assert keys(query(corpus[0], Filter(), capacity=4)) == [3, 2, 1, 0]


def test_visit_stops(corpus):
    seen = []
    calls = visit(corpus[0], [Filter(kinds=[1]), Filter(kinds=[6])], lambda r: seen.append(r["note_key"]) or len(seen) < 3)
    assert (calls, seen) == (3, [57, 54, 51])


def test_custom_predicate(corpus):
    assert keys(query(corpus[0], Filter(kinds=[1], custom=lambda: F.col("content").endswith("7")))) == [57, 27]


def test_json_round_trip():
    text = '{"kinds":[1,2],"since":5,"#t":["b","a"]}'
    f = Filter.from_json('{"since":5,"kinds":[2,1],"#t":["b","a"],"what":[]}')
    assert Filter.from_json(f.to_json()) == f == Filter.from_json(text)
    assert Filter(ids=["AB" * 32]).ids == ("ab" * 32,)


@pytest.mark.parametrize(
    "bad",
    ['{"ids":["x"]}', '{"kinds":["1"]}', '{"kinds":[-1]}', '{"since":"x"}', '{"#t":[1]}', f'{{"#e":["{"a" * 64}","b"]}}', '{"search":["a"]}', "[]"],
)
def test_bad_filters(bad):
    with pytest.raises((ValueError, TypeError)):
        Filter.from_json(bad)


def test_subsets():
    nothing, kinds, both = Filter(), Filter(kinds=[1]), Filter(kinds=[1], ids=["a" * 64])
    assert kinds.is_subset_of(nothing) and both.is_subset_of(kinds) and both.is_subset_of(nothing)
    assert not kinds.is_subset_of(both) and not nothing.is_subset_of(kinds) and kinds.is_subset_of(kinds)
    assert minimal([both, kinds]) == [kinds]


@pytest.mark.parametrize(
    ("f", "name"),
    [
        (Filter(), "all_notes"), (Filter(kinds=[0], search="a"), "profile_search"), (Filter(search="a"), "search"),
        (Filter(ids=["a" * 64]), "ids"), (Filter(kinds=[1], relays=["r"]), "relay_kinds"),
        (Filter(kinds=[1], authors=["a" * 64, "b" * 64]), "author_kinds"), (Filter(authors=["a" * 64]), "authors"),
        (Filter(tags={"t": ["a"]}), "tags"), (Filter(kinds=[1]), "kinds"), (Filter(since=1), "created"),
        (Filter(kinds=list(range(40)), authors=["a" * 64, "b" * 64]), "kinds"),
    ],
)
def test_plan_names(f, name):
    assert plan_name(f) == name


def test_filters_reach_the_scan(spark, tmp_path, corpus):
    corpus[0].write.parquet(str(tmp_path / "notes"))
    stored = spark.read.parquet(str(tmp_path / "notes"))
    plan = query(stored, Filter(kinds=[1], since=BASE)).select("note_key", "created_at")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(kind)" in plan and "GreaterThanOrEqual(created_at" in plan
    assert "content" not in plan.split("ReadSchema")[1].split("\n")[0]
