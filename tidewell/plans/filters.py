"""Filters: conjunctions of predicates on notes, their JSON form, and their column form."""

from __future__ import annotations

import functools
import json
import operator
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import tags as tag_functions

HEX = set("0123456789abcdefABCDEF")
#: From so many values on, a list is joined instead of compared.
LONG_LIST = 1000
#: Lists up to this size are broadcast; longer ones are shuffled.
MOST_BROADCAST = 1_000_000
U32 = 1 << 32


def looks_like_id(value: str) -> bool:
    return len(value) == 64 and set(value) <= HEX


def once(values: Sequence | None) -> tuple | None:
    return None if values is None else tuple(sorted(set(values)))


@dataclass(frozen=True)
class Filter:
    """All given fields must hold; a field holds if one of its values does. A field of None isn't asked for."""

    ids: Sequence[str] | None = None
    authors: Sequence[str] | None = None
    kinds: Sequence[int] | None = None
    tags: Mapping[str, Sequence[str]] = field(default_factory=dict)
    since: int | None = None
    until: int | None = None
    relays: Sequence[str] | None = None
    search: str | None = None
    limit: int | None = None
    custom: Callable[[], Column] | None = None

    def __post_init__(self) -> None:
        put = functools.partial(object.__setattr__, self)
        for name in ("ids", "authors"):
            values = getattr(self, name)
            if values is not None and not all(isinstance(v, str) and looks_like_id(v) for v in values):
                raise ValueError(f"{name}: 64 hexadecimal digits each")
            put(name, once([v.lower() for v in values]) if values is not None else None)
        if self.kinds is not None and not all(isinstance(k, int) and not isinstance(k, bool) and 0 <= k < U32 for k in self.kinds):
            raise ValueError("kinds: whole numbers of 32 bits")
        put("kinds", once(self.kinds))
        put("relays", once(self.relays))
        held = {}
        for name, values in self.tags.items():
            if len(name) != 1:
                raise ValueError("tag filters have names of one character")
            if len({looks_like_id(v) for v in values}) > 1:
                raise ValueError(f"#{name}: all ids or all plain")
            held[name] = tuple(values)
        put("tags", held)
        for name in ("since", "until", "limit"):
            value = getattr(self, name)
            if value is not None and (not isinstance(value, int) or value < 0):
                raise ValueError(f"{name}: one whole number")
        if self.search is not None and not isinstance(self.search, str):
            raise ValueError("search: one string")

    def fields(self) -> dict[str, Any]:
        """The fields that are asked for, by name."""
        named = {n: getattr(self, n) for n in ("ids", "authors", "kinds", "since", "until", "limit", "relays", "search", "custom")}
        return {n: v for n, v in named.items() if v is not None} | {f"#{n}": v for n, v in self.tags.items()}

    @property
    def empty(self) -> bool:
        return not self.fields()

    def __hash__(self) -> int:
        return hash(tuple(sorted((n, str(v)) for n, v in self.fields().items())))

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Filter) and self.fields() == other.fields()

    def is_subset_of(self, other: Filter) -> bool:
        """Whether, by their form, all that this filter finds ``other`` finds too."""
        mine, others = self.fields(), other.fields()
        return len(others) <= len(mine) and all(n in mine and mine[n] == v for n, v in others.items())

    def to_json(self) -> str:
        out = {n: list(v) if isinstance(v, tuple) else v for n, v in self.fields().items() if n != "custom"}
        return json.dumps(out, separators=(",", ":"), ensure_ascii=False)

    @staticmethod
    def from_json(text: str) -> Filter:
        """Read a filter. Unknown keys are skipped."""
        raw = json.loads(text)
        if not isinstance(raw, dict):
            raise ValueError("a filter is an object")
        known = {"ids", "authors", "kinds", "since", "until", "limit", "search", "relays"}
        found = {k: v for k, v in raw.items() if k in known}
        for name in ("ids", "authors", "kinds", "relays"):
            if name in found and not isinstance(found[name], list):
                raise ValueError(f"{name}: a list")
        tags = {k[1]: tuple(v) for k, v in raw.items() if len(k) == 2 and k[0] == "#"}
        if not all(isinstance(x, str) for v in tags.values() for x in v):
            raise ValueError("tag values: strings")
        return Filter(**found, tags=tags)

    def predicate(self) -> Column:
        """The filter on a note's own columns, as one column. Relays need a join and search its operator: both hold here."""
        tests: list[Column] = []
        if self.ids is not None:
            tests.append(F.col("id").isin(list(self.ids)))
        if self.authors is not None:
            tests.append(F.col("pubkey").isin(list(self.authors)))
        if self.kinds is not None:
            tests.append(F.col("kind").isin(list(self.kinds)))
        if self.since is not None:
            tests.append(F.col("created_at") >= self.since)
        if self.until is not None:
            tests.append(F.col("created_at") < self.until)
        tests += [tag_functions.has_value(F.col("tags"), n, v) for n, v in self.tags.items()]
        if self.custom is not None:
            tests.append(self.custom())
        return functools.reduce(operator.and_, tests, F.lit(True))


def group_predicate(filters: Sequence[Filter]) -> Column:
    """One of the filters holds; a group of none holds for all."""
    if not filters:
        return F.lit(True)
    return functools.reduce(operator.or_, (f.predicate() for f in filters))


def minimal(filters: Sequence[Filter]) -> list[Filter]:
    """Without filters that others cover, for groups whose limits don't matter."""
    plain = list(dict.fromkeys(filters))
    return [f for f in plain if not any(g is not f and f.is_subset_of(g) for g in plain)]


def matching(notes: DataFrame, f: Filter, relays: DataFrame | None = None) -> DataFrame:
    """Notes that the filter holds for, each once. ``relays`` has (note_key, relay).

    Long lists of ids or authors become semi joins.
    """
    lists = {"id": f.ids, "pubkey": f.authors}
    long = {c: v for c, v in lists.items() if v is not None and len(v) > LONG_LIST}
    short = Filter(
        **{
            **{n: getattr(f, n) for n in ("kinds", "tags", "since", "until", "custom")},
            "ids": None if "id" in long else f.ids,
            "authors": None if "pubkey" in long else f.authors,
        }
    )
    out = notes.where(short.predicate())
    for column, values in long.items():
        table = notes.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
        out = out.join(F.broadcast(table) if len(values) <= MOST_BROADCAST else table, column, "left_semi")
    if f.relays is not None:
        if relays is None:
            raise ValueError("a filter on relays needs their table")
        seen = relays.where(F.col("relay").isin(list(f.relays))).select("note_key")
        out = out.join(seen, "note_key", "left_semi")
    return out
