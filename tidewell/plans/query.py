"""Filter queries: newest first, with limits; several filters at once; folds."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tidewell.operators import search as search_operators
from tidewell.plans.filters import Filter, matching
from tidewell.schema import PROFILE_KIND

#: Products of authors and kinds up to which the index of both would be chosen.
MOST_SCANNERS = 64


def plan_name(f: Filter) -> str:
    """The access path that a rule-based planner would choose. Catalyst needs none; tests and readers do."""
    tag_values = sum(len(v) for v in f.tags.values())
    if f.empty:
        return "all_notes"
    if f.search is not None:
        return "profile_search" if f.kinds == (PROFILE_KIND,) else "search"
    if f.ids is not None:
        return "ids"
    if f.relays is not None and f.kinds is not None and f.authors is None:
        return "relay_kinds"
    if f.kinds is not None and f.authors is not None:
        if len(f.authors) == 1 or len(f.authors) * len(f.kinds) <= MOST_SCANNERS:
            return "author_kinds"
    if f.authors is not None and len(f.authors) == 1:
        return "authors"
    if tag_values == 1:
        return "tags"
    return "kinds" if f.kinds is not None else "created"


def newest(notes: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest first, of equal times the larger key first. A limit of 0 is none."""
    out = notes.orderBy(F.desc("created_at"), F.desc("note_key"))
    return out.limit(limit) if limit else out


def found(notes: DataFrame, f: Filter, relays: DataFrame | None = None) -> DataFrame:
    """Notes of one filter before order and limit, by the operator that its plan names.

    Where that walks relays and kinds, a note comes once for each listed relay that it was seen on.
    """
    plan = plan_name(f)
    if plan == "relay_kinds" and relays is not None:
        return seen_on_each(notes, f, relays)
    if plan == "profile_search":
        return search_operators.profile_notes(notes, f.search or "")
    out = matching(notes, f, relays)
    if plan == "search":
        out = search_operators.matching_words(out, f.search or "")
    return out


def seen_on_each(notes: DataFrame, f: Filter, relays: DataFrame) -> DataFrame:
    """Notes of a filter on relays, each once for each listed relay that it was seen on."""
    bare = Filter(**{n: getattr(f, n) for n in ("ids", "authors", "kinds", "tags", "since", "until", "custom")})
    listed = relays.where(F.col("relay").isin(list(f.relays or ()))).select("note_key")
    return matching(notes, bare).join(listed, "note_key")


def query(
    notes: DataFrame,
    filters: Filter | Sequence[Filter],
    relays: DataFrame | None = None,
    capacity: int | None = None,
    distinct: bool = False,
) -> DataFrame:
    """Notes of one or more filters, newest first.

    Each filter has its own limit. A note that several filters find comes as
    often, unless ``distinct``. ``capacity`` cuts the whole.
    """
    many = [filters] if isinstance(filters, Filter) else list(filters)
    if not many:
        raise ValueError("no filter")
    parts = []
    for f in many:
        part = found(notes, f, relays)
        limits = [x for x in (f.limit, capacity) if x]
        # An empty filter reads the first stored notes, as far as the capacity goes.
        if f.empty and capacity:
            part = part.orderBy("note_key").limit(capacity)
        elif limits:
            part = newest(part, min(limits))
        parts.append(part)
    out = functools.reduce(DataFrame.unionByName, parts)
    return newest(out.dropDuplicates(["note_key"]) if distinct else out, capacity)


def visit(
    notes: DataFrame, filters: Sequence[Filter], visitor: Callable[[Row], bool], relays: DataFrame | None = None
) -> int:
    """Call ``visitor`` on each row, filter by filter, newest first, till it gives False; the number of calls.

    Rows come to the driver a partition at a time. For sums and counts use :func:`fold`.
    """
    calls = 0
    for f in filters:
        rows: Iterator[Row] = newest(found(notes, f, relays), f.limit).toLocalIterator()
        for row in rows:
            calls += 1
            if not visitor(row):
                return calls
    return calls


def fold(notes: DataFrame, f: Filter, *aggregates, relays: DataFrame | None = None) -> DataFrame:
    """Aggregates over a filter's notes, on the executors."""
    return found(notes, f, relays).agg(*aggregates)
