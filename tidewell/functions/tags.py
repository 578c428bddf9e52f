"""Functions of tags, as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.schema import is_id


def with_name(tags: Column, name: str) -> Column:
    """Tags of that name that have a value."""
    return F.filter(tags, lambda t: (F.size(t) >= 2) & (t[0] == name))


def values(tags: Column, name: str) -> Column:
    return F.transform(with_name(tags, name), lambda t: t[1])


def ids(tags: Column, name: str) -> Column:
    """Values that are ids, in order."""
    return F.filter(values(tags, name), is_id)


def first_id(tags: Column, name: str) -> Column:
    return F.get(ids(tags, name), 0)


def last_id(tags: Column, name: str) -> Column:
    return F.try_element_at(ids(tags, name), F.lit(-1))


def first_value(tags: Column, name: str) -> Column:
    """The value of the first tag of that name."""
    return F.get(values(tags, name), 0)


def has_value(tags: Column, name: str, wanted: Iterable[str]) -> Column:
    """Whether a tag of that one-letter name has one of the values. Ids match ids alone, strings the rest."""
    wanted = sorted(set(wanted))
    hex_digits = set("0123456789abcdefABCDEF")
    keys = [w for w in wanted if len(w) == 64 and set(w) <= hex_digits]
    plain = [w for w in wanted if w not in keys]
    def any_value(test: Callable[[Column], Column]) -> Column:
        fits = F.exists(tags, lambda t: (F.size(t) >= 2) & (t[0] == name) & test(t[1]))
        return F.coalesce(fits, F.lit(False))

    found = F.lit(False)
    if keys:
        found = found | any_value(lambda v: is_id(v) & F.lower(v).isin([k.lower() for k in keys]))
    if plain:
        found = found | any_value(lambda v: v.isin(plain))
    return found


def root(tags: Column) -> Column:
    """The id of the thread: the first id among the e tags."""
    return F.get(ids(tags, "e"), 0)


def reply(tags: Column) -> Column:
    """The id of the note that is answered: the second id among the e tags."""
    return F.get(ids(tags, "e"), 1)


def marked(tags: Column, marker: str) -> Column:
    """The last id among the e tags whose fourth item is that marker."""
    fit = F.filter(with_name(tags, "e"), lambda t: (F.size(t) >= 4) & (t[3] == marker) & is_id(t[1]))
    return F.try_element_at(F.transform(fit, lambda t: t[1]), F.lit(-1))


def thread_root(tags: Column, markers: bool = False) -> Column:
    return F.coalesce(marked(tags, "root"), root(tags)) if markers else root(tags)


def reply_target(tags: Column, markers: bool = False) -> Column:
    """What a note answers: its reply, else its root. By position, or by markers where there are any."""
    if markers:
        any_marker = F.exists(with_name(tags, "e"), lambda t: F.size(t) >= 4)
        return F.when(any_marker, F.coalesce(marked(tags, "reply"), marked(tags, "root"))).otherwise(
            F.coalesce(reply(tags), root(tags))
        )
    return F.coalesce(reply(tags), root(tags))
