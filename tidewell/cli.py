"""Command line: import, query, search, profiles, relays, statistics, names in streams, and dumps of tables."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import maintenance, search, tables
from tidewell.plans.filters import Filter
from tidewell.plans.query import query
from tidewell.session import session
from tidewell.sources import events
from tidewell.storage import materialise


#: What an import may leave out, and the derived tables that can be printed, under their names in the store.
SKIPPED = ("skip-fulltext", "skip-blocks", "skip-counters")
DERIVED = {
    "tags": "tags", "tokens": "tokens", "names": "profile_names", "profiles": "profiles", "blocks": "blocks", "counters": "note_counts", "reactions": "note_reactions",
    "zaps": "zaps",
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidewell", description=__doc__)
    p.add_argument("--store", required=True, help="folder of the stored tables")
    sub = p.add_subparsers(dest="command", required=True)
    imp = sub.add_parser("import", help="read event lines into the store")
    imp.add_argument("path")
    imp.add_argument("--relay")
    imp.add_argument("--skip-verification", action="store_true")
    for name in SKIPPED:
        imp.add_argument(f"--{name}", action="store_true", help="derive no such table")
    q = sub.add_parser("query", help="notes of a filter, newest first, as JSON")
    q.add_argument("--filter", help="the filter as JSON")
    for name in ("ids", "author", "kind", "tag", "relay"):
        q.add_argument(f"--{name}", action="append", default=[], help="may be given again; a tag as x=value" if name == "tag" else None)
    for name in ("since", "until", "limit"):
        q.add_argument(f"--{name}", type=int)
    q.add_argument("--search")
    s = sub.add_parser("search", help="notes by words")
    s.add_argument("words")
    s.add_argument("--limit", type=int, default=search.MOST_HITS)
    s.add_argument("--oldest-first", action="store_true")
    prof = sub.add_parser("profile", help="profiles by name")
    prof.add_argument("name")
    prof.add_argument("--limit", type=int, default=20)
    relays = sub.add_parser("note-relays", help="relays that a note was seen on")
    relays.add_argument("id")
    sub.add_parser("stat", help="counts and sizes by kind")
    sub.add_parser("resolve-pubkeys", help="put names for pubkeys in the lines of standard input")
    dump = sub.add_parser("print", help="a derived table")
    dump.add_argument("table", choices=["kinds", "relays", *DERIVED])
    return p


def filter_of(a: argparse.Namespace) -> Filter:
    if a.filter:
        return Filter.from_json(a.filter)
    tags: dict[str, list[str]] = {}
    for t in a.tag:
        name, _, value = t.partition("=")
        tags.setdefault(name, []).append(value)
    return Filter(
        ids=a.ids or None, authors=a.author or None, kinds=[int(k) for k in a.kind] or None, tags=tags, relays=a.relay or None,
        since=a.since, until=a.until, limit=a.limit, search=a.search,
    )


def run_import(spark: SparkSession, a: argparse.Namespace) -> Iterable[str]:
    """Import into a new store, or what is new into one that is there, with all that is derived, in one commit."""
    there = maintenance.exists(spark, a.store)
    stored = maintenance.load(spark, a.store) if there else {}
    after = stored["notes"].agg(F.max("note_key")).first()[0] or 0 if there else 0
    notes, seen = events.ingest(spark, a.path, a.relay, stored.get("notes"), verify=not a.skip_verification, after=after)
    fresh = materialise(notes, "import")
    # Keys are those of the written notes; an event that was stored already is seen on one relay more.
    named = fresh.select("id", "note_key")
    if there:
        named = named.union(stored["notes"].select("id", "note_key"))
    relays = seen.join(named, "id").select("note_key", "relay")
    if there:
        relays = tables.add_relays(stored["note_relays"], relays)
    relays = materialise(relays, "import-relays")
    options = maintenance.Options(a.skip_fulltext, a.skip_blocks, a.skip_counters)
    maintenance.append({"notes": fresh, "note_relays": relays} | maintenance.derived(fresh, options), a.store)
    yield f"{fresh.count()} new notes"


def told(df: DataFrame) -> Iterable[str]:
    for row in df.toLocalIterator():
        yield "\t".join("" if v is None else str(v) for v in row)


def run(spark: SparkSession, a: argparse.Namespace) -> Iterable[str]:
    if a.command == "import":
        yield from run_import(spark, a)
        return
    stored = maintenance.load(spark, a.store)
    notes, relays = stored["notes"], stored["note_relays"]
    if a.command == "query":
        yield from told(tables.to_json(query(notes, filter_of(a), relays)).select("json"))
    elif a.command == "search":
        hits = search.search(notes, a.words, a.limit, a.oldest_first)
        yield from told(hits.select("note_key", "created_at", "content"))
    elif a.command == "profile":
        yield from told(search.search_names(notes, a.name, a.limit).select("key", "pubkey"))
    elif a.command == "note-relays":
        seen = relays.join(tables.by_id(notes, a.id).select("note_key"), "note_key", "left_semi")
        yield from told(seen.select("relay").distinct().orderBy("relay"))
    elif a.command == "stat":
        yield from told(tables.kind_statistics(notes).orderBy("kind_name"))
    elif a.command == "resolve-pubkeys":
        lines = spark.createDataFrame([(i, x.rstrip("\n")) for i, x in enumerate(sys.stdin)], "n long, line string")
        yield from told(tables.resolve_pubkeys(lines, "line", tables.best_names(notes), "n").orderBy("n").select("line"))
    else:
        made = {"kinds": lambda: notes.select("kind", "created_at", "note_key").orderBy("kind", "created_at"), "relays": lambda: relays.orderBy("note_key", "relay")}
        if a.table in made:
            yield from told(made[a.table]())
        elif DERIVED[a.table] in stored:
            name = DERIVED[a.table]
            yield from told(maintenance.added_up(name, stored[name]))


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = session()
    for line in run(spark, a):
        print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
