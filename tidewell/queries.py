"""The registered queries of the engine's own operators, each with its SQL where SQL can express it."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions import codecs, content, crypto, points, tags, text
from tidewell.operators import counters, maintenance, search, tables
from tidewell.plans.filters import Filter, group_predicate, matching
from tidewell.plans.query import fold, plan_name, query, visit
from tidewell.sources import adapt, events
from tidewell.storage import fresh_path, materialise
from tidewell.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

ROW = ["note_key", "pubkey", "created_at", "kind", "content"]
ROW_SQL = ", ".join(ROW)
SINCE, UNTIL = 1_704_500_000, 1_705_500_000


def note_id(n: int) -> str:
    return hashlib.sha256(str(n).encode()).hexdigest()


def pubkey(n: int) -> str:
    return hashlib.sha256(f"pk{n}".encode()).hexdigest()


def listed(values) -> str:
    return ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)


def registered(name: str, sql: str | None = None, ctes: str = adapt.NOTES_SQL):
    """Register a query under a name; ``sql`` is what stands behind WITH and the tables."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = f"WITH {ctes} {sql}"
        return f

    return put


def on_notes(name: str, sql: str | None = None, ctes: str = adapt.NOTES_SQL, of: Query = adapt.notes):
    """Register a function of the table of notes."""

    def put(f: Callable[[DataFrame], DataFrame]) -> None:
        registered(name, sql, ctes)(lambda spark, sf_dir: f(of(spark, sf_dir)))

    return put


def on_documents(name: str, sql: str | None = None):
    return on_notes(name, sql, adapt.DOCUMENTS_SQL, adapt.documents)


WITH_RELAYS = f"{adapt.NOTES_SQL}, {adapt.RELAYS_SQL}"
NEWEST = "ORDER BY created_at DESC, note_key DESC"
#: Tags in rows, items counted from 1.
TAG_ROWS = """, te AS (SELECT note_key, id, pubkey, kind, content, created_at, msats, pos, t[1] AS tag, t[2] AS value
    FROM (SELECT *, unnest(tags) AS t, unnest(range(len(tags))) AS pos FROM notes))"""
TAGGED = adapt.NOTES_SQL + TAG_ROWS


def simple_filter(name: str, f: Filter, where: str) -> None:
    on_notes(name, f"SELECT {ROW_SQL} FROM notes WHERE {where}")(lambda n: matching(n, f).select(ROW))


# Predicates.

IDS, AUTHORS = [note_id(n) for n in (1, 5, 77, 4000, 9999)], [pubkey(n) for n in (3, 7, 11)]
simple_filter("filter_ids", Filter(ids=IDS), f"id IN ({listed(IDS)})")
simple_filter("filter_authors", Filter(authors=AUTHORS), f"pubkey IN ({listed(AUTHORS)})")
simple_filter("filter_kinds", Filter(kinds=[1, 7]), "kind IN (1, 7)")
simple_filter("filter_since_until", Filter(since=SINCE, until=UNTIL), f"created_at >= {SINCE} AND created_at < {UNTIL}")
simple_filter("filter_tag_str", Filter(tags={"t": ["5", "17"]}), "list_bool_or([x[1] = 't' AND x[2] IN ('5', '17') FOR x IN tags])")
TARGETS = [note_id(100), note_id(230)]
simple_filter("filter_tag_id", Filter(tags={"e": TARGETS}), f"list_bool_or([x[1] = 'e' AND x[2] IN ({listed(TARGETS)}) FOR x IN tags])")
simple_filter(
    "filter_and",
    Filter(kinds=[1, 6], since=SINCE, tags={"t": ["1", "2", "3", "4"], "e": [note_id(n) for n in range(0, 10000, 20)]}),
    f"kind IN (1, 6) AND created_at >= {SINCE} AND list_bool_or([x[1] = 't' AND x[2] IN ('1', '2', '3', '4') FOR x IN tags]) "
    f"AND list_bool_or([x[1] = 'e' AND x[2] IN ({listed(note_id(n) for n in range(0, 10000, 20))}) FOR x IN tags])",
)
simple_filter("filter_empty", Filter(), "true")
simple_filter("filter_custom", Filter(kinds=[9735], custom=lambda: F.col("msats") % 2 == 0), "kind = 9735 AND msats % 2 = 0")
MANY = [pubkey(n) for n in range(0, 3000, 2)]
simple_filter("filter_many_authors", Filter(authors=MANY, kinds=[1]), f"kind = 1 AND pubkey IN ({listed(MANY)})")
JSON_FILTER = '{"kinds":[7],"#t":["8","9"],"since":1704500000,"unknown":1}'
simple_filter(
    "filter_from_json", Filter.from_json(JSON_FILTER), f"kind = 7 AND created_at >= {SINCE} AND list_bool_or([x[1] = 't' AND x[2] IN ('8', '9') FOR x IN tags])"
)
RELAYS = ["wss://r1", "wss://r9"]


@on_notes("filter_relays", f"SELECT {ROW_SQL} FROM notes WHERE note_key IN (SELECT note_key FROM relays WHERE relay IN ({listed(RELAYS)}))", WITH_RELAYS)
def filter_relays(n: DataFrame) -> DataFrame:
    return matching(n, Filter(relays=RELAYS), adapt.relays(n)).select(ROW)


@on_notes("filter_or_group", f"SELECT {ROW_SQL} FROM notes WHERE kind = 0 OR (pubkey IN ({listed(AUTHORS)}) AND created_at < {SINCE})")
def filter_or_group(n: DataFrame) -> DataFrame:
    return n.where(group_predicate([Filter(kinds=[0]), Filter(authors=AUTHORS, until=SINCE)])).select(ROW)


# Access paths: whole queries, newest first.


def planned(name: str, f: Filter, where: str, limit: int) -> None:
    on_notes(name, f"SELECT {ROW_SQL} FROM notes WHERE {where} {NEWEST} LIMIT {limit}")(lambda n: query(n, f).select(ROW))


planned("plan_created", Filter(since=SINCE, until=UNTIL, limit=50), f"created_at >= {SINCE} AND created_at < {UNTIL}", 50)
planned("plan_kinds", Filter(kinds=[1, 6], limit=20), "kind IN (1, 6)", 20)
planned("plan_ids", Filter(ids=IDS, limit=3), f"id IN ({listed(IDS)})", 3)
planned("plan_authors", Filter(authors=AUTHORS[:1], limit=25), f"pubkey = '{AUTHORS[0]}'", 25)
planned("plan_author_kinds", Filter(authors=AUTHORS, kinds=[1, 7], limit=30), f"pubkey IN ({listed(AUTHORS)}) AND kind IN (1, 7)", 30)
planned("plan_tags", Filter(tags={"t": ["42"]}, limit=40), "list_bool_or([x[1] = 't' AND x[2] = '42' FOR x IN tags])", 40)
planned("topk_newest", Filter(kinds=[0, 1, 6, 7, 9735], limit=100), "true", 100)


@on_notes("plan_all_notes", f"SELECT {ROW_SQL} FROM notes ORDER BY note_key LIMIT 25")
def plan_all_notes(n: DataFrame) -> DataFrame:
    return query(n, Filter(), capacity=25).select(ROW)


@on_notes(
    "plan_relay_kinds",
    f"SELECT {ROW_SQL} FROM notes JOIN relays USING (note_key) WHERE kind IN (1, 7) AND relay IN ({listed(RELAYS)}) {NEWEST} LIMIT 60",
    WITH_RELAYS,
)
def plan_relay_kinds(n: DataFrame) -> DataFrame:
    return query(n, Filter(kinds=[1, 7], relays=RELAYS, limit=60), adapt.relays(n)).select(ROW)


BOTH = [Filter(kinds=[1], limit=30), Filter(tags={"t": ["7", "8"]}, limit=30)]
BOTH_SQL = f"""(SELECT * FROM notes WHERE kind = 1 {NEWEST} LIMIT 30) UNION ALL
    (SELECT * FROM notes WHERE list_bool_or([x[1] = 't' AND x[2] IN ('7', '8') FOR x IN tags]) {NEWEST} LIMIT 30)"""


@on_notes("multi_filter_bag", f"SELECT {ROW_SQL} FROM ({BOTH_SQL}) {NEWEST} LIMIT 50")
def multi_filter_bag(n: DataFrame) -> DataFrame:
    return query(n, BOTH, capacity=50).select(ROW)


@on_notes("multi_filter_distinct", f"SELECT DISTINCT {ROW_SQL} FROM ({BOTH_SQL})")
def multi_filter_distinct(n: DataFrame) -> DataFrame:
    return query(n, BOTH, distinct=True).select(ROW)


@on_notes("limit_zero", f"SELECT {ROW_SQL} FROM notes WHERE kind = 6")
def limit_zero(n: DataFrame) -> DataFrame:
    return query(n, Filter(kinds=[6], limit=0)).select(ROW)


@on_notes("fold_count", "SELECT count(*) AS n, sum(msats)::BIGINT AS msats, max(created_at) AS newest FROM notes WHERE kind = 9735")
def fold_count(n: DataFrame) -> DataFrame:
    return fold(n, Filter(kinds=[9735]), F.count(F.lit(1)).alias("n"), F.sum("msats").alias("msats"), F.max("created_at").alias("newest"))


# Look-ups and joins.


@on_notes("note_by_id", f"SELECT {ROW_SQL} FROM notes WHERE id = '{note_id(321)}'")
def note_by_id(n: DataFrame) -> DataFrame:
    return tables.by_id(n, note_id(321)).select(ROW)


@on_notes("note_by_key", f"SELECT {ROW_SQL} FROM notes WHERE note_key = 123")
def note_by_key(n: DataFrame) -> DataFrame:
    return tables.by_key(n, 123).select(ROW)


def latest_sql(where: str) -> str:
    return f"SELECT {ROW_SQL} FROM notes WHERE {where} QUALIFY row_number() OVER (PARTITION BY pubkey {NEWEST}) = 1"


@on_notes("latest_per_author", latest_sql("true"))
def latest_per_author(n: DataFrame) -> DataFrame:
    return tables.latest(n, "pubkey").select(ROW)


@on_notes("latest_before_until", latest_sql(f"created_at < {UNTIL}"))
def latest_before_until(n: DataFrame) -> DataFrame:
    return tables.latest_before(n, "pubkey", UNTIL).select(ROW)


PROFILES_SQL = (
    adapt.NOTES_SQL
    + """, profiles AS (SELECT note_key, pubkey, created_at, content->>'$.name' AS name, content->>'$.display_name' AS display_name
    FROM notes WHERE kind = 0)"""
)


@on_notes(
    "latest_profile",
    f"SELECT pubkey, name, display_name FROM profiles QUALIFY row_number() OVER (PARTITION BY pubkey {NEWEST}) = 1",
    PROFILES_SQL,
)
def latest_profile(n: DataFrame) -> DataFrame:
    return tables.latest_profiles(n).select("pubkey", "profile.name", "profile.display_name")


NAMES_SQL = PROFILES_SQL + """, names AS (SELECT DISTINCT key, pubkey FROM (
    SELECT substr(lower(name), 1, 23) AS key, pubkey FROM profiles UNION ALL SELECT substr(lower(display_name), 1, 23), pubkey FROM profiles))"""


@on_notes(
    "profile_name_search",
    """SELECT key, pubkey FROM (SELECT *, lag(pubkey) OVER (ORDER BY key, pubkey) AS before FROM names WHERE key >= 'name3')
       WHERE before IS NULL OR before <> pubkey ORDER BY key, pubkey LIMIT 40""",
    NAMES_SQL,
)
def profile_name_search(n: DataFrame) -> DataFrame:
    return search.search_names(n, "Name3", limit=40).select("key", "pubkey")


@on_notes(
    "profile_name_prefix",
    """SELECT key, pubkey FROM (SELECT *, lag(pubkey) OVER (ORDER BY key, pubkey) AS before FROM names WHERE starts_with(key, 'shown1'))
       WHERE before IS NULL OR before <> pubkey ORDER BY key, pubkey LIMIT 60""",
    NAMES_SQL,
)
def profile_name_prefix(n: DataFrame) -> DataFrame:
    return search.search_names(n, "SHOWN1", limit=60, prefix_only=True).select("key", "pubkey")


@on_notes("plan_profile_search", f"SELECT {ROW_SQL} FROM notes WHERE kind = 0 AND pubkey IN (SELECT pubkey FROM names WHERE key >= 'shown9')", NAMES_SQL)
def plan_profile_search(n: DataFrame) -> DataFrame:
    return query(n, Filter(kinds=[0], search="Shown9")).select(ROW)


BEST_SQL = PROFILES_SQL + f""", best AS (SELECT pubkey, coalesce(nullif(display_name, ''), name) AS name FROM profiles
    QUALIFY row_number() OVER (PARTITION BY pubkey {NEWEST}) = 1)"""


@on_notes("profile_note_join", "SELECT note_key, coalesce(b.name, n.pubkey) AS name FROM notes n LEFT JOIN best b ON n.pubkey = b.pubkey", BEST_SQL)
def profile_note_join(n: DataFrame) -> DataFrame:
    return tables.with_profile(n).select("note_key", "name")


@on_notes(
    "profile_as_of",
    """SELECT n.note_key, p.name FROM (SELECT * FROM notes WHERE kind = 1) n
       ASOF LEFT JOIN (SELECT pubkey, created_at, max_by(name, note_key) AS name FROM profiles GROUP BY ALL) p
       ON n.pubkey = p.pubkey AND n.created_at >= p.created_at""",
    PROFILES_SQL,
)
def profile_as_of(n: DataFrame) -> DataFrame:
    named = tables.profiles(n).groupBy("pubkey", "created_at").agg(F.max_by("profile.name", "note_key").alias("name"))
    return tables.as_of(n.where("kind = 1"), named, "pubkey", "name").select("note_key", "name")


@on_notes("dedupe_ids", "SELECT id, note_key FROM notes WHERE note_key % 3 <> 0")
def dedupe_ids(n: DataFrame) -> DataFrame:
    incoming = n.union(n.where("note_key % 2 = 0")).withColumn("_order", F.col("note_key"))
    return events.deduplicated(incoming, n.where("note_key % 3 = 0")).select("id", "note_key")


@on_notes("note_exists", f"SELECT id, id IN (SELECT id FROM notes) AS stored FROM (SELECT unnest([{listed([*IDS, 'x'])}]) AS id)")
def note_exists(n: DataFrame) -> DataFrame:
    asked = n.sparkSession.createDataFrame([(i,) for i in [*IDS, "x"]], "id string")
    hit = n.join(F.broadcast(asked), "id", "left_semi").select(F.col("id").alias("_id"))
    return asked.join(hit, asked["id"] == hit["_id"], "left").select("id", F.col("_id").isNotNull().alias("stored"))


@on_notes("seen_on_relay", f"SELECT {ROW_SQL} FROM notes WHERE note_key IN (SELECT note_key FROM relays WHERE relay = 'wss://r9')", WITH_RELAYS)
def seen_on_relay(n: DataFrame) -> DataFrame:
    return tables.seen_on(n, adapt.relays(n), "wss://r9").select(ROW)


@on_notes("relays_per_note", "SELECT note_key, count(DISTINCT relay) AS n_relays FROM relays GROUP BY note_key", WITH_RELAYS)
def relays_per_note(n: DataFrame) -> DataFrame:
    return tables.relays_per_note(adapt.relays(n))


@on_notes(
    "latest_versions",
    f"""SELECT note_key FROM notes WHERE kind <> 0 UNION ALL
        (SELECT note_key FROM notes WHERE kind = 0 QUALIFY row_number() OVER (PARTITION BY pubkey {NEWEST}) = 1)""",
)
def latest_versions(n: DataFrame) -> DataFrame:
    return tables.latest_versions(n).select("note_key")


@on_notes("promote_rumors", "SELECT note_key, CASE WHEN note_key % 4 = 0 THEN 2 ELSE 0 END AS flags FROM notes")
def promote_rumors(n: DataFrame) -> DataFrame:
    stored = n.withColumns({"sig": F.lit("s"), "flags": F.lit(0)})
    rumors = stored.where("note_key % 4 = 0").select("id", F.lit("r").alias("sig"), F.lit(2).alias("flags"))
    return tables.promote(stored, rumors.union(rumors)).select("note_key", "flags")


@on_notes("ingest_unknown", "SELECT id, created_at FROM notes WHERE note_key % 3 <> 0")
def ingest_unknown(n: DataFrame) -> DataFrame:
    told = tables.to_json(n.withColumn("sig", F.lit("0" * 128))).select(F.col("json").alias("value"))
    return events.parse(events.unknown(events.envelopes(told), n.where("note_key % 3 = 0"))).select("id", "created_at")


@on_notes("relay_insert", "SELECT note_key, relay FROM relays WHERE note_key % 2 = 1", WITH_RELAYS)
def relay_insert(n: DataFrame) -> DataFrame:
    relays = adapt.relays(n)
    return tables.add_relays(relays.where("note_key % 2 = 0"), relays.union(relays))


@on_notes("fetch_times", "SELECT pubkey, max(created_at) AS fetched_at FROM notes WHERE kind IN (0, 1) GROUP BY pubkey")
def fetch_times(n: DataFrame) -> DataFrame:
    times = lambda k: n.where(F.col("kind") == k).select("pubkey", F.col("created_at").alias("fetched_at"))
    return tables.newer_fetches(times(0), times(1))


# Text.

WORDS_SQL = f"""list_filter(regexp_split_to_array(translate(content, '{text.UPPER}', '{text.LOWER}'), '{text.SEPARATORS}'), lambda x: x <> '')"""


@on_documents("tokens", f"SELECT note_key, unnest({WORDS_SQL}) AS word, unnest(range(len({WORDS_SQL})))::INT AS word_index FROM notes")
def tokens(n: DataFrame) -> DataFrame:
    return search.tokens(n).select("note_key", "word", "word_index")


def hits_sql(*prefixes: str) -> str:
    return " AND ".join(f"len(list_filter({WORDS_SQL}, lambda x: strlen(x) >= 2 AND starts_with(x, '{p}'))) > 0" for p in prefixes)


def searched(name: str, asked: str, prefixes: list[str], limit: int, ascending: bool = False) -> None:
    order = "ORDER BY created_at, note_key" if ascending else NEWEST
    sql = f"SELECT note_key, created_at FROM notes WHERE {hits_sql(*prefixes)} {order} LIMIT {limit or 10**9}"
    on_documents(name, sql)(lambda n: search.search(n, asked, limit, ascending).select("note_key", "created_at"))


searched("search_exact", "the", ["the"], 128)
searched("search_prefix", "Licensed", ["license"[:6]], 0)
searched("search_and", "version apache the", ["versi", "apach", "the"], 0)
searched("search_asc", "leaux de", ["leau", "de"], 20, True)


@on_documents("search_filtered", f"SELECT note_key FROM notes WHERE {hits_sql('versi')} AND created_at < 1700000500 {NEWEST} LIMIT 10")
def search_filtered(n: DataFrame) -> DataFrame:
    return query(n.withColumn("tags", F.array().cast("array<array<string>>")), Filter(search="version", until=1_700_000_500, limit=10)).select("note_key")


@on_documents("search_token_table", f"SELECT note_key FROM notes WHERE {hits_sql('versi', 'licen')}")
def search_token_table(n: DataFrame) -> DataFrame:
    return search.search_tokens(search.tokens(n), "version licens")


@on_documents("word_count", r"SELECT note_key, len(regexp_extract_all(content, '[ \t\n\x0B\f\r][^ \t\n\x0B\f\r]'))::BIGINT AS words FROM notes")
def word_count(n: DataFrame) -> DataFrame:
    return tables.words_per_note(n)


@registered(
    "resolve_pubkeys",
    """SELECT note_key, replace(line, n.pubkey, coalesce(b.name, n.pubkey)) AS line
       FROM (SELECT *, 'from ' || pubkey || ' in ' || kind AS line FROM notes) n LEFT JOIN best b ON n.pubkey = b.pubkey""",
    BEST_SQL,
)
def resolve_pubkeys(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = adapt.notes(spark, sf_dir)
    lines = n.select("note_key", F.concat(F.lit("from "), "pubkey", F.lit(" in "), F.col("kind").cast("string")).alias("line"))
    return tables.resolve_pubkeys(lines, "line", tables.best_names(n), "note_key")


# Counters.

#: Strings alone that are no emoji have a limit of six bytes.
STRINGS = ("+", "-", "a long reaction", "", "🇺🇸🇺🇸", "seven77")
REACTION_SQL = f"CASE WHEN strlen(content) <= 6 OR content NOT IN ({listed(STRINGS)}) THEN content ELSE '+' END"
LAST_E = "last(value ORDER BY pos) FILTER (tag = 'e')"
FIRST_E = "first(value ORDER BY pos) FILTER (tag = 'e')"
POINTED_SQL = (
    TAGGED
    + f""", of AS (SELECT note_key, any_value(id) AS id, any_value(kind) AS kind, any_value(content) AS content, any_value(msats) AS msats,
        {LAST_E} AS last_e, {FIRST_E} AS first_e, list(value ORDER BY pos) FILTER (tag = 'e') AS es,
        first(value ORDER BY pos) FILTER (tag = 'q') AS first_q FROM te GROUP BY note_key),
    pointed AS (
        SELECT last_e AS note_id, 'total_reactions' AS type FROM of WHERE kind = 7
        UNION ALL SELECT first_q, 'quotes' FROM of WHERE kind = 1
        UNION ALL SELECT coalesce(es[2], es[1]), 'direct_replies' FROM of WHERE kind = 1
        UNION ALL SELECT es[1], 'thread_replies' FROM of WHERE kind = 1
        UNION ALL SELECT first_e, 'reposts' FROM of WHERE kind = 6)"""
)

on_notes("reactions_by_str", f"SELECT last_e AS note_id, {REACTION_SQL} AS reaction, count(*) AS n FROM of WHERE kind = 7 GROUP BY ALL", POINTED_SQL)(
    counters.reactions
)
for _name, _f in (
    ("total_reactions", counters.total_reactions),
    ("quotes", counters.quotes),
    ("direct_replies", counters.direct_replies),
    ("thread_replies", counters.thread_replies),
    ("reposts", counters.reposts),
):
    on_notes(_name, f"SELECT note_id, count(*) AS {_name} FROM pointed WHERE type = '{_name}' AND note_id IS NOT NULL GROUP BY note_id", POINTED_SQL)(_f)

COUNTS_SQL = "SELECT note_id, " + ", ".join(f"count(*) FILTER (type = '{c}') AS {c}" for c in counters.COUNTS)
COUNTS_SQL += " FROM pointed WHERE note_id IS NOT NULL GROUP BY note_id"
on_notes("counts_rebuild", COUNTS_SQL, POINTED_SQL)(counters.counts)


@on_notes("meta_upsert", COUNTS_SQL, POINTED_SQL)
def meta_upsert(n: DataFrame) -> DataFrame:
    old, new = counters.counts(n.where("note_key % 2 = 0")), counters.counts(n.where("note_key % 2 = 1"))
    return counters.upsert(old, new, ["note_id"], counters.COUNTS)


@registered(
    "metadata_tidy",
    f"""SELECT note_id, type, '' AS payload, count(*) AS n FROM pointed WHERE note_id IS NOT NULL GROUP BY ALL
        UNION ALL SELECT last_e, 'reaction', {REACTION_SQL}, count(*) FROM of WHERE kind = 7 GROUP BY ALL
        UNION ALL SELECT sha256(doc_id::VARCHAR), 'user_quality', quality::VARCHAR, 1 FROM labels""",
    POINTED_SQL,
)
def metadata_tidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    custom = labels.select(
        adapt.hashed("doc_id").alias("note_id"), F.lit("user_quality").alias("type"), F.col("quality").cast("string").alias("payload"),
        F.lit(1).cast("long").alias("n"),
    )
    return counters.metadata(adapt.notes(spark, sf_dir), custom)


def zap_sums(verified: str) -> str:
    return f"""SELECT last_e AS note_id, count(*) FILTER (NOT {verified}) AS unverified, count(*) FILTER ({verified}) AS verified,
        coalesce(sum(msats) FILTER (NOT {verified}), 0)::BIGINT AS unverified_msats, coalesce(sum(msats) FILTER ({verified}), 0)::BIGINT AS verified_msats
        FROM of WHERE kind = 9735 GROUP BY last_e"""


def as_long(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in ("unverified_msats", "verified_msats")})


@on_notes("zaps_unverified", zap_sums("false"), POINTED_SQL)
def zaps_unverified(n: DataFrame) -> DataFrame:
    return as_long(counters.zaps(n, msats=F.col("msats")))


@on_notes("zaps_verified", zap_sums("(note_key % 3 = 0)"), POINTED_SQL)
def zaps_verified(n: DataFrame) -> DataFrame:
    checked = n.where("kind = 9735 AND note_key % 3 = 0").select(F.col("id").alias("zap_id"))
    return as_long(counters.zaps(n, checked.union(checked), F.col("msats")))


THREADS_SQL = """notes AS (SELECT conv_id, turn FROM conversations)"""
TURN_ID = "sha256(conv_id::VARCHAR || ':' || {}::VARCHAR)"


@on_notes(
    "thread_direct_replies", f"SELECT {TURN_ID.format('(turn - 1)')} AS note_id, count(*) AS direct_replies FROM notes WHERE turn > 0 GROUP BY 1", THREADS_SQL, adapt.threads
)
def thread_direct_replies(n: DataFrame) -> DataFrame:
    return counters.direct_replies(n)


@on_notes("thread_sizes", f"SELECT {TURN_ID.format('0')} AS note_id, count(*) AS thread_replies FROM notes WHERE turn > 0 GROUP BY 1", THREADS_SQL, adapt.threads)
def thread_sizes(n: DataFrame) -> DataFrame:
    return counters.thread_replies(n)


@on_notes(
    "stat_by_kind",
    """SELECT CASE kind WHEN 0 THEN 'profile' WHEN 1 THEN 'text' WHEN 6 THEN 'repost' WHEN 7 THEN 'reaction' WHEN 9735 THEN 'zap' ELSE 'other' END AS kind_name,
       count(*) AS count, count(*) * 8 AS key_bytes, sum(strlen(content) + list_sum([strlen(s) FOR s IN flatten(tags)]))::BIGINT AS value_bytes
       FROM notes GROUP BY 1""",
)
def stat_by_kind(n: DataFrame) -> DataFrame:
    return tables.kind_statistics(n)


@on_notes("stat_tables", "SELECT 'notes' AS \"table\", count(*) AS count FROM notes UNION ALL SELECT 'relays', count(*) FROM relays UNION ALL SELECT 'tags', sum(len(tags))::BIGINT FROM notes", WITH_RELAYS)
def stat_tables(n: DataFrame) -> DataFrame:
    return tables.table_statistics({"notes": n, "relays": adapt.relays(n), "tags": tables.tag_rows(n)})


@on_notes("distinct_kinds", "SELECT DISTINCT kind FROM notes")
def distinct_kinds(n: DataFrame) -> DataFrame:
    return tables.distinct_kinds(n)


# Scalar functions.


@on_notes(
    "event_id_hash",
    """SELECT note_key, sha256('[0,"' || pubkey || '",' || created_at || ',' || kind || ',['
           || array_to_string([ '["' || array_to_string(t, '","') || '"]' FOR t IN tags ], ',') || '],"' || replace(content, '"', '\\"') || '"]') AS event_id
       FROM notes""",
)
def event_id_hash(n: DataFrame) -> DataFrame:
    c = F.col
    return n.select("note_key", text.event_id(c("pubkey"), c("created_at"), c("kind"), c("tags"), c("content")).alias("event_id"))


@on_notes("reaction_normalise", f"SELECT note_key, {REACTION_SQL} AS reaction FROM notes WHERE kind = 7")
def reaction_normalise(n: DataFrame) -> DataFrame:
    return n.where("kind = 7").select("note_key", text.reaction(F.col("content")).alias("reaction"))


@on_notes("tag_index", "SELECT note_key, pos::INT AS pos, tag, value, regexp_full_match(value, '[0-9a-fA-F]{64}') AS is_id FROM te", TAGGED)
def tag_index(n: DataFrame) -> DataFrame:
    return tables.tag_rows(n).select("note_key", "pos", "tag", "value", "is_id")


@on_notes("parse_reply", "SELECT note_key, es[1] AS root, es[2] AS reply, coalesce(es[2], es[1]) AS target FROM of", POINTED_SQL)
def parse_reply(n: DataFrame) -> DataFrame:
    t = F.col("tags")
    return n.select("note_key", tags.root(t).alias("root"), tags.reply(t).alias("reply"), tags.reply_target(t).alias("target"))


@on_notes(
    "note_json",
    """SELECT note_key, '{"id":"' || id || '","pubkey":"' || pubkey || '","created_at":' || created_at || ',"kind":' || kind || ',"tags":['
           || array_to_string([ '["' || array_to_string(t, '","') || '"]' FOR t IN tags ], ',') || '],"content":"' || replace(content, '"', '\\"')
           || '","sig":"' || repeat('0', 128) || '"}' AS json FROM notes""",
)
def note_json(n: DataFrame) -> DataFrame:
    return tables.to_json(n.withColumn("sig", F.lit("0" * 128)))


@on_notes("ingest_lines", "SELECT id, pubkey, created_at, kind, content, len(tags) AS n_tags FROM notes")
def ingest_lines(n: DataFrame) -> DataFrame:
    told = tables.to_json(n.withColumn("sig", F.lit("0" * 128)))
    line = F.when(F.col("note_key") % 3 == 0, F.concat(F.lit('["EVENT","s",'), "json", F.lit("]")))
    line = line.when(F.col("note_key") % 3 == 1, F.concat(F.lit('["EVENT",'), "json", F.lit("]"))).otherwise(F.col("json"))
    lines = told.select(line.alias("value"))
    other = n.sparkSession.createDataFrame([('["EOSE","s"]',), ('["OK","x",true,""]',), ("{bad",), ("",), ('["EVENT",{"id":"x"}]',)], "value string")
    parsed = events.deduplicated(events.parse(events.envelopes(lines.union(other).union(lines))))
    return parsed.select("id", "pubkey", "created_at", "kind", "content", F.size("tags").cast("long").alias("n_tags"))


@registered("content_urls", "SELECT page_id, regexp_extract(url, '^(.*?)[.,]?$', 1) AS url FROM pages", "x AS (SELECT 1)")
def content_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    told = content.blocks(F.concat(F.lit("see ("), "url", F.lit(") or "), "url"))
    found = F.filter(told, lambda b: b["type"] == "url")
    # Addresses in the two places are the same but for the bracket that closes.
    return p.select("page_id", found.alias("b")).select("page_id", F.element_at("b", -1)["text"].alias("url"))


@registered("content_blocks")
def content_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    blocks = content.blocks(F.concat(F.lit("#page "), "url", F.lit(" "), F.coalesce("html", F.lit(""))))
    return p.select("page_id", F.posexplode(blocks).alias("idx", "b")).select("page_id", "idx", "b.type", "b.text", "b.start", "b.len")


# Documents without links, tags and mentions, as those of the test tables, are one text block each; SQL can say no more.
@on_documents("document_blocks", "SELECT note_key, 'text' AS type, content AS text FROM notes WHERE content <> ''")
def document_blocks(n: DataFrame) -> DataFrame:
    return tables.block_rows(n).select("note_key", "type", "text")


@on_documents("document_blocks_all")
def document_blocks_all(n: DataFrame) -> DataFrame:
    """The blocks of all documents with their places; ``content_parts`` has SQL for every type of block."""
    return tables.block_rows(n).select("note_key", "idx", "type", "text", "start", "len")


def spread(n: DataFrame, key: str = "note_key") -> DataFrame:
    """Rows dealt to all cores, for functions that take long: a small table may be one file."""
    return n.repartition(2 * n.sparkSession.sparkContext.defaultParallelism, key)


def entities_of(note: dict) -> list[str]:
    """One entity for the id of a note and one for its author, of all kinds in turn."""
    own, author = bytes.fromhex(note["id"]), bytes.fromhex(note["pubkey"])
    relay, kind = b"\1\x08wss://r1", b"\3\4" + note["kind"].to_bytes(4, "big")
    of_id = [("note", own), ("nsec", own), ("nevent", b"\0\x20" + own + relay + b"\2\x20" + author + kind)]
    of_author = [("npub", author), ("nprofile", b"\0\x20" + author + relay), ("naddr", b"\0\1d\2\x20" + author + kind), ("nrelay", b"\0\x08wss://r1")]
    return [codecs.bech32_encode(*forms[note["note_key"] % len(forms)]) for forms in (of_id, of_author)]


@on_notes("bech32_decode")
def bech32_decode(n: DataFrame) -> DataFrame:
    told = codecs.mapped(entities_of, T.ArrayType(T.StringType()))(F.struct("note_key", "id", "pubkey", "kind"))
    return spread(n).select(F.explode(told).alias("value")).select("value", codecs.bech32_entity(F.col("value")).alias("e")).select("value", "e.*")


OWN, TEAM, SEALER, WRAPPER = (hashlib.sha256(name).digest() for name in (b"own", b"team", b"sealer", b"wrapper"))


def envelopes_of(notes: list[dict]) -> list[dict]:
    """Notes in envelopes of one's own, one in 256 as a gift and one for a team: their signatures take long."""
    outer, key, own = crypto.private_keys(OWN)
    team, team_key = crypto.team_keys(TEAM)
    nonces = [bytes.fromhex(note["id"]) for note in notes]
    inner = [json.dumps({f: note[f] for f in ("created_at", "kind", "tags")} | {"content": note["content"] or ""}).encode() for note in notes]
    # What kind of envelope, by whom and under which key.
    forms = [(crypto.PRIVATE, outer, key)] * len(notes)
    sealed = [i for i, nonce in enumerate(nonces) if nonce[0] <= 1]
    receivers = [team if nonces[i][0] else own for i in sealed]
    contents = crypto.encrypt_each([crypto.conversation_key(SEALER, r) for r in receivers], [inner[i] for i in sealed], [nonces[i] for i in sealed])
    told_of = {"pubkey": crypto.public_key(SEALER).hex(), "kind": crypto.SEAL, "tags": []}
    seals = [told_of | {"created_at": notes[i]["created_at"], "content": content_} for i, content_ in zip(sealed, contents, strict=True)]
    ids = [crypto.commitment(seal) for seal in seals]
    gift = crypto.WRAP, crypto.public_key(WRAPPER), crypto.conversation_key(WRAPPER, own)
    for i, seal, id_, sig in zip(sealed, seals, ids, points.sign_each(SEALER, ids, bytes(32)), strict=True):
        inner[i] = json.dumps(seal | {"id": id_.hex(), "sig": sig.hex()}).encode()
        forms[i] = (crypto.TEAM, team, team_key) if nonces[i][0] else gift
    told = crypto.encrypt_each([form[2] for form in forms], inner, nonces)
    return [{"kind": kind, "pubkey": by.hex(), "content": text_} for (kind, by, _), text_ in zip(forms, told, strict=True)]


def enveloped(n: DataFrame) -> DataFrame:
    put = codecs.mapped_together(envelopes_of, codecs.struct(kind=T.LongType(), pubkey=T.StringType(), content=T.StringType()))
    wrapped = spread(n).select("note_key", "id", put(F.struct("id", "created_at", "kind", "tags", "content")).alias("e")).select("note_key", "id", "e.*")
    return materialise(wrapped, "envelopes")


@on_notes("envelope_unwrap")
def envelope_unwrap(n: DataFrame) -> DataFrame:
    return crypto.unwrapped(enveloped(n), crypto.Keys((OWN,), (TEAM,))).select("id", "created_at", "content", "envelope_id", "flags")


SEALED_BY, MINE, OURS = crypto.public_key(SEALER).hex(), crypto.public_key(OWN).hex(), crypto.team_keys(TEAM)[0].hex()


def id_sql(author: str) -> str:
    """The id of an event of that author."""
    return f"""sha256('[0,"' || {author} || '",' || created_at || ',' || kind || ',['
        || array_to_string([ '["' || array_to_string(t, '","') || '"]' FOR t IN tags ], ',') || '],"' || replace(coalesce(content, ''), '"', '\\"') || '"]')"""


@on_notes(
    "envelope_rumors",
    f"""SELECT id AS envelope_id, {id_sql("author")} AS id, author AS pubkey, receiver, id AS in_envelope, true AS rumor
        FROM (SELECT note_key, id, created_at, kind, tags, content, CASE WHEN id >= '02' THEN '{MINE}' ELSE '{SEALED_BY}' END AS author,
                     CASE WHEN id >= '01' AND id < '02' THEN '{OURS}' ELSE '{MINE}' END AS receiver FROM notes)""",
)
def envelope_rumors(n: DataFrame) -> DataFrame:
    found = crypto.unwrapped(enveloped(n), crypto.Keys((OWN,), (TEAM,)))
    receiver, envelope = crypto.rumor_receiver(F.col("sig")), crypto.rumor_envelope(F.col("sig"))
    return found.select("envelope_id", "id", "pubkey", receiver.alias("receiver"), envelope.alias("in_envelope"), crypto.is_rumor(F.col("flags")).alias("rumor"))


@on_notes("reprocess_envelopes", "SELECT note_key, CASE WHEN note_key % 4 = 0 OR id < '01' OR id >= '02' THEN 4 ELSE 0 END AS flags FROM notes")
def reprocess_envelopes(n: DataFrame) -> DataFrame:
    """A key opens what wasn't opened before, every fourth; the team's envelopes stay shut, as its key isn't there."""
    stored = enveloped(n).withColumn("flags", F.when(F.col("note_key") % 4 == 0, crypto.UNWRAPPED).otherwise(0))
    return crypto.reprocess(stored, crypto.Keys((OWN,)))[1].select("note_key", "flags")


@on_notes("sealed_payloads", "SELECT note_key, '>' || content AS content FROM notes")
def sealed_payloads(n: DataFrame) -> DataFrame:
    """What is opened is what was sealed."""
    key, back = crypto.conversation_key(OWN, crypto.public_key(SEALER)), crypto.conversation_key(SEALER, crypto.public_key(OWN))

    def seal_each(rows: list[dict]) -> list[str | None]:
        whole = [v for v in rows if v["content"] is not None]
        told = iter(crypto.encrypt_each([key] * len(whole), [v["content"].encode() for v in whole], [bytes.fromhex(v["id"]) for v in whole]))
        return [None if v["content"] is None else next(told) for v in rows]

    def open_each(payloads: list[str | None]) -> list[str | None]:
        return [text_ and text_.decode() for text_ in crypto.decrypt_each([back] * len(payloads), payloads)]

    seal, opened = codecs.mapped_together(seal_each, T.StringType()), codecs.mapped_together(open_each, T.StringType())
    sealed = spread(n).select("note_key", seal(F.struct(F.concat(F.lit(">"), "content").alias("content"), "id")).alias("sealed"))
    return sealed.select("note_key", opened(F.col("sealed")).alias("content"))


def signatures_of(rows: list[dict | None]) -> list[str | None]:
    told = iter(points.sign_each(OWN, [bytes.fromhex(v["id"]) for v in rows if v], bytes(32)))
    return [v and next(told).hex() for v in rows]


@on_notes("signature_check", "SELECT note_key, note_key % 3 <> 0 AS valid FROM notes")
def signature_check(n: DataFrame) -> DataFrame:
    """Of every third note the signature is that of another id."""
    other = F.when(F.col("note_key") % 3 == 0, F.sha2("id", 256)).otherwise(F.col("id"))
    signed = spread(n).select("note_key", "id", codecs.mapped_together(signatures_of, T.StringType())(F.struct(other.alias("id"))).alias("sig"))
    return signed.select("note_key", crypto.verified(F.lit(MINE), F.col("id"), F.col("sig")).alias("valid"))


def own_id() -> Column:
    c = F.col
    return text.event_id(F.lit(MINE), c("created_at"), c("kind"), c("tags"), c("content"))


def written_lines(n: DataFrame) -> str:
    """Lines of events in files: signed by one author, every fifth with a signature that isn't its own, kind 7 with none."""
    own = spread(n).withColumns({"pubkey": F.lit(MINE), "id": own_id()})
    of = F.when(F.col("note_key") % 5 == 0, F.sha2("id", 256)).otherwise(F.col("id"))
    made = codecs.mapped_together(signatures_of, T.StringType())(F.when(F.col("kind") != 7, F.struct(of.alias("id"))))
    path = fresh_path(n.sparkSession, "lines")
    tables.to_json(own.withColumn("sig", F.coalesce(made, F.lit("0" * 128)))).select("json").write.text(path)
    return path


@on_notes("ingest_checked", f"SELECT {id_sql(repr(MINE))} AS id, kind FROM notes WHERE kind <> 6 AND (kind = 7 OR note_key % 5 <> 0) AND created_at >= {SINCE}")
def ingest_checked(n: DataFrame) -> DataFrame:
    """Files of lines, an ingest filter that refuses kind 6 and trusts kind 7, checks of ids and signatures, and notes that are stored before."""
    stored = n.where(F.col("created_at") < SINCE).select(own_id().alias("id"))
    decision = F.when(F.col("kind") == 6, events.REJECT).when(F.col("kind") == 7, events.SKIP_CHECKS).otherwise(events.ACCEPT)
    return events.ingest(n.sparkSession, written_lines(n), stored=stored, decision=decision)[0].select("id", "kind")


@registered("ingest_relays", "SELECT id, 'wss://a' AS relay FROM notes UNION ALL SELECT id, 'wss://b' FROM notes WHERE note_key % 2 = 0")
def ingest_relays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relays of duplicates count, also where the note is stored already."""
    # Files that are packed can't be cut, so all cores write some. Rows are dealt before they are made notes, which are much longer.
    dealt = adapt.notes_of(spread(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id"))
    stored = adapt.notes(spark, sf_dir).where("note_key % 3 = 0")
    seen = []
    for relay, part in (("wss://a", dealt.union(dealt)), ("wss://b", dealt.where("note_key % 2 = 0"))):
        path = fresh_path(spark, "lines")
        tables.to_json(part.withColumn("sig", F.lit("0" * 128))).select("json").write.text(path, compression="gzip")
        seen.append(events.ingest(spark, path, relay, stored, verify=False)[1])
    return seen[0].union(seen[1])


NPUB = codecs.bech32_encode("npub", bytes.fromhex(pubkey(3)))
REQUEST = codecs.encode_invoice("25u", 1_700_000_000, "coffee")
#: Contents put together from blocks, in SQL: type, what stands before the block's text, and the text.
PARTS = [
    ("text", "''", "'é '"), ("hashtag", "'#'", "'tag' || (note_key % 7)"), ("text", "''", "' then '"),
    ("url", "''", "'https://h' || (note_key % 11) || '.example/p?q=' || (note_key % 3)"), ("text", "''", "' and '"),
    ("mention_index", "''", "'#[' || (note_key % 10) || ']'"), ("text", "''", "' by '"), ("mention_bech32", "'@'", f"'{NPUB}'"),
    ("text", "''", "' pay '"), ("invoice", "''", f"'{REQUEST}'"), ("text", "''", "' end'"),
]


def block_sql(idx: int) -> str:
    kind, before, value = PARTS[idx]
    start = " || ".join([f"{b} || {v}" for _, b, v in PARTS[:idx]] + [before])
    more = {"mention_index": "note_key % 10", "mention_bech32": f"'{pubkey(3)}'", "invoice": "2500000"}
    index, author, amount = (more[k] if k == kind else "NULL" for k in more)
    return (
        f"SELECT note_key, {idx} AS idx, '{kind}' AS type, {value} AS text, length({start}) AS start, "
        f"{index} AS mention_index, {author} AS pubkey, {amount} AS amount_msat FROM notes"
    )


@on_notes("content_parts", " UNION ALL ".join(map(block_sql, range(len(PARTS)))))
def content_parts(n: DataFrame) -> DataFrame:
    """Blocks of every type, with what they decode to."""
    told = spread(n).select("note_key", F.expr(" || ".join(f"{before} || {value}" for _, before, value in PARTS)).alias("content"))
    rows = told.select("note_key", F.posexplode(content.blocks(F.col("content"))).alias("idx", "b"))
    decoded = [F.col("b.mention_index"), F.col("b.bech32.pubkey").alias("pubkey"), F.col("b.invoice.amount_msat").alias("amount_msat")]
    return rows.select("note_key", "idx", "b.type", "b.text", "b.start", *decoded)


@on_notes(
    "bech32_fields",
    """SELECT note_key, 0 AS pos, ['note', 'nsec', 'nevent'][note_key % 3 + 1] AS type, id,
              CASE WHEN note_key % 3 = 2 THEN pubkey END AS pubkey, CASE WHEN note_key % 3 = 2 THEN ['wss://r1'] ELSE [] END AS relays,
              CASE WHEN note_key % 3 = 2 THEN kind END AS kind, NULL AS identifier FROM notes
       UNION ALL
       SELECT note_key, 1, ['npub', 'nprofile', 'naddr', 'nrelay'][note_key % 4 + 1], NULL, CASE WHEN note_key % 4 < 3 THEN pubkey END,
              CASE WHEN note_key % 4 IN (1, 3) THEN ['wss://r1'] ELSE [] END, CASE WHEN note_key % 4 = 2 THEN kind END,
              CASE WHEN note_key % 4 = 2 THEN 'd' END FROM notes""",
)
def bech32_fields(n: DataFrame) -> DataFrame:
    """What entities decode to is what they were made from."""
    told = codecs.mapped(entities_of, T.ArrayType(T.StringType()))(F.struct("note_key", "id", "pubkey", "kind"))
    rows = spread(n).select("note_key", F.posexplode(told).alias("pos", "value"))
    return rows.select("note_key", "pos", codecs.bech32_entity(F.col("value")).alias("e")).select("note_key", "pos", "e.*")


AMOUNT_SQL = "(note_key % 900 + 1)"
MSATS_SQL = f"CASE note_key % 5 WHEN 0 THEN {AMOUNT_SQL} * 100000000 WHEN 1 THEN {AMOUNT_SQL} * 100000 WHEN 2 THEN {AMOUNT_SQL} * 100 WHEN 3 THEN {AMOUNT_SQL} END"


def invoice_of(note: dict) -> str:
    """A request whose amount has each of the letters in turn, or is missing."""
    k = note["note_key"] % 900 + 1
    amount = (f"{k}m", f"{k}u", f"{k}n", f"{10 * k}p", "")[note["note_key"] % 5]
    return codecs.encode_invoice(amount, note["created_at"], f"note {k}", 60 * k)


def with_invoices(n: DataFrame) -> DataFrame:
    return n.withColumn("invoice", codecs.mapped(invoice_of, T.StringType())(F.struct("note_key", "created_at")))


@on_notes(
    "invoice_decode",
    f"""SELECT note_key, {MSATS_SQL} AS amount_msat, created_at AS timestamp, 60 * {AMOUNT_SQL} AS expiry, 'note ' || {AMOUNT_SQL} AS description,
        NULL AS description_hash FROM notes""",
)
def invoice_decode(n: DataFrame) -> DataFrame:
    return with_invoices(spread(n)).select("note_key", codecs.invoice(F.col("invoice")).alias("i")).select("note_key", "i.*")


@on_notes(
    "zaps_bolt11",
    f"""SELECT last_e AS note_id, count(*) AS unverified, 0 AS verified, coalesce(sum({MSATS_SQL}), 0)::BIGINT AS unverified_msats, 0 AS verified_msats
        FROM of WHERE kind = 9735 GROUP BY last_e""",
    POINTED_SQL,
)
def zaps_bolt11(n: DataFrame) -> DataFrame:
    """Zaps whose amounts are decoded from the requests in their tags."""
    paid = with_invoices(n).withColumn("tags", F.concat("tags", F.array(F.array(F.lit("bolt11"), "invoice"))))
    return as_long(counters.zaps(paid))


@on_notes("emoji_codec", f"SELECT note_key, content AS emoji FROM notes WHERE kind = 7 AND content NOT IN ({listed(STRINGS)})")
def emoji_codec(n: DataFrame) -> DataFrame:
    """Emoji to their numbers and back."""
    found = n.where((F.col("kind") == 7) & ~F.col("content").isin(*STRINGS))
    return found.select("note_key", codecs.emoji_text(codecs.emoji_key(F.col("content")), ("👩‍🤝‍👩", "🏴‍☠️")).alias("emoji"))


@on_notes("visit_until", f"SELECT note_key FROM notes WHERE kind = 7 {NEWEST} LIMIT 12")
def visit_until(n: DataFrame) -> DataFrame:
    """The rows that a visitor gets before it ends the visit."""
    seen: list[int] = []

    def visitor(row) -> bool:
        seen.append(row["note_key"])
        return len(seen) < 12

    visit(n, [Filter(kinds=[7], limit=100)], visitor)
    return n.sparkSession.createDataFrame([(k,) for k in seen], "note_key long")


def filter_cases() -> list[tuple[str, str]]:
    wide = Filter(kinds=[6, 1], since=5, limit=9)
    narrow = Filter(kinds=[1, 6], since=5, limit=9, authors=AUTHORS)
    plans = [
        Filter(), Filter(kinds=[0], search="x"), Filter(search="x"), Filter(ids=IDS), Filter(kinds=[1], relays=RELAYS), Filter(kinds=[1], authors=AUTHORS),
        Filter(authors=AUTHORS[:1]), Filter(tags={"t": ["a"]}), Filter(kinds=[1]), Filter(since=1),
    ]
    yes = lambda b: "yes" if b else "no"
    return [
        ("json", wide.to_json()), ("read back", yes(Filter.from_json(narrow.to_json()) == narrow)), ("order is no part", yes(wide == Filter(kinds=[1, 6], since=5, limit=9))),
        ("subset", yes(narrow.is_subset_of(wide))), ("no subset", yes(wide.is_subset_of(narrow))), ("plans", " ".join(map(plan_name, plans))),
    ]


@on_notes(
    "filter_functions",
    """SELECT * FROM (VALUES ('json', '{"kinds":[1,6],"since":5,"limit":9}'), ('read back', 'yes'), ('order is no part', 'yes'), ('subset', 'yes'), ('no subset', 'no'),
       ('plans', 'all_notes profile_search search ids relay_kinds author_kinds authors tags kinds created')) v(name, value)""",
)
def filter_functions(n: DataFrame) -> DataFrame:
    return n.sparkSession.createDataFrame(filter_cases(), "name string, value string")


# Maintenance and streams.


@on_notes("compact", f"SELECT id, pubkey, kind, created_at FROM notes WHERE kind = 0 OR pubkey IN ({listed(AUTHORS)})")
def compact(n: DataFrame) -> DataFrame:
    return maintenance.compact(n, AUTHORS).select("id", "pubkey", "kind", "created_at")


@on_notes("snapshot", f"SELECT {ROW_SQL} FROM notes")
def snapshot(n: DataFrame) -> DataFrame:
    path = fresh_path(n.sparkSession, "snapshot")
    maintenance.snapshot({"notes": n}, path)
    return maintenance.load(n.sparkSession, path)["notes"].select(ROW)


def note_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes in three files, which arrive one after the other."""
    folder = fresh_path(spark, "arriving")
    found = spark.read.parquet(f"{sf_dir}/events.parquet")
    found.repartition(3, "event_id").write.parquet(folder)
    return adapt.notes_of(live.file_stream(spark, folder, "*.parquet", found.schema, files_per_batch=1))


@registered("stream_subscription", f"SELECT {ROW_SQL} FROM notes WHERE kind = 7 OR (kind = 1 AND list_bool_or([x[1] = 't' AND x[2] = '3' FOR x IN tags]))")
def stream_subscription(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "matches")
    wanted = [Filter(kinds=[7]), Filter(kinds=[1], tags={"t": ["3"]}), Filter(kinds=[7], since=SINCE)]
    found = live.matches(note_stream(spark, sf_dir), wanted).select(ROW)
    live.run_once(found, live.batches(path), "subscription")
    return live.stored(spark, path, found.schema)


def streamed_counts(spark: SparkSession, sf_dir: str) -> str:
    path = fresh_path(spark, "counts")
    live.count(note_stream(spark, sf_dir), path, F.col("msats"), fold=2)
    return path


@registered("stream_counts", COUNTS_SQL, POINTED_SQL)
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.counted(spark, streamed_counts(spark, sf_dir))


@registered("stream_reactions", f"SELECT last_e AS note_id, {REACTION_SQL} AS reaction, count(*) AS n FROM of WHERE kind = 7 GROUP BY ALL", POINTED_SQL)
def stream_reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.counted_reactions(spark, streamed_counts(spark, sf_dir))


@registered("stream_zaps", "SELECT last_e AS note_id, count(*) AS zaps, sum(msats)::BIGINT AS msats FROM of WHERE kind = 9735 GROUP BY last_e", POINTED_SQL)
def stream_zaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.counted_zaps(spark, streamed_counts(spark, sf_dir))


@registered("stream_dedupe", "SELECT id, kind FROM notes WHERE note_key % 5 <> 0")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each note comes twice, in a batch of its own and in a later one; every fifth is stored before."""
    path, again = fresh_path(spark, "stored"), fresh_path(spark, "arriving")
    events_of = spark.read.parquet(f"{sf_dir}/events.parquet")
    for _ in range(2):
        events_of.repartition(2, "event_id").write.mode("append").parquet(again)
    notes = adapt.notes_of(live.file_stream(spark, again, "*.parquet", events_of.schema, files_per_batch=1)).select("id", "kind")
    live.store(notes, path, adapt.notes(spark, sf_dir).where("note_key % 5 = 0"))
    return live.stored(spark, path, notes.schema)
