"""Tables derived from notes, look-ups, joins and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.functions import tags, text
from tidewell.schema import KIND_NAMES, PROFILE, PROFILE_KIND, TEXT_KINDS, is_id, is_replaceable
from tidewell.storage import materialise


def tag_rows(notes: DataFrame) -> DataFrame:
    """note_key, created_at, kind, pos, tag, value, n_items, is_id: a row for each tag."""
    rows = notes.select("note_key", "created_at", "kind", F.posexplode("tags").alias("pos", "t"))
    value = F.get("t", 1)
    return rows.select(
        "note_key", "created_at", "kind", "pos", F.get("t", 0).alias("tag"), value.alias("value"),
        F.size("t").alias("n_items"), is_id(value).alias("is_id"),
    )


def by_id(notes: DataFrame, note_id: str) -> DataFrame:
    return notes.where(F.col("id") == note_id.lower())


def by_key(notes: DataFrame, note_key: int) -> DataFrame:
    return notes.where(F.col("note_key") == note_key)


#: Times and keys in one number: keys have 64 bits.
KEYS = "18446744073709551616"


def newest_keys(notes: DataFrame, *keys: Column) -> DataFrame:
    """note_key of the newest note of each value of ``keys``. Time and key are one number, which a hash aggregate can hold."""
    at = F.col("created_at").cast("decimal(38,0)") * F.expr(f"CAST({KEYS} AS DECIMAL(20,0))") + F.col("note_key")
    found = notes.groupBy(*(k.alias(f"_{i}") for i, k in enumerate(keys))).agg(F.max(at).alias("_at"))
    return found.select(F.expr(f"CAST(_at % CAST({KEYS} AS DECIMAL(20,0)) AS BIGINT)").alias("note_key"))


def latest(notes: DataFrame, key: str) -> DataFrame:
    """The newest note of each value of ``key``. Three columns are aggregated, and the rows of the keys found are
    taken by a hash join: no row is sorted. ``note_key`` is unique."""
    return notes.join(newest_keys(notes, F.col(key)).hint("shuffle_hash"), "note_key", "left_semi").select(notes.columns)


def latest_before(notes: DataFrame, key: str, until: int) -> DataFrame:
    """The newest note of each value of ``key`` before a time."""
    return latest(notes.where(F.col("created_at") < until), key)


#: Seconds of a span of time that is searched by itself.
SPAN = 3600


def as_of(left: DataFrame, right: DataFrame, key: str, value: str, span: int = SPAN) -> DataFrame:
    """``left`` with ``value`` of the last row of ``right`` of its key that isn't newer and has one.

    The rows of both go through sorted windows, so a key's pairs are never formed. A window is a key's
    ``span`` of seconds, so a key with most rows fills many: the last value of each span is carried into later
    ones by a window over a row for each span.
    """
    at = F.expr(f"created_at div {span}").alias("_span")
    known = right.where(F.col(value).isNotNull())
    mine = left.select(key, "created_at", at, F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    theirs = known.select(key, "created_at", at, F.lit(None).cast(mine.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"))
    lasts = known.groupBy(key, at).agg(F.max_by(value, "created_at").alias("_last"))
    asked = left.select(key, at).distinct().withColumn("_last", F.lit(None).cast(right.schema[value].dataType))
    spans = asked.unionByName(lasts).groupBy(key, "_span").agg(F.max("_last").alias("_last"))
    before = Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(key, "_span", F.last("_last", ignorenulls=True).over(before).alias("_v")).where("_v IS NOT NULL")
    carried = carried.select(key, F.lit(-1).cast("long").alias("created_at"), "_span", F.lit(None).cast(mine.schema["_row"].dataType).alias("_row"), "_v")
    # At equal times the right side's rows come first.
    order = Window.partitionBy(key, "_span").orderBy("created_at", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = mine.unionByName(theirs).unionByName(carried).withColumn("_last", F.last("_v", ignorenulls=True).over(order))
    return both.where("_row IS NOT NULL").select("_row.*", F.col("_last").alias(value))


def profiles(notes: DataFrame) -> DataFrame:
    """note_key, pubkey, created_at and the parsed profile of each kind-0 note whose content is an object."""
    rows = notes.where(F.col("kind") == PROFILE_KIND)
    rows = rows.select("note_key", "pubkey", "created_at", F.from_json("content", PROFILE).alias("profile"))
    return rows.where("profile IS NOT NULL").withColumn("lnurl", F.coalesce("profile.lud16", "profile.lud06"))


def latest_profiles(notes: DataFrame) -> DataFrame:
    return latest(profiles(notes), "pubkey")


def best_names(notes: DataFrame) -> DataFrame:
    """pubkey and name: of the latest profile the display name, else the name."""
    p = F.col("profile")
    name = F.coalesce(F.nullif(p["display_name"], F.lit("")), F.nullif(p["name"], F.lit("")))
    return latest_profiles(notes).select("pubkey", name.alias("name"))


def resolve_pubkeys(lines: DataFrame, column: str, names: DataFrame, key: str | None = None) -> DataFrame:
    """``lines`` with the pubkeys in a text column replaced by their names, where they have any.

    The pubkeys that occur are met with their names in one join, whose result is
    gathered by line: no table of names goes to each task. ``key`` is a column that tells lines apart; without one
    they are numbered and stored, as a number that is computed twice may differ.
    """
    keyed = lines.withColumn("_line", F.col(key)) if key else materialise(lines.withColumn("_line", F.monotonically_increasing_id()), "lines")
    found = F.array_distinct(F.regexp_extract_all(F.col(column), F.lit("([0-9a-fA-F]{64})"), F.lit(1)))
    hits = keyed.select("_line", F.explode(found).alias("raw")).withColumn("pubkey", F.lower("raw"))
    named = hits.join(names.where("name IS NOT NULL"), "pubkey")
    pairs = named.groupBy("_line").agg(F.collect_list(F.struct("raw", "name")).alias("_pairs"))
    replaced = F.aggregate(F.coalesce("_pairs", F.array().cast("array<struct<raw:string,name:string>>")), F.col(column), lambda s, p: F.replace(s, p["raw"], p["name"]))
    return keyed.join(pairs, "_line", "left").withColumn(column, replaced).drop("_line", "_pairs")


def with_profile(notes: DataFrame) -> DataFrame:
    """Notes with the best name of their author, or else the pubkey."""
    out = notes.join(best_names(notes), "pubkey", "left")
    return out.withColumn("name", F.coalesce("name", "pubkey"))


def relays_of(relays: DataFrame, note_key: int) -> DataFrame:
    return relays.where(F.col("note_key") == note_key).select("relay").distinct().orderBy("relay")


def seen_on(notes: DataFrame, relays: DataFrame, relay: str) -> DataFrame:
    """Notes that were seen on a relay."""
    return notes.join(relays.where(F.col("relay") == relay).select("note_key"), "note_key", "left_semi")


def relays_per_note(relays: DataFrame) -> DataFrame:
    """note_key and its number of relays."""
    return relays.groupBy("note_key").agg(F.count_distinct("relay").alias("n_relays"))


def latest_versions(notes: DataFrame) -> DataFrame:
    """Notes without versions that a later note replaces: of replaceable kinds the newest of each author and kind.

    Kinds from 30000 on are told apart by the value of their d tag, too. The table itself keeps all versions.
    """
    kind = F.col("kind")
    named = F.when(kind >= 30_000, F.coalesce(tags.first_value(F.col("tags"), "d"), F.lit(""))).otherwise(F.lit(""))
    key = F.when(is_replaceable(kind), F.struct("pubkey", "kind", named.alias("d")))
    keyed = notes.withColumn("_key", key)
    versions = keyed.where("_key IS NOT NULL")
    replaced = versions.join(newest_keys(versions, F.col("_key")).hint("shuffle_hash"), "note_key", "left_semi")
    return keyed.where("_key IS NULL").unionByName(replaced).select(notes.columns)


def promote(stored: DataFrame, rumors: DataFrame) -> DataFrame:
    """Stored notes, those that came in an envelope since with its signature field and flags. Keys stay."""
    fresh = rumors.groupBy("id").agg(F.min(F.struct("sig", "flags")).alias("_r"))
    out = stored.join(fresh, "id", "left")
    return out.withColumns(
        {"sig": F.coalesce("_r.sig", "sig"), "flags": F.coalesce(F.col("flags").bitwiseOR(F.col("_r.flags")), F.col("flags"))}
    ).select(stored.columns)


def block_rows(notes: DataFrame, any_kind: bool = False) -> DataFrame:
    """note_key, idx and the fields of each block of the contents."""
    from tidewell.functions import content

    rows = notes if any_kind else notes.where(F.col("kind").isin(*TEXT_KINDS))
    return rows.select("note_key", F.posexplode(content.blocks(F.col("content"))).alias("idx", "b")).select("note_key", "idx", "b.*")


def add_relays(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows of ``fresh`` that aren't stored yet."""
    return fresh.select("note_key", "relay").distinct().join(stored, ["note_key", "relay"], "left_anti")


def distinct_kinds(notes: DataFrame) -> DataFrame:
    return notes.select("kind").distinct()


def kind_name(kind: str = "kind") -> Column:
    named = F.create_map(*(F.lit(x) for pair in KIND_NAMES.items() for x in pair))
    return F.coalesce(F.try_element_at(named, F.col(kind).cast("int")), F.lit("other"))


def kind_statistics(notes: DataFrame) -> DataFrame:
    """kind_name, count, key_bytes, value_bytes: of a note's key, and of its content and tags."""
    size = F.aggregate(F.flatten("tags"), F.lit(0).cast("long"), lambda n, s: n + F.octet_length(s))
    return notes.groupBy(kind_name().alias("kind_name")).agg(
        F.count(F.lit(1)).alias("count"),
        (F.count(F.lit(1)) * 8).alias("key_bytes"),
        F.sum(F.octet_length("content") + size).alias("value_bytes"),
    )


def table_statistics(tables: dict[str, DataFrame]) -> DataFrame:
    """table and its number of rows, for the stored and derived tables."""
    parts = [df.select(F.lit(name).alias("table")) for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.groupBy("table").agg(F.count(F.lit(1)).alias("count"))


def newer_fetches(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """pubkey and fetched_at with fresh times where they are newer."""
    return stored.unionByName(fresh).groupBy("pubkey").agg(F.max("fetched_at").alias("fetched_at"))


def words_per_note(notes: DataFrame) -> DataFrame:
    return notes.select("note_key", text.word_count(F.col("content")).alias("words"))


def to_json(notes: DataFrame) -> DataFrame:
    """note_key and the note as JSON, its fields in their usual order."""
    fields = F.struct("id", "pubkey", "created_at", "kind", "tags", "content", "sig")
    return notes.select("note_key", F.to_json(fields).alias("json"))
