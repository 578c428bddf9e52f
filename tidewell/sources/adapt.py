"""The star-schema tables read as notes, relays, threads and documents.

Each has the same expression in SQL beside it, so that a second engine can
derive the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {"view": 1, "click": 7, "purchase": 9735, "signup": 0}
REACTIONS = (
    "+", "-", "🤙", "a long reaction", "", "🇺🇸", "1️⃣", "🏴󠁧󠁢󠁥󠁮󠁧󠁿", "👩🏻‍🤝‍👩🏿", "🏴‍☠️", "👍🏽", "🇺🇸🇺🇸", "seven77",
)


def hashed(value: Column | str) -> Column:
    return F.sha2(F.col(value).cast("string") if isinstance(value, str) else value.cast("string"), 256)


def seconds(column: str) -> Column:
    """Unix seconds of a timestamp without time zone, whatever the session's zone."""
    return F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col(column))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes_of(spark.read.parquet(f"{sf_dir}/events.parquet"))


def notes_of(events: DataFrame) -> DataFrame:
    key, user = F.col("event_id"), F.col("user_id")
    kind = F.lit(6)
    for name, k in reversed(KINDS.items()):
        kind = F.when(F.col("event_type") == name, k).otherwise(kind)
    pubkey = F.sha2(F.concat(F.lit("pk"), user.cast("string")), 256)
    reaction = F.element_at(F.array(*map(F.lit, REACTIONS)), (key % len(REACTIONS) + 1).cast("int"))
    profile = F.concat(F.lit('{"name":"Name'), user % 37, F.lit('","display_name":"Shown'), key % 11, F.lit('"}'))
    content = F.when(F.col("event_type") == "click", reaction).when(F.col("event_type") == "signup", profile).otherwise(F.col("props"))
    always = F.array(
        F.array(F.lit("t"), F.regexp_extract("props", "([0-9]+)", 1)),
        F.array(F.lit("e"), hashed(F.expr("event_id div 10 * 10"))),
        F.array(F.lit("p"), pubkey),
    )
    none = F.array().cast("array<array<string>>")
    second = F.when(key % 4 == 0, F.array(F.array(F.lit("e"), hashed(F.expr("event_id div 100 * 100"))))).otherwise(none)
    quote = F.when(key % 7 == 0, F.array(F.array(F.lit("q"), hashed(F.expr("event_id div 50 * 50"))))).otherwise(none)
    return events.select(
        key.alias("note_key"),
        hashed("event_id").alias("id"),
        pubkey.alias("pubkey"),
        seconds("ts").alias("created_at"),
        kind.cast("long").alias("kind"),
        content.alias("content"),
        F.concat(always, second, quote).alias("tags"),
        F.round(F.col("value") * 1000).cast("long").alias("msats"),
    )


REACTIONS_SQL = ", ".join(f"'{r}'" for r in REACTIONS)
NOTES_SQL = f"""
    notes AS (
        SELECT event_id AS note_key, sha256(event_id::VARCHAR) AS id, sha256('pk' || user_id::VARCHAR) AS pubkey,
               epoch_us(ts) // 1000000 AS created_at,
               (CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 7 WHEN 'purchase' THEN 9735 WHEN 'signup' THEN 0 ELSE 6 END)::BIGINT AS kind,
               CASE event_type WHEN 'click' THEN [{REACTIONS_SQL}][(event_id % {len(REACTIONS)} + 1)::INT]
                    WHEN 'signup' THEN '{{"name":"Name' || (user_id % 37) || '","display_name":"Shown' || (event_id % 11) || '"}}'
                    ELSE props END AS content,
               list_concat([['t', regexp_extract(props, '([0-9]+)', 1)], ['e', sha256((event_id // 10 * 10)::VARCHAR)],
                            ['p', sha256('pk' || user_id::VARCHAR)]],
                   list_concat(CASE WHEN event_id % 4 = 0 THEN [['e', sha256((event_id // 100 * 100)::VARCHAR)]] ELSE []::VARCHAR[][] END,
                               CASE WHEN event_id % 7 = 0 THEN [['q', sha256((event_id // 50 * 50)::VARCHAR)]] ELSE []::VARCHAR[][] END)) AS tags,
               round(value * 1000)::BIGINT AS msats
        FROM events)"""


def relays(notes: DataFrame) -> DataFrame:
    """note_key and relay: one of three for each note, and one more for every fifth."""
    key = F.col("note_key")
    one = F.concat(F.lit("wss://r"), (key % 3).cast("string"))
    both = F.when(key % 5 == 0, F.array(one, F.lit("wss://r9"))).otherwise(F.array(one))
    return notes.select("note_key", F.explode(both).alias("relay"))


RELAYS_SQL = """
    relays AS (
        SELECT note_key, 'wss://r' || (note_key % 3) AS relay FROM notes
        UNION ALL SELECT note_key, 'wss://r9' FROM notes WHERE note_key % 5 = 0)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes of kind 1."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(
        F.col("doc_id").alias("note_key"), hashed("doc_id").alias("id"), hashed("source").alias("pubkey"),
        (F.lit(1_700_000_000) + F.col("doc_id")).alias("created_at"), F.lit(1).cast("long").alias("kind"), F.col("text").alias("content"),
    )


DOCUMENTS_SQL = """
    notes AS (
        SELECT doc_id AS note_key, sha256(doc_id::VARCHAR) AS id, sha256(source) AS pubkey, 1700000000 + doc_id AS created_at,
               1::BIGINT AS kind, text AS content
        FROM documents)"""


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as notes of kind 1 that answer the turn before, in the thread of turn 0."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    named = lambda turn: F.sha2(F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string")), 256)
    turn = F.col("turn")
    none = F.array().cast("array<array<string>>")
    root = F.array(F.array(F.lit("e"), named(F.lit(0))))
    tags = F.when(turn == 0, none).when(turn == 1, root).otherwise(F.concat(root, F.array(F.array(F.lit("e"), named(turn - 1)))))
    return c.select(
        (F.col("conv_id") * 1000 + turn).alias("note_key"), named(turn).alias("id"), hashed("role").alias("pubkey"),
        (F.lit(1_700_000_000) + F.col("conv_id") * 1000 + turn).alias("created_at"), F.lit(1).cast("long").alias("kind"),
        F.col("text").alias("content"), tags.alias("tags"),
    )
