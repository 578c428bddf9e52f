"""Events from newline-delimited JSON: envelopes, parsing, checks, keys and duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import text
from tidewell.schema import EVENT, REPOST_KIND

ACCEPT, REJECT, SKIP_CHECKS = "accept", "reject", "skip_checks"


def envelopes(lines: DataFrame, column: str = "value") -> DataFrame:
    """command, subscription, event and the rest of each line: EVENT, EOSE, OK or AUTH in an array, or a bare object."""
    line = F.trim(F.col(column))
    parts = F.when(F.startswith(line, F.lit("[")), F.from_json(line, "array<string>"))
    # A generator's output is computed once, however often it is used below.
    rows = lines.select("*", F.inline(F.array(F.struct(line.alias("_line"), parts.alias("_p")))))
    head = F.get("_p", 0)
    event = (
        F.when(F.startswith("_line", F.lit("{")), F.col("_line"))
        .when((head == "EVENT") & (F.size("_p") >= 3), F.get("_p", 2))
        .when(head == "EVENT", F.get("_p", 1))
    )
    command = F.when(F.startswith("_line", F.lit("{")), F.lit("EVENT")).otherwise(head)
    subscription = F.when((head == "EOSE") | ((head == "EVENT") & (F.size("_p") >= 3)), F.get("_p", 1))
    return rows.select(
        command.alias("command"),
        subscription.alias("subscription"),
        event.alias("event"),
        F.when(head == "OK", F.get("_p", 1)).alias("ok_id"),
        F.when(head == "OK", F.get("_p", 2) == "true").alias("ok"),
        F.when(head == "OK", F.get("_p", 3)).alias("message"),
        F.when(head == "AUTH", F.get("_p", 1)).alias("challenge"),
        *(c for c in lines.columns if c != column),
    )


def parse(found: DataFrame) -> DataFrame:
    """Typed events of envelopes; what lacks a field or has a malformed one is dropped."""
    extra = [c for c in found.columns if c not in ("command", "subscription", "event", "ok_id", "ok", "message", "challenge")]
    out = found.where("command = 'EVENT'").select(*extra, F.inline(F.array(F.from_json("event", EVENT))))
    out = out.select(*EVENT.fieldNames(), *extra)
    whole = F.lit(True)
    for f in EVENT.fieldNames():
        whole = whole & F.col(f).isNotNull()
    u32 = (1 << 32) - 1
    fits = F.col("created_at").between(0, u32) & F.col("kind").between(0, u32)
    shaped = F.col("id").rlike("^[0-9a-fA-F]{64}$") & F.col("pubkey").rlike("^[0-9a-fA-F]{64}$") & F.col("sig").rlike("^[0-9a-fA-F]{128}$")
    return out.where(whole & fits & shaped).withColumns({c: F.lower(c) for c in ("id", "pubkey", "sig")})


def unknown(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Envelopes whose event's id isn't stored. Only the id is read, so that known events are never parsed."""
    rows = found.withColumn("_id", F.lower(F.get_json_object("event", "$.id")))
    return rows.join(stored.select(F.col("id").alias("_id")), "_id", "left_anti").drop("_id")


def seen(found: DataFrame) -> DataFrame:
    """(id, relay) of envelopes, known events among them."""
    rows = found.where("command = 'EVENT' AND relay IS NOT NULL")
    return rows.select(F.lower(F.get_json_object("event", "$.id")).alias("id"), "relay").where("id IS NOT NULL").distinct()


def distinct_seen(events: DataFrame) -> DataFrame:
    """(id, relay) of events, each once. Ids, which :func:`parse` gives in lower case, are shuffled as bytes, half as long as their text."""
    short = events.select(F.unhex("id").alias("_id"), "relay").distinct()
    return short.select(F.lower(F.hex("_id")).alias("id"), "relay")


def with_reposted(events: DataFrame) -> DataFrame:
    """Events, and those that kind-6 events hold as their content."""
    inner = events.where(F.col("kind") == REPOST_KIND).select(
        F.lit("EVENT").alias("command"), F.col("content").alias("event"), *(F.col(c) for c in events.columns if c not in EVENT.fieldNames())
    )
    for c in ("subscription", "ok_id", "ok", "message", "challenge"):
        inner = inner.withColumn(c, F.lit(None))
    return events.unionByName(parse(inner))


def has_own_id(pubkey: str = "pubkey") -> Column:
    """Whether the id is the hash of the event."""
    c = F.col
    return c("id") == text.event_id(c(pubkey), c("created_at"), c("kind"), c("tags"), c("content"))


def checked(
    events: DataFrame, decision: Column | None = None, verify: bool = True, stored: DataFrame | None = None
) -> DataFrame:
    """Events that the ingest filter lets in and that are what they say, without those that are ``stored``.

    ``decision`` gives ACCEPT, REJECT or SKIP_CHECKS for each. The cheap test of
    the id comes first, and then the join with the stored ids, as a signature takes longest.
    """
    from tidewell.functions import crypto

    rows = events if decision is None else events.withColumn("_d", decision).where(F.col("_d") != REJECT)
    skip = F.lit(False) if decision is None else F.col("_d") == SKIP_CHECKS
    if verify:
        rows = rows.where(skip | has_own_id())
    if stored is not None:
        rows = rows.join(stored.select("id"), "id", "left_anti").select(rows.columns)
    if verify:
        # What is trusted has no signature to check.
        rows = rows.where(skip | crypto.verified(F.col("pubkey"), F.col("id"), F.when(~skip, F.col("sig"))))
    return rows.select(events.columns)


def deduplicated(events: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One event of each id, and none that is stored. ``_order`` decides which, if there is such a column."""
    if "_order" in events.columns:
        row = F.min_by(F.struct(*events.columns), "_order").alias("_row")
        out = events.groupBy("id").agg(row).select("_row.*")
    else:
        out = events.dropDuplicates(["id"])
    return out if stored is None else out.join(stored.select("id"), "id", "left_anti")


def with_keys(events: DataFrame, after: int = 0) -> DataFrame:
    """Events with note_key: unique, above ``after``, and rising within a partition. No single task numbers them."""
    return events.withColumns({"note_key": F.monotonically_increasing_id() + (after + 1), "flags": F.lit(0)})


def ingest(
    spark: SparkSession,
    path: str,
    relay: str | None = None,
    stored: DataFrame | None = None,
    decision: Column | None = None,
    verify: bool = True,
    after: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Notes, and (id, relay) of all events that were seen, from files of event lines.

    The last line needs no line feed. Events that are stored are no notes again,
    but they have been seen on one relay more. Write the notes once and join
    the relays with what was written: keys belong to a table, not to a plan.
    """
    lines = spark.read.text(path).withColumns({"_order": F.monotonically_increasing_id(), "relay": F.lit(relay)})
    found = envelopes(lines)
    if stored is not None and relay is None:
        # Nothing is asked of known events, not even where they were seen: they needn't be parsed.
        found = unknown(found, stored)
    events = with_reposted(parse(found))
    # Which of equal ids is taken is decided among those whose signature is good.
    good = deduplicated(checked(events, decision, verify, stored))
    notes = with_keys(good.drop("_order", "relay"), after)
    return notes, distinct_seen(events.where("relay IS NOT NULL"))
