"""Counters of notes: reactions, replies, quotes, reposts and zaps.

Each is an aggregate of the ids that tags point at, with a partial aggregate
before the shuffle. Counts are of the notes given; give each note once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import tags as t
from tidewell.functions import text
from tidewell.schema import REACTION_KIND, REPOST_KINDS, TEXT_KINDS, ZAP_KIND


def counted(notes: DataFrame, kinds: tuple[int, ...], target: Column, name: str) -> DataFrame:
    """note_id and how many notes of the kinds point at it."""
    rows = notes.where(F.col("kind").isin(*kinds)).select(target.alias("note_id")).where("note_id IS NOT NULL")
    return rows.groupBy("note_id").agg(F.count(F.lit(1)).alias(name))


def reactions(notes: DataFrame) -> DataFrame:
    """note_id, reaction, n: reactions by their key to the last id among the e tags."""
    rows = notes.where(F.col("kind") == REACTION_KIND)
    rows = rows.select(t.last_id(F.col("tags"), "e").alias("note_id"), text.reaction(F.col("content")).alias("reaction"))
    return rows.where("note_id IS NOT NULL").groupBy("note_id", "reaction").agg(F.count(F.lit(1)).alias("n"))


def total_reactions(notes: DataFrame) -> DataFrame:
    return counted(notes, (REACTION_KIND,), t.last_id(F.col("tags"), "e"), "total_reactions")


def quotes(notes: DataFrame) -> DataFrame:
    return counted(notes, TEXT_KINDS, t.first_id(F.col("tags"), "q"), "quotes")


def direct_replies(notes: DataFrame, markers: bool = False) -> DataFrame:
    return counted(notes, TEXT_KINDS, t.reply_target(F.col("tags"), markers), "direct_replies")


def thread_replies(notes: DataFrame, markers: bool = False) -> DataFrame:
    return counted(notes, TEXT_KINDS, t.thread_root(F.col("tags"), markers), "thread_replies")


def reposts(notes: DataFrame) -> DataFrame:
    return counted(notes, REPOST_KINDS, t.first_id(F.col("tags"), "e"), "reposts")


COUNTS = ["total_reactions", "quotes", "direct_replies", "thread_replies", "reposts"]


def pointed(notes: DataFrame) -> DataFrame:
    """note_id and counter of each count that a note adds, from one pass over the notes."""
    kind, tags = F.col("kind"), F.col("tags")
    of = {
        "total_reactions": (kind == REACTION_KIND, t.last_id(tags, "e")),
        "quotes": (kind.isin(*TEXT_KINDS), t.first_id(tags, "q")),
        "direct_replies": (kind.isin(*TEXT_KINDS), t.reply_target(tags)),
        "thread_replies": (kind.isin(*TEXT_KINDS), t.thread_root(tags)),
        "reposts": (kind.isin(*REPOST_KINDS), t.first_id(tags, "e")),
    }
    structs = [F.struct(F.when(fits, target).alias("note_id"), F.lit(n).alias("counter")) for n, (fits, target) in of.items()]
    rows = notes.where(kind.isin(REACTION_KIND, *TEXT_KINDS, *REPOST_KINDS)).select(F.inline(F.array(*structs)))
    return rows.where("note_id IS NOT NULL")


def counts(notes: DataFrame) -> DataFrame:
    """note_id and all of COUNTS, by one scan and one shuffle. A rebuild gives what the stream has counted."""
    sums = [F.sum(F.when(F.col("counter") == n, 1).otherwise(0)).alias(n) for n in COUNTS]
    return pointed(notes).groupBy("note_id").agg(*sums)


def upsert(stored: DataFrame, fresh: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Counters with fresh ones added: a sum over both, so a key new to either side is kept."""
    both = stored.select(*keys, *sums).unionByName(fresh.select(*keys, *sums))
    return both.groupBy(*keys).agg(*(F.sum(s).alias(s) for s in sums))


def zap_rows(notes: DataFrame, msats: Column | None = None) -> DataFrame:
    """zap_id, note_id, msats of each zap receipt. The amount is that of the first bolt11 tag, absent is 0."""
    from tidewell.functions import codecs

    rows = notes.where(F.col("kind") == ZAP_KIND)
    if msats is None:
        decoded = codecs.invoice(t.first_value(F.col("tags"), "bolt11"))
        rows = rows.withColumn("_inv", decoded).where("_inv IS NOT NULL")
        msats = F.coalesce(F.col("_inv.amount_msat"), F.lit(0))
    rows = rows.select(F.col("id").alias("zap_id"), t.last_id(F.col("tags"), "e").alias("note_id"), msats.alias("msats"))
    return rows.where("note_id IS NOT NULL")


def zaps(notes: DataFrame, verified: DataFrame | None = None, msats: Column | None = None) -> DataFrame:
    """note_id, counts and sums of zaps that aren't and that are verified.

    ``verified`` has the ids of receipts (zap_id) that were checked; naming one twice counts once.
    """
    rows = zap_rows(notes, msats)
    if verified is None:
        rows = rows.withColumn("_ok", F.lit(False))
    else:
        ids = verified.select(F.col("zap_id").alias("_id")).distinct().withColumn("_ok", F.lit(True))
        rows = rows.join(ids, rows["zap_id"] == ids["_id"], "left").drop("_id")
        rows = rows.withColumn("_ok", F.coalesce("_ok", F.lit(False)))
    ok = F.col("_ok")
    amount = F.col("msats").cast("decimal(20,0)")
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("decimal(20,0)")
    return rows.groupBy("note_id").agg(
        F.count(F.when(~ok, 1)).alias("unverified"),
        total(F.when(~ok, amount)).alias("unverified_msats"),
        F.count(F.when(ok, 1)).alias("verified"),
        total(F.when(ok, amount)).alias("verified_msats"),
    )


#: Types of tidy counters beside COUNTS.
REACTION, ZAP = "reaction", "zap"


def tidy(notes: DataFrame, msats: Column | None = None) -> DataFrame:
    """note_id, type, payload, n, msats of all that a batch of notes adds, reactions by their key and zaps among it."""
    none = F.lit(0).cast("long").alias("msats")
    tall = pointed(notes).select("note_id", F.col("counter").alias("type"), F.lit("").alias("payload"), none)
    by_string = notes.where(F.col("kind") == REACTION_KIND).select(
        t.last_id(F.col("tags"), "e").alias("note_id"), F.lit(REACTION).alias("type"), text.reaction(F.col("content")).alias("payload"), none
    )
    paid = zap_rows(notes, msats).select("note_id", F.lit(ZAP).alias("type"), F.lit("").alias("payload"), F.col("msats").cast("long"))
    both = tall.unionByName(by_string).unionByName(paid).where("note_id IS NOT NULL")
    return both.groupBy("note_id", "type", "payload").agg(F.count(F.lit(1)).alias("n"), F.sum("msats").alias("msats"))


def metadata(notes: DataFrame, custom: DataFrame | None = None) -> DataFrame:
    """A tidy table of all that is counted: note_id, type, payload, n. ``custom`` adds rows of types of the user's own."""
    tall = counts(notes).unpivot("note_id", COUNTS, "type", "n").where("n > 0")
    tall = tall.select("note_id", "type", F.lit("").alias("payload"), "n")
    by_string = reactions(notes).select("note_id", F.lit("reaction").alias("type"), F.col("reaction").alias("payload"), "n")
    out = tall.unionByName(by_string)
    return out if custom is None else out.unionByName(custom.select("note_id", "type", "payload", "n"))
