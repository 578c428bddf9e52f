"""Snapshots, compaction and versions of stored tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import counters, search, tables
from tidewell.schema import PROFILE_KIND

#: The version of the stored tables, in a table of its own beside them.
VERSION = 1


@dataclass(frozen=True)
class Options:
    """What isn't derived at a write."""

    skip_fulltext: bool = False
    skip_blocks: bool = False
    skip_counters: bool = False


def derived(notes: DataFrame, options: Options | None = None) -> dict[str, DataFrame]:
    """The tables that are derived from a batch of new notes, to be appended with it.

    Counters of batches add up (:func:`tidewell.operators.counters.upsert`).
    """
    o = options or Options()
    out = {"tags": tables.tag_rows(notes), "profiles": tables.profiles(notes), "profile_names": search.names(notes)}
    if not o.skip_fulltext:
        out["tokens"] = search.tokens(notes)
    if not o.skip_blocks:
        out["blocks"] = tables.block_rows(notes)
    if not o.skip_counters:
        out |= {"note_counts": counters.counts(notes), "note_reactions": counters.reactions(notes), "zaps": counters.zap_rows(notes)}
    return out


def compact(notes: DataFrame, own: Sequence[str]) -> DataFrame:
    """All profiles and the notes of one's own pubkeys, with fresh keys in the old order.

    Keys rise along the old order and are unique; they leave gaps between
    partitions, so that numbering needs no single task.
    """
    keep = notes.where((F.col("kind") == PROFILE_KIND) | F.col("pubkey").isin([p.lower() for p in own]))
    return keep.sort("note_key").withColumn("note_key", F.monotonically_increasing_id() + 1)


def folder(spark: SparkSession, path: str) -> tuple:
    """A path and its file system, of whatever store."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


COMMITS, VERSIONS, BATCH = "commits", "version", "batch"


def committed(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches that were written to their end."""
    hadoop, store = folder(spark, f"{path}/{COMMITS}")
    return sorted(int(s.getPath().getName()) for s in store.listStatus(hadoop)) if store.exists(hadoop) else []


def exists(spark: SparkSession, path: str) -> bool:
    return bool(committed(spark, path))


def append(held: dict[str, DataFrame], path: str) -> None:
    """Add a batch of rows to the tables below ``path``, all of them or, if it is cut short, none.

    Each table has a folder for the batch. An empty file, made when all are written, says that they count; what a batch
    that failed has left is replaced by the next one.
    """
    spark = next(iter(held.values())).sparkSession
    number = max(committed(spark, path), default=-1) + 1
    for name, df in held.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}/{BATCH}={number}")
    if not number:
        spark.createDataFrame([(VERSION,)], "version int").write.mode("overwrite").parquet(f"{path}/{VERSIONS}")
    hadoop, store = folder(spark, f"{path}/{COMMITS}/{number}")
    store.create(hadoop, False).close()


def snapshot(held: dict[str, DataFrame], path: str) -> None:
    """Write the tables and their version below ``path``, where nothing is yet."""
    if exists(next(iter(held.values())).sparkSession, path):
        raise ValueError(f"{path} holds tables already")
    append(held, path)


Migration = Callable[[dict[str, DataFrame]], dict[str, DataFrame]]


def load(spark: SparkSession, path: str, migrations: Sequence[Migration] = ()) -> dict[str, DataFrame]:
    """Tables of a store as of its last whole batch, led through the migrations that its version lacks."""
    version = spark.read.parquet(f"{path}/{VERSIONS}").first()[0]
    hadoop, store = folder(spark, path)
    names = {s.getPath().getName() for s in store.listStatus(hadoop)} - {VERSIONS, COMMITS}
    whole = F.col(BATCH).isin(committed(spark, path))
    held = {n: spark.read.parquet(f"{path}/{n}").where(whole).drop(BATCH) for n in sorted(names)}
    for migrate in migrations[version - 1 :]:
        held = migrate(held)
    return held


#: Of the derived tables those whose rows of several batches add up: what tells a counter, and its sums.
ADDED = {"note_counts": (["note_id"], counters.COUNTS), "note_reactions": (["note_id", "reaction"], ["n"])}


def added_up(name: str, held: DataFrame) -> DataFrame:
    """A derived table as of all batches."""
    if name not in ADDED:
        return held
    keys, sums = ADDED[name]
    return held.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))
