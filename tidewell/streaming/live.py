"""Live subscriptions, incremental counters and stored notes without duplicates.

Event time needs no watermark here: a late note counts like any other, and order
is by the note's own time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from tidewell.operators import counters
from tidewell.plans.filters import Filter, group_predicate, minimal
from tidewell.storage import fresh_path

#: Standing filters at once, and filters of one subscription.
MOST_SUBSCRIPTIONS, MOST_FILTERS = 255, 16


def file_stream(spark: SparkSession, folder: str, name: str, schema, files_per_batch: int = 4096) -> DataFrame:
    """A stream of the Parquet files of a folder whose names fit."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    return reader.option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def line_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of event lines from the files of a folder; parse them as the batch source does."""
    return spark.readStream.text(folder)


def matches(notes: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    """Notes of a stream that one of the filters holds for, each once. Text search isn't evaluated on streams."""
    if len(filters) > MOST_FILTERS:
        raise ValueError(f"at most {MOST_FILTERS} filters")
    return notes.where(group_predicate(minimal(filters)))


class Subscriptions:
    """Standing filters over one stream of notes. Only what arrives after subscribing is delivered."""

    def __init__(self, spark: SparkSession, notes: DataFrame):
        self.spark, self.notes = spark, notes
        self.running: dict[int, tuple[StreamingQuery, str]] = {}
        #: Of each subscription the batch that is read next, and how many of its rows were read.
        self.read: dict[int, tuple[int, int]] = {}
        self.last = 0

    def subscribe(self, filters: Sequence[Filter], callback: Callable[[DataFrame, int], None] | None = None) -> int:
        """Start a subscription; its number. ``callback`` gets each batch of matches, else they are stored to be polled."""
        if len(self.running) >= MOST_SUBSCRIPTIONS:
            raise ValueError(f"at most {MOST_SUBSCRIPTIONS} subscriptions")
        self.last += 1
        found, path = matches(self.notes, filters), fresh_path(self.spark, "subscription")
        writer = found.writeStream.option("checkpointLocation", f"{path}/state").foreachBatch(callback or batches(f"{path}/matches"))
        self.running[self.last] = writer.start(), path
        self.read[self.last] = (0, 0)
        return self.last

    def numbered_matches_of(self, number: int) -> DataFrame:
        """All matches so far, with their batch. Batches are folders, of which a reader may leave out the first."""
        schema = T.StructType([*self.notes.schema.fields, T.StructField("batch", T.LongType())])
        try:
            return self.spark.read.schema(schema).parquet(f"{self.running[number][1]}/matches")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def matches_of(self, number: int) -> DataFrame:
        """All matches so far."""
        return self.numbered_matches_of(number).drop("batch")

    def poll(self, number: int, most: int = 256) -> list[Row]:
        """Matches that weren't polled before, without waiting. No batch before the one last read from is read again."""
        batch, done = self.read[number]
        rows = self.numbered_matches_of(number).where(F.col("batch") >= batch).orderBy("batch", "note_key").limit(done + most).collect()
        fresh = [r for i, r in enumerate(rows) if r["batch"] > batch or i >= done]
        if fresh:
            last = fresh[-1]["batch"]
            self.read[number] = (last, sum(r["batch"] == last for r in rows))
        return [Row(**{c: r[c] for c in self.notes.columns}) for r in fresh]

    def wait(self, number: int, most: int = 256) -> list[Row]:
        """Matches once all that has arrived is processed."""
        self.running[number][0].processAllAvailable()
        return self.poll(number, most)

    def unsubscribe(self, number: int) -> bool:
        found = self.running.pop(number, None)
        if found:
            found[0].stop()
            self.read.pop(number)
        return found is not None

    def __len__(self) -> int:
        return len(self.running)


def run_once(df: DataFrame, write: Callable[[DataFrame, int], None], name: str) -> None:
    """Process what has arrived, batch by batch, and end."""
    state = fresh_path(df.sparkSession, f"{name}-state")
    query = df.writeStream.trigger(availableNow=True).option("checkpointLocation", state).foreachBatch(write).start()
    query.awaitTermination()


def batches(path: str) -> Callable[[DataFrame, int], None]:
    """A batch writer with a folder for each batch. A batch that is run again replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def store(notes: DataFrame, path: str, known: DataFrame | None = None) -> None:
    """Append the notes of a stream whose id hasn't come before and isn't ``known``.

    The ids that have come are the stream's state, split by their hash: a batch meets those of its own ids' splits
    and reads no earlier batch again.
    """
    fresh = notes.dropDuplicates(["id"])
    if known is not None:
        ids = known.select(F.col("id").alias("_id")).distinct()
        fresh = fresh.join(ids, fresh["id"] == ids["_id"], "left_outer").where("_id IS NULL").drop("_id")
    run_once(fresh, batches(path), "stored")


def stored(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path).drop("batch")


#: Every so many batches the sums of all batches before become one part.
FOLD = 16
#: What tells a counter from others, and what adds up in it.
KEYS, SUMS = ["note_id", "type", "payload"], ["n", "msats"]


def count(notes: DataFrame, path: str, msats: Column | None = None, fold: int = FOLD) -> None:
    """Counters of each batch, written apart, and now and then all so far as one part; :func:`counted` and its
    like sum what no later part holds. Feed it notes without duplicates. A batch that is run again replaces its part."""

    def write(batch: DataFrame, number: int) -> None:
        # A batch without notes writes its part too, so that a fold leaves none out.
        rows, whole = counters.tidy(batch, msats), number % fold == fold - 1
        if whole and number:
            rows = counters.upsert(parts(batch.sparkSession, path, number), rows, KEYS, SUMS)
        rows.withColumn("whole", F.lit(whole)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    run_once(notes, write, "counts")


def parts(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The parts that count: the last one that holds all before it, and those behind it."""
    schema = "note_id string, type string, payload string, n long, msats long, whole boolean, batch long"
    found = spark.read.schema(schema).parquet(path)
    if before is not None:
        found = found.where(F.col("batch") < before)
    last = found.where("whole").agg(F.max("batch")).first()[0]
    return found if last is None else found.where(F.col("batch") >= last)


def tidy(spark: SparkSession, path: str) -> DataFrame:
    """note_id, type, payload, n, msats: all counters so far."""
    return parts(spark, path).groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS))


def counted(spark: SparkSession, path: str) -> DataFrame:
    """note_id and COUNTS."""
    rows = parts(spark, path).where(F.col("type").isin(*counters.COUNTS))
    sums = [F.sum(F.when(F.col("type") == c, F.col("n")).otherwise(0)).alias(c) for c in counters.COUNTS]
    return rows.groupBy("note_id").agg(*sums)


def counted_reactions(spark: SparkSession, path: str) -> DataFrame:
    """note_id, reaction, n."""
    rows = parts(spark, path).where(F.col("type") == counters.REACTION)
    return rows.groupBy("note_id", F.col("payload").alias("reaction")).agg(F.sum("n").alias("n"))


def counted_zaps(spark: SparkSession, path: str) -> DataFrame:
    """note_id, zaps, msats: of all receipts, as none is verified yet when it arrives."""
    rows = parts(spark, path).where(F.col("type") == counters.ZAP)
    return rows.groupBy("note_id").agg(F.sum("n").alias("zaps"), F.sum("msats").alias("msats"))
