"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.functions.binding import let
from tidewell.storage import discard, materialise

__all__ = ["ORDER", "discard", "in_order", "let", "map_slices", "materialise", "numbered", "positions", "ranked", "shuffle_partitions"]

#: White space as the operators' contracts define it: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
#: The same as a Java regular expression class body.
BLANK_CLASS = r"\x20\x09-\x0D"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Rows, and bytes of text, taken out of an Arrow batch at a time, so that Python holds few texts at once.
SLICE, SLICE_BYTES = 256, 1 << 22


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of the rows of a batch: at most SLICE rows, and SLICE_BYTES of text but for a single row."""
    sizes = np.zeros(batch.num_rows, dtype=np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    upto = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < batch.num_rows:
        fit = int(np.searchsorted(upto, upto[at] + SLICE_BYTES, side="right")) - 1
        end = max(at + 1, min(fit, at + SLICE))
        yield batch.slice(at, end - at)
        at = end


def map_slices(
    df: DataFrame,
    make: Callable[[], Callable[[dict[str, list]], dict[str, list]]],
    schema: pa.Schema,
    ddl: str,
) -> DataFrame:
    """Run a Python function over column lists, a few hundred rows at a time.

    ``make`` is called once for each task and gives the function, so that a task
    loads its tables once. Memory is that of one Arrow batch and a slice of bounded rows and bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            for part in slices(batch):
                out = apply({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    return df.mapInArrow(run, ddl)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: The rows of a partition stand in the lower bits of what ``monotonically_increasing_id`` gives.
ROW_BITS = 33


#: The columns by which ``in_order`` sorts.
ORDER = ["_part", "_file", "_row"]


def in_order(df: DataFrame) -> DataFrame:
    """``df`` with ORDER, three longs by which its rows sort as they were written: the number in the name of the
    Parquet file, the hash of its path and the row in it.

    Spark reads files in the order of their sizes, but it numbers them by partition. Files with other names
    come by the hash. Of a table that is not read from Parquet files, the order is that of its partitions.
    """
    path = F.col("_metadata.file_path")
    number = lambda pattern: F.coalesce(F.regexp_extract(path, pattern, 1).try_cast("long"), F.lit(0).cast("long"))
    # A task may write several files, which count on in the name.
    part = number(r"/part-(\d+)[^/]*$") * (1 << 20) + number(r"-c(\d+)[^/-]*$")
    try:
        found = df.withColumns({"_part": part, "_file": F.xxhash64(path), "_row": F.col("_metadata.row_index")})
        found.schema  # noqa: B018
        return found
    except AnalysisException:
        none = F.lit(0).cast("long")
        return df.withColumns({"_part": none, "_file": none, "_row": F.monotonically_increasing_id()})


def positions(df: DataFrame, order: list[str], at: str) -> DataFrame:
    """``df`` with a number that rises along ``order``, for ``numbered``. Materialise it: a second run may number anew."""
    dealt = df.repartitionByRange(4 * shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    return dealt.withColumn(at, F.monotonically_increasing_id())


def numbered(df: DataFrame, at: str, to: str) -> DataFrame:
    """``df`` with ``to``, the ``positions`` in ``at`` without gaps. One task meets a row for each of their ranges, no more."""
    part = F.shiftright(at, ROW_BITS)
    sizes = df.groupBy(part.alias("_key")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(F.lit(0)).orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_key", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    found = df.join(sizes, part == F.col("_key"))
    return found.withColumn(to, F.col("_before") + F.col(at).bitwiseAND((1 << ROW_BITS) - 1)).drop("_key", "_before", at)


def ranked(df: DataFrame, key: str, ident: list[str], rank: str) -> DataFrame:
    """Number the rows of each key from 0, in column ``rank``, in an order that
    depends on the ids alone.

    No task gets the whole of a key: its rows are dealt by a hash of ``ident`` into
    buckets, numbered inside their bucket and
    moved up by the rows of the buckets before. A key has four buckets for each shuffle
    partition, so a key with a third of all rows spreads over all tasks, and the table of
    bucket sizes has a bounded number of rows a key.
    """
    buckets = 4 * shuffle_partitions(df.sparkSession)
    mixed = df.withColumn("_mix", F.xxhash64(*ident))
    mixed = mixed.withColumn("_bucket", F.pmod("_mix", F.lit(buckets)).cast("int"))
    inside = Window.partitionBy(key, "_bucket").orderBy("_mix", *ident)
    numbered = mixed.withColumn("_inside", F.row_number().over(inside) - 1)
    sizes = mixed.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        F.col(key).alias("_key"),
        F.col("_bucket").alias("_at"),
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"),
    )
    on = numbered[key].eqNullSafe(sizes["_key"]) & (numbered["_bucket"] == sizes["_at"])
    return numbered.join(sizes, on).select(
        *df.columns, (F.col("_before") + F.col("_inside")).cast("long").alias(rank)
    )
