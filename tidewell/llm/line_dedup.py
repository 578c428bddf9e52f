"""Line dedup by range-partitioned hashes, with DataFrame functions alone.

Each line gives a row: its key's hash, document and position. The rows are
range-partitioned by hash and sorted there by document and position, and a
window passes over them that holds no more than a group's first row: what comes
from a later document is a repeat. What comes back for a document is a bitmap of
the lines to drop, 64 to a word, words of zeros left out; texts are no part of
the exchange of hashes.

A hash may belong to a third of all rows. Its rows are spread over salts by
document, the first of each salt is found, and the firsts, at most as many as
there are salts, are compared among themselves in a second pass.

Null and empty texts are one empty line. Rows with a null doc_id lose no line and cause no loss.
Repeated rows of a document count as one document and lose the same lines. Texts and lines of any length are read
whole. An empty table gives no rows. Other columns, whatever their names, play no part and are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.llm.common import BLANKS, LOWER, UPPER, let, materialise, shuffle_partitions

#: Keys of fewer code points are left alone.
LEAST = 10


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def hashed(docs: DataFrame, least: int) -> DataFrame:
    """A row for each line that has a key: the key's hashes, doc_id, the text's hash and the position."""
    # Hashes of two functions: 96 bits tell keys apart.
    keyed = F.transform(
        lines(F.col("text")),
        lambda line, i: let(
            key(line),
            lambda k: F.when(
                F.char_length(k) >= least, F.struct(F.xxhash64(k).alias("h"), F.hash(k).alias("g"), i.alias("pos"))
            ),
        ),
    )
    kept = F.filter(keyed, lambda x: x.isNotNull())
    known = docs.where(F.col("doc_id").isNotNull())
    rows = known.select("doc_id", F.xxhash64("text").alias("t"), F.explode(kept).alias("x"))
    return rows.select("doc_id", "t", "x.h", "x.g", "x.pos")


def repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, t and pos of each line to drop."""
    n = shuffle_partitions(docs.sparkSession)
    rows = materialise(hashed(docs, least), "lines")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int"))
    order = ["doc_id", "pos"]
    dealt = salted.repartitionByRange(n, "h", "g", "salt").sortWithinPartitions("h", "g", "salt", *order)
    # The range exchange keeps each window's group together: no window adds an exchange.
    first = F.first("doc_id").over(Window.partitionBy("h", "g", "salt").orderBy(*order))
    flagged = dealt.withColumn("first", first)
    later = flagged.where("doc_id > first").select("doc_id", "t", "pos")
    firsts = flagged.where("doc_id = first").select("h", "g", "doc_id", "t", "pos")
    dealt = firsts.repartitionByRange(n, "h", "g").sortWithinPartitions("h", "g", *order)
    first = F.first("doc_id").over(Window.partitionBy("h", "g").orderBy(*order))
    return later.union(dealt.withColumn("first", first).where("doc_id > first").select("doc_id", "t", "pos"))


def bitmaps(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, t and drop: a map from a word's number to its 64 bits, set where a line goes.

    Words without a set bit are left out; a document that keeps all its lines has no row.
    """
    word, bit = F.expr("pos div 64"), F.expr("shiftleft(1L, pos % 64)")
    dealt = repeats(docs, least).withColumns({"word": word, "bit": bit}).repartition("doc_id", "t")
    words = dealt.groupBy("doc_id", "t", "word").agg(F.bit_or("bit").alias("bits"))
    entries = F.map_from_entries(F.collect_list(F.struct("word", "bits")))
    return words.groupBy("doc_id", "t").agg(entries.alias("drop"))


def apply_bitmaps(docs: DataFrame, drop: DataFrame) -> DataFrame:
    """``docs`` with _tw_all, the lines of each text, and _tw_kept, those that stay."""
    drop = drop.select(F.col("doc_id").alias("_tw_id"), F.col("t").alias("_tw_t"), F.col("drop").alias("_tw_drop"))
    on = (docs["doc_id"] == drop["_tw_id"]) & (F.xxhash64(docs["text"]) == drop["_tw_t"])
    joined = docs.join(drop, on, "left").drop("_tw_id", "_tw_t")
    # A dense array of words from the sparse map, so that a line finds its bit at once.
    dense = F.transform(
        F.sequence(F.lit(0), F.array_max(F.map_keys("_tw_drop")).cast("int")),
        lambda w: F.coalesce(F.element_at(F.col("_tw_drop"), w.cast("long")), F.lit(0).cast("long")),
    )
    stays = let(
        dense,
        lambda bits: F.filter(
            lines(F.col("text")),
            lambda _, i: F.coalesce(F.get(bits, (i / 64).cast("int")), F.lit(0).cast("long"))
            .bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i % 64))
            == 0,
        ),
    )
    kept = F.when(F.col("_tw_drop").isNull(), lines(F.col("text"))).otherwise(stays)
    return joined.withColumns({"_tw_all": F.size(lines(F.col("text"))), "_tw_kept": kept}).drop("_tw_drop")


def digests(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_lines, n_dropped, kept_sha256."""
    slim = docs.select(F.col("doc_id").cast("long"), "text")
    done = apply_bitmaps(slim, bitmaps(slim, least))
    told = let(F.col("_tw_kept"), lambda k: F.struct(F.size(k).alias("n"), F.sha2(F.array_join(k, "\n"), 256).alias("sha")))
    done = done.select("doc_id", F.col("_tw_all").cast("long").alias("n_lines"), told.alias("x"))
    return done.select(
        "doc_id", "n_lines", (F.col("n_lines") - F.col("x.n")).alias("n_dropped"), F.col("x.sha").alias("kept_sha256")
    )


def deduplicated(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` with the lines that stay as text and, where there is one, n_chars to match. Null texts stay null."""
    done = apply_bitmaps(docs, bitmaps(docs.select(F.col("doc_id").cast("long"), "text"), least))
    text = F.when(F.col("text").isNotNull(), F.array_join("_tw_kept", "\n"))
    done = done.withColumn("text", text)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(docs.columns)
