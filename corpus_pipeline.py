"""A corpus pipeline of five of the training-data operators.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last give the columns
of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import line_dedup, mixing, packing, quality_rules, simhash
from tidewell.llm.common import discard, materialise
from tidewell.llm.queries import CAPACITY, WEIGHTS, WORD_BPE, documents, tokenizer

#: Pieces of the mix that are packed together.
WINDOW = 4096

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go."""
    return line_dedup.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash.representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which sources at their target weights take turns."""
    return mixing.mixed(docs, mixing.by_source(docs, WEIGHTS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, each filled from neighbours in the mix."""
    return packing.pack(docs, tokenizer(WORD_BPE), CAPACITY, window=WINDOW)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash", near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

#: Expectation-maximisation and token ids are beyond SQL; a test compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        made = materialise(stage(spark, docs, sf_dir), name)
        # What the stage before wrote has been read to its end.
        discard(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
