"""A quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of the text alone are its inputs. The trees are fitted on the driver
on a bounded sample of labelled rows and flattened into arrays; workers walk all
trees of a few thousand documents at once with numpy.

Null and empty texts have statistics of zero and a score like any other, and texts of any length are read whole.
Repeated rows are scored each, and equal texts alike; of a doc_id's repeated rows the trees are fitted on one. Of several labels
of a doc_id the smallest counts, and others than 0 and 1 don't. Without labels of both kinds every score is the share
of label 1, or a half. An empty table gives no rows. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import map_slices, materialise

#: Labelled rows that the trees are fitted on: all, or about so many, chosen by their hash.
SAMPLE = 20_000
TREES, DEPTH, BINS = 60, 4, 64
RATE, SHRINK, LEAST_ROWS = 0.15, 1.0, 10
#: A document is predicted good from this score on.
GOOD = 0.3

UPPER, LOWER, DIGIT = np.zeros((3, 256), dtype=bool)
UPPER[65:91] = LOWER[97:123] = DIGIT[48:58] = True
#: Signs whose share of the bytes is a statistic of its own.
SIGNS = "|#*$%&<>!?.,;:-_=+/\\\"'()[]{}@"
ENDS = re.compile(r"[.!?]")
NAMES = [
    "log_bytes", "log_words", "upper", "digit", "above_ascii", "blank", "word_length", "distinct_words",
    "repeated_triples", "log_lines", "repeated_lines", "line_words", "sentence_words", "signs",
    "sign_ends", "entropy", "vowels", *(f"sign_{i}" for i in range(len(SIGNS))),
]
VOWELS = [ord(c) for c in "aeiouAEIOU"]
SIGN_BYTES = [ord(c) for c in SIGNS]


def statistics(text: str | None) -> list[float]:
    """The inputs of the trees, as NAMES lists them."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return [0.0] * len(NAMES)
    seen = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    n_words, n_lines = max(1, len(words)), max(1, len(lines))
    distinct = set(words)
    triples = len(words) - 2
    repeated = 1 - len(set(zip(words, words[1:], words[2:], strict=False))) / triples if triples > 0 else 0.0
    share = seen[seen > 0] / n
    signs = seen[SIGN_BYTES] / n
    ends = sum(1 for w in distinct if w[-1] in b"#*$%&|<>!")
    letters = max(1, int(seen[UPPER].sum() + seen[LOWER].sum()))
    return [
        math.log1p(n), math.log1p(len(words)), int(seen[UPPER].sum()) / letters, int(seen[DIGIT].sum()) / n,
        int(seen[128:].sum()) / n, int(seen[[9, 10, 11, 12, 13, 32]].sum()) / n, (n - n_words) / n_words,
        len(distinct) / n_words, repeated, math.log1p(len(lines)), 1 - len(set(lines)) / n_lines,
        len(words) / n_lines, len(words) / (1 + int(seen[[33, 46, 63]].sum())), float(signs.sum()),
        ends / max(1, len(distinct)), float(-(share * np.log2(share)).sum()), int(seen[VOWELS].sum()) / letters,
        *signs.tolist(),
    ]


class Forest(NamedTuple):
    """Complete trees of one depth, flattened: node i has the children 2i+1 and 2i+2."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros((len(x), len(self.feature)), dtype=np.int64)
        trees, rows = np.arange(len(self.feature)), np.arange(len(x))[:, None]
        depth = int(math.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        for _ in range(depth):
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.threshold[trees, at])
        raw = self.base + self.leaf[trees, at - (2**depth - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-raw))


def edges_of(x: np.ndarray) -> list[np.ndarray]:
    """Bounds of the histogram's bins, by quantiles."""
    points = np.linspace(0, 1, BINS + 1)[1:-1]
    return [np.unique(np.quantile(c, points)) for c in x.T]


def grow(binned: np.ndarray, edges: list[np.ndarray], slope: np.ndarray, bend: np.ndarray) -> tuple[np.ndarray, ...]:
    """One tree, level by level. ``slope`` and ``bend``: the loss's first and second derivatives."""
    n, m = binned.shape
    inner = 2**DEPTH - 1
    feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
    node = np.zeros(n, dtype=np.int64)
    for level in range(DEPTH):
        first, wide = 2**level - 1, 2**level
        best = np.zeros(wide)
        cut = np.full((wide, 2), -1)
        for j in range(m):
            key = (node - first) * BINS + binned[:, j]
            g = np.bincount(key, slope, wide * BINS).reshape(wide, BINS).cumsum(axis=1)
            h = np.bincount(key, bend, wide * BINS).reshape(wide, BINS).cumsum(axis=1)
            c = np.bincount(key, minlength=wide * BINS).reshape(wide, BINS).cumsum(axis=1)
            all_g, all_h, all_c = g[:, -1:], h[:, -1:], c[:, -1:]
            gain = g**2 / (h + SHRINK) + (all_g - g) ** 2 / (all_h - h + SHRINK) - all_g**2 / (all_h + SHRINK)
            gain[(c < LEAST_ROWS) | (all_c - c < LEAST_ROWS)] = 0
            at = gain.argmax(axis=1)
            found = gain[np.arange(wide), at]
            better = found > best + 1e-9
            best[better] = found[better]
            cut[better] = np.stack([np.full(wide, j), at], axis=1)[better]
        goes = np.zeros(n, dtype=np.int64)
        for k, (j, b) in enumerate(cut):
            if j >= 0:
                feature[first + k], threshold[first + k] = j, edges[j][b]
                mine = node == first + k
                goes[mine] = binned[mine, j] > b
        node = 2 * node + 1 + goes
    last = node - inner
    g, h = np.bincount(last, slope, inner + 1), np.bincount(last, bend, inner + 1)
    return feature, threshold, -RATE * g / (h + SHRINK), last


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Gradient boosting of the logistic loss."""
    mean = float(y.mean()) if len(y) else 0.5
    trees: list[tuple[np.ndarray, ...]] = []
    if len(y) and 0 < mean < 1:
        base = math.log(mean / (1 - mean))
        edges = edges_of(x)
        # A bin takes what is above the bound before it and up to its own.
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
        edges = [np.append(e, np.inf) for e in edges]
        raw = np.full(len(y), base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-raw))
            *tree, last = grow(binned, edges, p - y, p * (1 - p))
            raw += tree[2][last]
            trees.append(tuple(tree))
    else:
        base = math.log(max(mean, 1e-3) / max(1 - mean, 1e-3))
    if not trees:
        trees = [(np.zeros(2**DEPTH - 1, dtype=np.int64), np.full(2**DEPTH - 1, np.inf), np.zeros(2**DEPTH))]
    return Forest(base, *(np.stack(part) for part in zip(*trees, strict=True)))


def counted(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of its text."""
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])

    def make():
        return lambda rows: {"doc_id": rows["doc_id"], "x": [statistics(t) for t in rows["text"]]}

    return map_slices(docs.select(F.col("doc_id").cast("long"), "text"), make, schema, "doc_id long, x array<double>")


def held_out(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def learn(counts: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """Trees from the labelled rows that aren't held out: all, or about ``sample`` that their hashes choose."""
    known = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("_id"), "quality")
    known = known.where(~held_out("_id")).groupBy("_id").agg(F.min("quality").alias("quality"))
    rows = counts.join(known, counts["doc_id"] == known["_id"])
    # The share to take is fixed before rows are sent, so that no task sends more than its share.
    share = min(1.0, sample / max(1, known.count()))
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))
    single = rows.where(chosen).groupBy("doc_id", "quality").agg(F.min("x").alias("x"))
    found = sorted(map(tuple, single.collect()))
    x = np.array([r[2] for r in found]).reshape(-1, len(NAMES))
    return fit(x, np.array([r[1] for r in found], dtype=np.float64))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted. A null doc_id is not held out."""
    counts = materialise(counted(docs), "statistics")
    forest = docs.sparkSession.sparkContext.broadcast(learn(counts, labels))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(forest.value.score(x))], schema=schema)

    scored = counts.mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= GOOD).cast("int").alias("predicted"),
    )
