"""SimHash near-dedup by deletion-variant signatures.

A fingerprint of 64 bits is cut into three segments. Of two fingerprints that
differ in at most four bits, some segment differs in at most one: were all three
to differ in two or more, six bits would differ. So each fingerprint is indexed
by the variants of its segments that leave one bit out; two segments that
differ in at most one bit share such a variant. Equal variants are joined and
the whole fingerprints compared. Where many fingerprints share a variant, as they do by chance
when the corpus is large, the bits outside the segment are cut into one piece more than the bits that
may differ there: some piece is equal, and joins the variant in the key.

Documents with one fingerprint are one node of the graph of links. Components
come from alternating star contractions, each round written to the shared folder.

Null and empty texts have fingerprint zero, like texts of blanks, and link like
any other. Texts of any length are read whole. Repeated rows are answered each. A row with a null doc_id is
answered too; it names no component but links the others. An empty table gives no rows. Other columns,
whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import discard, map_slices, materialise

SHINGLE = 4
SEED = 42
#: Most differing bits of a link.
NEAR = 4
#: First bit and width of the segments.
SEGMENTS = [(0, 21), (21, 21), (42, 22)]
#: A variant that more fingerprints share is cut by pieces of the other bits.
CROWDED = 64
#: Shingles whose bits are counted at a time.
BLOCK = 65_536


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit k is set if it is set in over half of the hashes of the text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    hash_of = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, BLOCK):
        pairs = zip(starts[at : min(n, at + BLOCK)].tolist(), last[at : at + BLOCK].tolist(), strict=False)
        hashes = np.array([hash_of(whole[a:b], seed) for a, b in pairs], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


SCHEMA = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def make():
        def apply(rows: dict[str, list]) -> dict[str, list]:
            found = [fingerprint(t) for t in rows["text"]]
            return {"doc_id": rows["doc_id"], "fp": [x - (1 << 64) if x >> 63 else x for x in found]}

        return apply

    return map_slices(docs.select(F.col("doc_id").cast("long"), "text"), make, SCHEMA, "doc_id long, fp long")


def variants(nodes: DataFrame) -> DataFrame:
    """fp, n and its 64 keys: bit ``p`` left out of the segment that holds it."""
    segment = "CASE " + " ".join(
        f"WHEN p < {first + width} THEN shiftrightunsigned(fp, {first}) & {(1 << width) - 1}L & ~shiftleft(1L, p - {first})"
        for first, width in SEGMENTS
    )
    exploded = nodes.select("fp", "n", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p"))
    return exploded.select("fp", "n", "p", F.expr(f"shiftleft(cast(p AS long), 22) | ({segment} END)").alias("key"))


def lowest_shared() -> str:
    """Of the variants that fingerprints a and b share, the lowest: at the bit that a segment
    differs in, or at its first bit if it is equal."""
    masks = [signed(((1 << width) - 1) << first) for first, width in SEGMENTS]
    return (
        "CASE "
        + " ".join(
            f"WHEN bit_count((a ^ b) & {m}) = 0 THEN {first} WHEN bit_count((a ^ b) & {m}) = 1 THEN bit_count(((a ^ b) & {m}) - 1)"
            for m, (first, _) in zip(masks, SEGMENTS, strict=True)
        )
        + " END"
    )


def signed(mask: int) -> str:
    return f"{mask - (1 << 64) if mask >> 63 else mask}L"


def pieces(first: int, width: int, n: int) -> list[str]:
    """Masks of ``n`` pieces of the bits outside a segment."""
    others = [b for b in range(64) if not first <= b < first + width]
    return [signed(sum(1 << b for b in others[i * len(others) // n : (i + 1) * len(others) // n])) for i in range(n)]


#: For the bits left out from ``p`` on: the masks of the pieces. If a pair differs in bit ``p`` of the segment, up to NEAR - 1
#: bits differ outside; pairs whose segment is equal meet at its first bit, with up to NEAR bits outside.
CUTS = [
    (at, pieces(first, width, n))
    for first, width in SEGMENTS
    for at, n in ((first, NEAR + 1), (first + 1, NEAR))
]


def by_cut(of: Callable[[list[str]], str]) -> str:
    """An expression that depends on the pieces which ``p`` goes with."""
    whens = " ".join(f"WHEN p >= {at} THEN {of(masks)}" for at, masks in reversed(CUTS))
    return f"CASE {whens} END"


def first_equal(masks: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN (a ^ b) & {m} = 0 THEN {i}" for i, m in enumerate(masks)) + " END"


def cut(members: DataFrame) -> DataFrame:
    """``members`` of crowded buckets with piece and part, by which they join besides their key: a row for each piece."""
    parts = by_cut(lambda masks: "array(" + ", ".join(f"fp & {m}" for m in masks) + ")")
    return members.where(F.col("members") > CROWDED).select("*", F.posexplode(F.expr(parts)).alias("piece", "part"))


def links(nodes: DataFrame) -> DataFrame:
    """Links a, b between different fingerprints that join what all links would join.

    ``nodes`` has fp and n, its number of documents. The fingerprints that share a
    variant form a bucket, and its most frequent one is the bucket's centre.
    Those that link to the centre are joined through it, so a group of copies
    gives a star and not all its pairs. Only what doesn't link to the centre is
    compared with the rest of its bucket, at the lowest variant that a pair shares, and in a crowded
    bucket only with what has an equal piece of the other bits.
    """
    keys = variants(nodes)
    centre = F.max_by("fp", F.struct("n", "fp")).alias("centre")
    shared = keys.groupBy("key").agg(centre, F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = materialise(shared.withColumnRenamed("key", "_key"), "buckets")
    # Each row of the index is told its bucket's centre; those alone in their bucket have none and go.
    told = keys.join(shared, keys["key"] == shared["_key"], "left")
    crowded = F.coalesce("members", F.col("p") - 64) > 1
    members = materialise(told.where(crowded).select("fp", "p", "key", "centre", "members"), "members")
    near = F.expr(f"bit_count(fp ^ centre) <= {NEAR}")
    stars = members.where(near & (F.col("fp") != F.col("centre"))).select(F.col("fp").alias("a"), F.col("centre").alias("b"))
    both = stars.union(compared(members, near))
    found = both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    found = materialise(found, "links")
    discard(shared, members)
    return found


def compared(members: DataFrame, near: Column) -> DataFrame:
    """Links a, b of the members that don't link to their bucket's centre."""
    # Two that are both far meet once, by their order, and in a crowded bucket at the first of their equal pieces.
    once = f"a != b AND (near_b OR a > b) AND bit_count(a ^ b) <= {NEAR} AND p = {lowest_shared()}"
    sparse = members.where(F.col("members") <= CROWDED)
    return met(sparse, near, ["key"], once).union(met(cut(members), near, ["key", "piece", "part"], f"{once} AND piece = {by_cut(first_equal)}"))


def met(members: DataFrame, near: Column, on: list[str], once: str) -> DataFrame:
    far = members.where(~near).select(F.col("fp").alias("a"), "p", *on)
    rest = members.select(F.col("fp").alias("b"), near.alias("near_b"), *(F.col(c).alias(f"{c}_b") for c in on))
    equal = " AND ".join(f"{c} = {c}_b" for c in on)
    return far.join(rest, F.expr(f"{equal} AND {once}")).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node and root, the least node of its component, for the nodes of ``edges`` (a, b), each given once.

    A large star ties a node's larger neighbours to the least of its
    neighbourhood, a small star the smaller ones and itself; the rounds end
    when the edges no longer change, each pointing at its root. Neighbourhoods
    are met as minima and joins, never collected.
    """

    def star(at: DataFrame) -> DataFrame:
        """u, v and m, the least of u and its v's."""
        least = at.groupBy("u").agg(F.min("v").alias("m"))
        return at.join(least, "u").withColumn("m", F.least("m", "u"))

    def told(df: DataFrame) -> tuple:
        mixed = F.xxhash64("a", "b").cast("decimal(38,0)")
        return tuple(df.agg(F.count(F.lit(1)), F.sum(mixed)).first())

    now = edges
    state = told(now)
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        large = star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        tied = [F.struct(F.col(x).alias("a"), F.col("m").alias("b")) for x in ("u", "v")]
        pairs = star(large).select(F.inline(F.array(*tied)))
        last, now = now, materialise(pairs.where("a != b").distinct(), "edges")
        discard(last)
        before, state = state, told(now)
        if before == state:
            break
    # Each edge now points from a node to its root; roots point at themselves.
    rooted = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return rooted.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint, component_id.

    component_id is the smallest doc_id that links reach, its own included.
    """
    held = materialise(fingerprints(docs), "fingerprints")
    nodes = materialise(held.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    rooted = components(links(nodes.select("fp", "n")))
    joined = nodes.join(rooted, nodes["fp"] == rooted["node"], "left")
    joined = joined.select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined.join(least, "root").select(F.col("fp").alias("node"), "component_id")
    # A table of its own, so that a fingerprint with a third of all rows is a skew that the join can split.
    named = materialise(named, "components")
    out = held.join(named, held["fp"] == named["node"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one of the smallest doc_id.

    Of repeated rows with one doc_id one stays. Rows with a null doc_id stay.
    """
    near = near_duplicates(docs)
    drop = near.where("doc_id != component_id").select(F.col("doc_id").alias("_tw_id")).distinct()
    stay = docs.join(drop, docs["doc_id"] == drop["_tw_id"], "left_anti")
    known = stay.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    return known.union(stay.where(F.col("doc_id").isNull()))
