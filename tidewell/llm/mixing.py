"""Mixing sources to target weights by Pfair scheduling.

Each source's documents form blocks, and time runs in slots of one block. Block
``i`` of a source that has ``w`` of ``W`` shares is released at ``i*W/w`` and due
at ``(i+1)*W/w``; of the released blocks the one due first takes the slot. At
any slot each source has then had its share of the slots to within one block.

The schedule repeats after ``W`` slots, so one period of it, made on the driver,
places any number of blocks by arithmetic. When a source runs out, the others
go on in a new phase with their weights among themselves, until all rows are
placed: no row is dropped or repeated.

Sources not named in the weights, null among them, share the weight of ``*``, in one queue
or, by ``by_source``, each in its own. Repeated rows are placed each. An empty table gives no rows. Texts play no part
but to tell rows of one doc_id apart, and other columns, whatever their names, are kept.
"""

from __future__ import annotations

from collections.abc import Mapping
from heapq import heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import ranked, shuffle_partitions

OTHERS = "*"
#: Documents of a block.
BLOCK = 16
#: Weights are a table that someone has written: at most so many entries, and so many shares.
MOST_SOURCES, MOST_SHARES = 256, 4096


def period(weights: Mapping[str, int]) -> list[str]:
    """The source of each slot of one period, earliest deadline first."""
    whole = sum(weights.values())
    done = dict.fromkeys(weights, 0)
    waiting = [(0, s) for s in sorted(weights)]
    ready: list[tuple[int, str]] = []
    slots = []
    for t in range(whole):
        while waiting and waiting[0][0] <= t:
            _, s = heappop(waiting)
            heappush(ready, (-(-(done[s] + 1) * whole // weights[s]), s))
        _, due = heappop(ready)
        done[due] += 1
        if done[due] < weights[due]:
            heappush(waiting, (done[due] * whole // weights[due], due))
        slots.append(due)
    return slots


Phase = tuple[int, int, int, int, list[int]]


def schedule(blocks: Mapping[str, int], weights: Mapping[str, int]) -> dict[str, list[Phase]]:
    """For each source its phases: first block, first slot, shares, all shares, slots of its blocks in a period."""
    left = {s: n for s, n in blocks.items() if n}
    out: dict[str, list[Phase]] = {s: [] for s in left}
    slot = 0
    while left:
        now = {s: weights[s] for s in sorted(left)}
        whole = sum(now.values())
        slots = period(now)
        at: dict[str, list[int]] = {s: [] for s in now}
        for i, s in enumerate(slots):
            at[s].append(i)
        for s in now:
            out[s].append((blocks[s] - left[s], slot, now[s], whole, at[s]))
        # Whole periods, then slots one by one until a source runs out.
        periods = min(left[s] // w for s, w in now.items())
        for s, w in now.items():
            left[s] -= periods * w
        slot += periods * whole
        if all(left.values()):
            for s in slots:
                left[s] -= 1
                slot += 1
                if not left[s]:
                    break
        left = {s: n for s, n in left.items() if n}
    return out


def check(weights: Mapping[str, int]) -> dict[str, int]:
    if len(weights) > MOST_SOURCES or sum(weights.values()) > MOST_SHARES or min(weights.values(), default=0) < 1:
        raise ValueError(f"give at most {MOST_SOURCES} whole weights from 1 on, {MOST_SHARES} together")
    return {OTHERS: 1} | dict(weights)


def by_source(docs: DataFrame, weights: Mapping[str, int]) -> dict[str, int]:
    """``weights`` with an entry for each source that ``docs`` holds: those not named have equal parts of the weight of ``*``.

    Where there are more than the bounds of a table of weights allow, the largest have entries of their own,
    and the others are left to ``*``, as null is, with one such part.
    """
    weights = check(weights)
    most = min(MOST_SOURCES - len(weights), MOST_SHARES // sum(weights.values()) - 1)
    if most < 1:
        return weights
    other = docs.where(F.col("source").isNull() | ~F.col("source").isin(list(weights))).groupBy("source").count()
    found = [r[0] for r in other.orderBy(F.desc("count"), "source").limit(most + 1).collect()]
    rest = None in found or len(found) > most
    own = [s for s in found if s is not None][: most - rest]
    parts = max(1, len(own) + rest)
    return {s: w * parts for s, w in weights.items() if s != OTHERS} | dict.fromkeys([*own, OTHERS], weights[OTHERS])


def slots(docs: DataFrame, weights: Mapping[str, int], ident: list[str], block: int = BLOCK) -> DataFrame:
    """``ident`` and source of each row with its place: group, block, slot, position, phase.

    ``group`` is the entry of the weights that counts for the row, ``block`` its block among the group's,
    ``slot`` the block's place in the mixed stream and ``position`` the row's
    place in it. Positions rise along the stream; a group's last block may be
    short, so they may leave gaps.
    """
    weights = check(weights)
    named = F.when(F.col("source").isin(list(weights)), F.col("source")).otherwise(F.lit(OTHERS))
    rows = docs.select(*ident, "source").withColumn("group", named)
    # One count for each entry of the weights, at most MOST_SOURCES + 1.
    sizes = {r[0]: r[1] for r in rows.groupBy("group").count().collect()}
    plan = schedule({s: -(-n // block) for s, n in sizes.items()}, weights)
    table = docs.sparkSession.createDataFrame(
        [(s, phases) for s, phases in plan.items()],
        "to string, phases array<struct<first: long, slot: long, shares: long, whole: long, at: array<long>>>",
    )
    placed = ranked(rows, "group", ident, "rank").withColumn("block", F.expr(f"rank div {block}"))
    placed = placed.join(F.broadcast(table), placed["group"] == table["to"])
    last = F.element_at(F.filter("phases", lambda p: p["first"] <= F.col("block")), -1)
    placed = placed.withColumns({"now": last, "phase": F.size(F.filter("phases", lambda p: p["first"] <= F.col("block"))) - 1})
    nth = "(block - now.first)"
    slot = f"now.slot + {nth} div now.shares * now.whole + get(now.at, cast({nth} % now.shares AS int))"
    placed = placed.withColumn("slot", F.expr(slot))
    return placed.select(
        *ident, "source", "group", "block", "slot", F.expr(f"slot * {block} + rank % {block}").alias("position"), "phase"
    )


def mixed(docs: DataFrame, weights: Mapping[str, int], block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` in the order of the mixed stream: files and the rows in them follow the slots."""
    ident = F.struct(*(F.col(c) for c in docs.columns))
    keyed = docs.select(ident.alias("_tw_row"), "source", F.col("doc_id").alias("_tw_id"), F.xxhash64("text").alias("_tw_t"))
    place = slots(keyed.select("source", "_tw_id", "_tw_t").distinct(), weights, ["_tw_id", "_tw_t"], block)
    place = place.select(F.col("_tw_id").alias("_tw_i"), F.col("_tw_t").alias("_tw_u"), F.col("source").alias("_tw_s"), "position")
    on = (
        keyed["_tw_id"].eqNullSafe(place["_tw_i"])
        & keyed["_tw_t"].eqNullSafe(place["_tw_u"])
        & keyed["source"].eqNullSafe(place["_tw_s"])
    )
    n = shuffle_partitions(docs.sparkSession)
    out = keyed.join(place, on).repartitionByRange(n, "position").sortWithinPartitions("position")
    return out.select("_tw_row.*")
