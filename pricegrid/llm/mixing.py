"""A mix of sources at target weights, scheduled by a low-discrepancy sequence."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricegrid.llm.common import running_sums, sent_by_value

sent_by_value(__name__)

#: Words of a block, at most; and blocks that the mean source has, at least.
BLOCK_WORDS = 4096
BLOCKS_A_SOURCE = 1024

WORD = "[^ \\t-\\r]+"


def water_fill(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Shares of ``total`` by weight, each at most ``most`` times its size; the excess is shared anew by weight."""
    target, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = min(float(total), most * sum(sizes))
    while open_:
        scale = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if weights[i] * scale > most * sizes[i]}
        if not full:
            for i in open_:
                target[i] = weights[i] * scale
            break
        for i in full:
            target[i] = most * sizes[i]
        left -= sum(target[i] for i in full)
        open_ -= full
    return target


def van_der_corput(i: np.ndarray) -> np.ndarray:
    """The base-2 radical inverse of i (below 2**52, where it is exact)."""
    out, scale, i = np.zeros(len(i)), 0.5, i.copy()
    while i.any():
        out += (i & 1) * scale
        i >>= 1
        scale /= 2
    return out


def rank_below(i: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How many points j < i of the sequence lie in [low, high): the rank of slot i in its source, in closed form.

    The points before i are, for each binary digit that is set in i, one complete block of a power of two, and such a
    block is an evenly spaced comb.
    """
    count, bits = np.zeros(len(i), np.int64), int(i.max(initial=0)).bit_length()
    for b in range(bits):
        on = (i >> b) & 1 == 1
        teeth = float(1 << b)
        shift = van_der_corput(np.maximum((i >> b) - 1, 0))
        comb = lambda x: np.clip(np.ceil(x * teeth - shift), 0, teeth)
        count += np.where(on, comb(high) - comb(low), 0).astype(np.int64)
    return count


def slots_needed(needed: np.ndarray, edges: np.ndarray) -> int:
    """The fewest slots that give every source at least ``needed`` of them."""
    enough = lambda n: (rank_below(np.full(len(needed), n), edges[:-1], edges[1:]) >= needed).all()
    high = 1
    while not enough(high):
        high *= 2
    low = high // 2
    while low + 1 < high:
        mid = (low + high) // 2
        low, high = (low, mid) if enough(mid) else (mid, high)
    return high


def schedule(spark: SparkSession, needed: Sequence[int]) -> DataFrame:
    """slot, source_no, rank: each slot's point picks a source by the cumulative shares of ``needed`` slots.

    A slot is left out once its source has all it needs. Ranks need no sort: the sequence tells them.
    """
    need = np.asarray(needed, np.int64)
    if not need.sum():
        return spark.createDataFrame([], "slot bigint, source_no int, rank bigint")
    cuts = np.concatenate([[0.0], np.cumsum(need) / need.sum()])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column(0).to_numpy()
            source = np.searchsorted(cuts, van_der_corput(slot), side="right") - 1
            rank = rank_below(slot, cuts[source], cuts[source + 1])
            on = rank < need[source]
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot[on]), pa.array(source[on], pa.int32()), pa.array(rank[on])], ["slot", "source_no", "rank"]
            )

    return spark.range(slots_needed(need, cuts)).mapInArrow(place, "slot bigint, source_no int, rank bigint")


def source_targets(totals: dict, weights: Sequence[float], share: float, most: float) -> list[tuple]:
    """(source, size, target) by code point, null last; ``weights`` repeat over the sources in that order."""
    names = sorted((s for s in totals if s is not None), key=lambda s: s) + [None] * (None in totals)
    sizes = [totals[s] for s in names]
    each = [weights[i % len(weights)] for i in range(len(names))]
    return list(zip(names, sizes, water_fill(sizes, each, share * sum(sizes), most)))


def measured(documents: DataFrame) -> DataFrame:
    """``documents`` with size (words: runs without ASCII white space; null text: 0) and the hash that orders a source."""
    return documents.withColumns(
        {
            "size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"),
            "_order": F.xxhash64("doc_id", "source", "text"),
        }
    )


def mix(rows: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Every row of ``measured(documents)`` with how many of its words a mix of all sources takes.

    Needs source, size and _order (the text may be dropped before); all columns stay but _order, and source_size,
    target, taken and first_slot (the place of its first block in the mix, null if nothing is taken) are added. Columns
    of these names are replaced. A source is ordered by the hash of its rows and cut into blocks of equal words; its
    blocks go, in that order and again from the first, to the slots that the schedule gives it, until its target is
    met (the last one in part). A null source is one of the sources, the last. Of a row without words nothing is
    taken. Repeated rows are taken each on its own; rows equal in source and hash are interchangeable. The names,
    sizes and targets of the sources, one row each like their weights, are worked out on the driver. An empty table
    gives an empty result.
    """
    spark = rows.sparkSession
    rows = rows.drop("source_size", "target", "taken", "first_slot")
    totals = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    plan = source_targets(totals, weights, share, most)
    goal = [int(target) for _, _, target in plan]
    block = max(1, min(BLOCK_WORDS, sum(goal) // (BLOCKS_A_SOURCE * max(1, len(plan)))))
    needed = [g // n * -(-n // block) + -(-(g % n) // block) if n else 0 for g, (_, n, _) in zip(goal, plan)]
    named = spark.createDataFrame(
        [(i, *p, goal[i], -(-p[1] // block)) for i, p in enumerate(plan)],
        "source_no int, _source string, source_size long, target double, _goal long, _blocks long",
    )
    coded = rows.withColumn("_one", F.lit(1).cast("long")).join(
        F.broadcast(named), F.col("source").eqNullSafe(F.col("_source"))
    )
    placed = running_sums(coded, "source_no", ["_order", "size"], {"_start": "size", "_row": "_one"}, "mix-order")

    first, last = F.floor(F.col("_start") / block), F.floor((F.col("_start") + F.col("size") - 1) / block)
    pieces = (
        placed.filter("size > 0")
        .select("source_no", "_row", "_start", "size", F.explode(F.sequence(first, last)).alias("_block"))
        .select(
            "source_no",
            "_row",
            "_block",
            F.greatest(F.col("_start") - F.col("_block") * block, F.lit(0)).alias("_low"),
            F.least(F.col("_start") + F.col("size") - F.col("_block") * block, F.lit(block)).alias("_high"),
        )
    )
    slots = schedule(spark, needed).join(F.broadcast(named.select("source_no", "source_size", "_goal", "_blocks")), "source_no")
    slots = slots.select(
        "source_no",
        "slot",
        (F.col("rank") % F.col("_blocks")).alias("_block"),
        # What is still to take when this slot's turn comes.
        (
            F.col("_goal")
            - F.floor(F.col("rank") / F.col("_blocks")) * F.col("source_size")
            - F.col("rank") % F.col("_blocks") * block
        ).alias("_left"),
    )
    words = F.least(F.col("_high"), F.col("_left")) - F.col("_low")
    taken = (
        pieces.join(slots, ["source_no", "_block"])
        .filter(words > 0)
        .groupBy("source_no", "_row")
        .agg(F.sum(words).alias("taken"), F.min("slot").alias("first_slot"))
    )
    out = placed.join(taken, ["source_no", "_row"], "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
    return out.drop("source_no", "_row", "_start", "_start_total", "_row_total", "_source", "_goal", "_blocks", "_order", "_one")
