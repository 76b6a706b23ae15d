"""Hard negatives of anchors by slot-decomposed selection: top-k of disjoint slots, merged downwards for each window."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricegrid.llm.common import counted, sent_by_value, stored, tasks_for

sent_by_value(__name__)

POSITIVES, NEGATIVES = 5, 5

#: A negative's score is at least so many hundredths of the positive's.
LEAST_PERCENT = 80

#: Rows of a packed chunk, and anchors of a packed block.
CHUNK_ROWS, BLOCK_ANCHORS = 4096, 1024

#: Groups that all rows are dealt into: each gives an anchor one partial answer, so this bounds what is exchanged.
ROW_GROUPS = 64

#: Blocks that are broadcast together, and how many such broadcasts a job has. A block of 64 components takes half a
#: megabyte.
BLOCKS_A_ROUND, ROUNDS_A_JOB = 16, 8

_EXACT = 1 << 53  # whole numbers up to here are exact as doubles
_MOST = 1 << 56  # a hundred times that is still a 64-bit number


def taking_part(rows: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, vector (whole numbers, floor(scale * x)) of the rows that take part.

    A null vec_id, label or vector, and a null or non-finite component, keep a row out.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.col("vec_id").cast("long"),
        F.col("label").cast("long"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("vector"),
    )


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Chunks of at most ``size`` rows (vec_id, label, vector): ids, labels, lengths, vectors as arrays in bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                part = batch.slice(a, size)
                ids, labels = (np.asarray(part.column(i), np.int64) for i in (0, 1))
                ends = part.column(2).offsets.to_numpy().astype(np.int64)
                values = part.column(2).values.to_numpy()[ends[0] : ends[-1]]
                arrays = [ids, labels, np.diff(ends), values.astype(np.float64)]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in arrays], ["ids", "labels", "lengths", "values"])

    return rows.mapInArrow(pack, "ids binary, labels binary, lengths binary, `values` binary")


def matrix(lengths: bytes, values: bytes) -> np.ndarray:
    """Vectors as rows of a matrix, shorter ones filled up with zeros."""
    n, x = np.frombuffer(lengths, np.int64), np.frombuffer(values, np.float64)
    width = int(n.max(initial=0))
    if (n == width).all():
        return x.reshape(len(n), width)
    out = np.zeros((len(n), width))
    out[np.arange(width)[None, :] < n[:, None]] = x
    return out


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole-numbered rows, exactly: as singles or doubles where these hold every sum, else as integers.

    Those beyond 2**56 either way count as that.
    """
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    most = width * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if most < 1 << 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < _EXACT:
        return (a @ b.T).astype(np.int64)
    as_whole = np.frompyfunc(int, 1, 1)
    return np.clip(as_whole(a) @ as_whole(b).T, -_MOST, _MOST).astype(np.int64)


def _first(group: np.ndarray, score: np.ndarray, vec_id: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each group, higher scores first, ties by smaller vec_id."""
    order = np.lexsort((vec_id, -score, group))
    group = group[order]
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    rank = np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))
    return order[rank < k]


class Best:
    """The first ``k`` candidates of each group so far."""

    def __init__(self, k: int):
        self.k, self.parts, self.waiting = k, [], 0

    def add(self, group: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        keep = _first(group, score, vec_id, self.k)
        self.parts.append((group[keep], score[keep], vec_id[keep]))
        self.waiting += len(keep)
        if len(self.parts) > 1 and self.waiting > 1 << 20:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.parts:
            columns = [np.concatenate(c) for c in zip(*self.parts)]
            keep = _first(*columns, self.k)
            self.parts = [tuple(c[keep] for c in columns)]
            self.waiting = len(keep)
            return self.parts[0]
        none = np.zeros(0, np.int64)
        return none, none, none


def slots(scores: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """For each score the slot it falls in: how many of the falling ``limits`` are at least as high, less one (-1: none)."""
    return (scores[:, None] <= limits).sum(axis=1) - 1


def _partial(pairs: DataFrame, k: int, positives: int) -> DataFrame:
    """block, place, slot, score, vec_id: each task's first ``k`` of every anchor's slots.

    ``pairs`` has a packed chunk of rows and a packed block of anchors in each row. Without limits (``positives`` 0) a
    row of the anchor's own label falls in slot 0; with limits, a row of another label falls in the slot of its score.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = {}
        for batch in batches:
            for r in batch.to_pylist():
                labels, own = np.frombuffer(r["labels"], np.int64), np.frombuffer(r["a_labels"], np.int64)
                shared = np.isin(own, labels)
                if not positives and not shared.any():
                    continue
                anchors, rows = matrix(r["a_lengths"], r["a_values"]), matrix(r["lengths"], r["values"])
                ids = np.frombuffer(r["ids"], np.int64)
                top = best.setdefault(r["block"], Best(k))
                if not positives:
                    # Only pairs of one label are multiplied.
                    for label in np.unique(own[shared]):
                        a, b = np.flatnonzero(own == label), np.flatnonzero(labels == label)
                        score = inner(anchors[a], rows[b])
                        least = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else None
                        x, y = np.nonzero(np.ones(score.shape, bool) if least is None else score >= least[:, None])
                        top.add(a[x], score[x, y], ids[b[y]])
                    continue
                limits = np.frombuffer(r["a_limits"], np.int64).reshape(len(own), positives)
                score = inner(anchors, rows)
                # An anchor with fewer positives repeats its last one, which makes an empty slot.
                wanted = (score <= limits[:, :1]) & (100 * score >= LEAST_PERCENT * limits[:, -1:]) & (own[:, None] != labels[None, :])
                x, y = np.nonzero(wanted)
                if len(x):
                    found = score[x, y]
                    top.add(x * positives + slots(found, limits[x]), found, ids[y])
        for block, top in best.items():
            group, score, vec_id = top.settle()
            step = max(1, positives)
            columns = [np.full(len(group), block, np.int64), group // step, group % step, score, vec_id]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["block", "place", "slot", "score", "vec_id"])

    return pairs.mapInArrow(run, "block bigint, place bigint, slot bigint, score bigint, vec_id bigint")


def _merged(partials: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each slot over all tasks, ranked from 1; a task has sent ``k`` at most, so groups are small."""
    order = Window.partitionBy("block", "place", "slot").orderBy(F.desc("score"), "vec_id")
    return partials.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _met(chunks: DataFrame, blocks: DataFrame, n_blocks: int, k: int, positives: int, name: str) -> DataFrame:
    """Partial answers of all blocks against all chunks: ``BLOCKS_A_ROUND`` blocks at a time are sent to every task."""
    jobs, rounds = [], range(0, n_blocks, BLOCKS_A_ROUND)
    for at in range(0, len(rounds), ROUNDS_A_JOB):
        parts = []
        for first in rounds[at : at + ROUNDS_A_JOB]:
            some = blocks.filter((F.col("block") >= first) & (F.col("block") < first + BLOCKS_A_ROUND))
            # Broadcast: at most BLOCKS_A_ROUND blocks of BLOCK_ANCHORS vectors, packed.
            pairs = chunks.join(F.broadcast(some.withColumn("all", F.lit(1))), "all")
            parts.append(_partial(pairs, k, positives))
        jobs.append(stored(reduce(DataFrame.union, parts), name))
    return reduce(DataFrame.union, jobs)


def hard_negatives(
    rows: DataFrame,
    anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
) -> DataFrame:
    """For each anchor and positive the hardest negatives whose score lies in the positive's window.

    ``rows`` has vec_id, label and embedding; ``anchor`` says which rows are anchors. A row's score is its inner product
    with the anchor, in whole numbers (floor(256 * x)); higher scores come first, ties by smaller vec_id. An anchor's
    positives are its first ``positives`` other rows of its label; for each, the first ``negatives`` rows of other labels
    with 80 % to 100 % of the positive's score are returned: anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score. A positive without such rows has none in the result; so has one with a negative score.

    The positives' scores are upper limits that cut all scores into disjoint slots. Tasks keep the first ``negatives``
    of each slot, and a window's answer is the merge of its own slot and those below, cut at its lower limit: scores
    above the limit are in no slot below, so the merge has all that the window can take.

    Nulls: see ``taking_part``. Repeated rows each count, as anchors too; an anchor leaves out itself, not its copies.
    Shorter vectors count as filled up with zeros. Scores beyond 2**56 either way count as that. Other columns are ignored; an
    empty table gives an empty result. Every anchor meets every row, packed by thousands; nothing but packed anchors is
    broadcast, a bounded number of blocks at a time.
    """
    spark = rows.sparkSession
    part, n_rows = counted(taking_part(rows).withColumn("is_anchor", F.coalesce(anchor, F.lit(False))), "vectors")
    anchors = part.filter("is_anchor").drop("is_anchor")
    anchors = packed(anchors.coalesce(tasks_for(spark, n_rows // 16)), BLOCK_ANCHORS).withColumn("key", F.monotonically_increasing_id())
    blocks, n_blocks = counted(anchors, "anchors")
    if not n_blocks:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    # Numbered from 0; one narrow row for a thousand anchors.
    numbers = blocks.select("key", (F.row_number().over(Window.orderBy("key")) - 1).cast("long").alias("block"))
    packs = ("ids", "labels", "lengths", "values")
    blocks = stored(blocks.join(numbers, "key").select(*[F.col(c).alias(f"a_{c}") for c in packs], "block"), "anchors")
    chunks = stored(packed(part.drop("is_anchor"), CHUNK_ROWS).withColumn("all", F.lit(1)), "chunks")
    chunks = chunks.coalesce(min(ROW_GROUPS, tasks_for(spark, n_rows, CHUNK_ROWS)))

    # One more than the positives, as an anchor finds itself.
    own = _merged(_met(chunks, blocks, n_blocks, positives + 1, 0, "own"), positives + 1)
    named = stored(blocks.select("block", "a_ids", "a_lengths", "a_values").mapInArrow(_names, "block bigint, place bigint, anchor_id bigint, norm bigint"), "names")
    own = own.join(named, ["block", "place"])
    itself = (F.col("vec_id") == F.col("anchor_id")) & (F.col("score") == F.col("norm"))
    anchor_rows = Window.partitionBy("block", "place").orderBy("rank")
    own = own.withColumn("itself", itself).withColumn("n", F.row_number().over(Window.partitionBy("block", "place", "itself").orderBy("rank")))
    own = own.filter("NOT itself OR n > 1").withColumn("slot", F.row_number().over(anchor_rows) - 1).filter(F.col("slot") < positives)
    found = stored(own.select("block", "place", "slot", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("limit")), "positives")

    # Limits go back into the blocks, as an array for each.
    each = found.groupBy("block", "place").agg(F.sort_array(F.collect_list("limit"), asc=False).alias("limits"))
    each = each.groupBy("block").agg(F.collect_list(F.struct("place", "limits")).alias("limits"))  # BLOCK_ANCHORS rows at most
    limited = stored(blocks.join(each, "block").mapInArrow(_with_limits(positives), _LIMITED), "limited")
    partial = _merged(_met(chunks, limited, n_blocks, negatives, positives, "slots"), negatives).drop("rank")

    # Suffix merges: the window of slot i takes slots i and on.
    windows = found.select("block", "place", F.col("slot").alias("window"), "anchor_id", "positive_id", "limit")
    taken = windows.join(partial, ["block", "place"]).filter("slot >= window AND 100 * score >= %d * limit" % LEAST_PERCENT)
    order = Window.partitionBy("block", "place", "window").orderBy(F.desc("score"), "vec_id")
    taken = taken.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return taken.select(
        "anchor_id",
        "positive_id",
        F.col("rank").cast("int").alias("rank"),
        F.col("vec_id").alias("negative_id"),
        F.col("limit").alias("positive_score"),
        F.col("score").alias("negative_score"),
    )


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            ids, vectors = np.frombuffer(r["a_ids"], np.int64), matrix(r["a_lengths"], r["a_values"])
            norm = [int(inner(v[None, :], v[None, :])[0, 0]) for v in vectors]
            columns = [np.full(len(ids), r["block"]), np.arange(len(ids)), ids, norm]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["block", "place", "anchor_id", "norm"])


_LIMITED = "block bigint, a_ids binary, a_labels binary, a_lengths binary, a_values binary, a_limits binary"


def _with_limits(positives: int):
    """The anchors that have a positive, with their limits; places stay, so those without have limits nothing reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                limits = np.full((len(r["a_ids"]) // 8, positives), -1, np.int64)  # a negative limit has an empty window
                for x in r["limits"]:
                    have = x["limits"]
                    limits[x["place"]] = have + have[-1:] * (positives - len(have))
                cells = [pa.array([r["block"]], pa.int64())]
                cells += [pa.array([r[c]], pa.binary()) for c in ("a_ids", "a_labels", "a_lengths", "a_values")]
                yield pa.RecordBatch.from_arrays([*cells, pa.array([limits.tobytes()], pa.binary())], [c.split(" ")[0] for c in _LIMITED.split(", ")])

    return run


ORACLE = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id, list_inner_product(a.q, r.q)::BIGINT AS score
  FROM v a JOIN v r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER w AS rank, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
 AND 80 * p.positive_score <= 100 * n.score AND n.score <= p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER w <= 5
"""
