"""Removal of long byte strings that occur more than once, by a distributed sparse suffix array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricegrid.llm.common import Prefixes, byte_column, chunks, mixed, partitions, sent_by_value, stored

sent_by_value(__name__)

LENGTH = 200

#: Leading bytes that suffixes are sorted by. Shorter: fewer suffixes, and more of them to compare further.
LEAD = 80

#: A text with this many copies, or one in ``HOT_SHARE`` of all rows if more, is hot: at most ``HOT_SHARE`` are broadcast.
HOT_COPIES, HOT_SHARE = 1000, 100_000

#: Bytes of the contexts of one lead that are compared in one task; those of a commoner lead are compared window by window.
GROUP_BYTES = 4 << 20


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def windows(data: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all strings of ``length`` bytes."""
    at = np.arange(len(data) - length + 1)
    return mixed(Prefixes(data.astype(np.uint64) + np.uint64(1)).of(at, at + length))


_PLACE = np.uint64((1 << 40) - 1)


def suffix_runs(data: np.ndarray, offsets: np.ndarray, length: int, lead: int):
    """The suffixes that represent each text: text number, lead, context, first window, number of windows.

    A window is a string of ``length`` bytes. Its lead is, of the ``lead``-byte strings in it, the first of those with
    the least hash, so equal windows have equal leads at equal offsets; windows in a row with the lead at one place
    are a run, and their bytes are its context. So only one suffix in some 60 is sorted, and no repeat of ``length``
    bytes can be missed.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    prefixes = Prefixes(data.astype(np.uint64) + np.uint64(1))
    at = np.arange(len(data) - lead + 1)
    hashed = mixed(prefixes.of(at, at + lead))
    # The leading 24 bits decide, then the place, in the other 40.
    least = sliding_minimum((hashed & ~_PLACE) | at.astype(np.uint64), length - lead + 1)
    start = np.arange(len(least))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
    whole = start + length <= offsets[1:][row]
    start, row, least = start[whole], row[whole], least[whole]
    if not len(start):
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    new = np.ones(len(start), bool)
    new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    context = mixed(prefixes.of(start[first], start[first] + count + length - 1) + count.astype(np.uint64))
    return row[first], hashed[(least[first] & _PLACE).astype(np.int64)], context, start[first] - offsets[row[first]], count


SUFFIX = "lead bigint, context bigint, node bigint, at int, n int"


def suffixes(texts: DataFrame, length: int, lead: int) -> DataFrame:
    """The runs of every row of ``texts`` (node, text, twice); twice: this row stands for several."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_column(batch.column(1))
            node, twice = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            for a, b in chunks(offsets):
                row, least, context, at, n = suffix_runs(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], length, lead)
                own = np.arange(len(row))
                own = np.concatenate([own, own[twice[a:b][row]]]) if len(row) else own
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(least[own].view(np.int64)),
                        pa.array(context[own].view(np.int64)),
                        pa.array(node[a:b][row[own]]),
                        pa.array(at[own], pa.int32()),
                        pa.array(n[own], pa.int32()),
                    ],
                    ["lead", "context", "node", "at", "n"],
                )

    return texts.select("node", "text", "twice").mapInArrow(cut, SUFFIX)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted bucket whose lead a neighbour has too, and the bucket's first and last row.

    repeated: a neighbour has the whole context; first: it is the first of its context; edge: 1 first row, 2 last, 3 both.
    """
    part = TaskContext.get().partitionId()
    held = None  # the last row so far, and the lead and context before it
    for table in _with_end(batches):
        last = table is None
        rows = held[0] if last else pa.Table.from_batches([table]) if held is None else pa.concat_tables([held[0], pa.Table.from_batches([table])])
        lead, context = rows.column("lead").to_numpy(), rows.column("context").to_numpy()
        n = len(lead)
        same_lead, same = np.zeros(n + 1, bool), np.zeros(n + 1, bool)  # between row i-1 and row i
        same_lead[1:-1] = lead[1:] == lead[:-1]
        same[1:-1] = same_lead[1:-1] & (context[1:] == context[:-1])
        edge = np.zeros(n, np.int8)
        if held is None:
            edge[0] = 1
        else:
            same_lead[0], same[0], edge[0] = held[1], held[2], held[3]
        if last:
            edge[-1] += 2
        upto = n if last else n - 1
        shared = same_lead[:-1] | same_lead[1:]
        keep = np.flatnonzero((shared | (edge > 0))[:upto])
        if len(keep):
            out = rows.take(pa.array(keep))
            for name, values in (
                ("shared", shared[keep]),
                ("repeated", (same[:-1] | same[1:])[keep]),
                ("first", ~same[:-1][keep]),
                ("edge", edge[keep].astype(np.int32)),
                ("part", np.full(len(keep), part, np.int32)),
            ):
                out = out.append_column(name, pa.array(values))
            yield from out.combine_chunks().to_batches()
        if not last:
            held = rows.slice(n - 1), same_lead[n - 1], same[n - 1], edge[n - 1]


def _with_end(batches):
    some = False
    for batch in batches:
        if batch.num_rows:
            some = True
            yield batch
    if some:
        yield None


def neighbours(texts: DataFrame, length: int, lead: int) -> DataFrame:
    """Suffix runs whose lead occurs more than once: lead, context, node, at, n, repeated, first.

    Splitters that Spark samples deal the runs out by ranges of (lead, context, node, at), so that a lead or context of
    any number of rows is spread over buckets. Each bucket is sorted and neighbours are compared; the first and last
    rows of the buckets, two a bucket, are compared across the boundaries on the driver.
    """
    spark = texts.sparkSession
    order = ["lead", "context", "node", "at"]
    dealt = suffixes(texts, length, lead).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    found = SUFFIX + ", shared boolean, repeated boolean, first boolean, edge int, part int"
    compared = stored(dealt.mapInArrow(_compare, found), "suffixes")
    names = ["lead", "context", "node", "at", "n", "repeated", "first"]
    edges = [r.asDict() for r in compared.filter("edge > 0").collect()]
    edges.sort(key=lambda r: (r["part"], r["edge"] == 2))
    for x, y in zip(edges, edges[1:]):
        if x["part"] != y["part"] and x["lead"] == y["lead"]:
            x["shared"] = y["shared"] = True
            if x["context"] == y["context"]:
                x["repeated"] = y["repeated"] = True
    fixed = spark.createDataFrame([tuple(r[c] for c in names) for r in edges if r["shared"]], SUFFIX + ", repeated boolean, first boolean")
    return compared.filter("edge = 0").select(*names).union(fixed)


def _contexts(rows: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """The bytes of the runs ``rows``: lead, hot, node, at, n, repeated, bytes."""
    lists = rows.groupBy("node").agg(F.collect_set(F.struct("lead", "hot", "at", "n", "repeated")).alias("runs"))
    named = texts.select("node", "text").join(stored(lists, "runs"), "node")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for node, text, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                raw = text.as_py().encode()
                out += [r | {"node": node, "bytes": raw[r["at"] : r["at"] + r["n"] + length - 1]} for r in runs]
            names = ["lead", "hot", "node", "at", "n", "repeated", "bytes"]
            types = [pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in zip(names, types)], names)

    return named.select("node", "text", "runs").mapInArrow(
        cut, "lead bigint, hot boolean, node bigint, at int, n int, repeated boolean, bytes binary"
    )


def _hashed(contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows of some contexts: context number, offset in it, hash."""
    sizes = np.array([len(c) for c in contexts])
    hashed = windows(np.frombuffer(b"".join(contexts), np.uint8), length)
    row = np.repeat(np.arange(len(sizes)), sizes)[: len(hashed)]
    offset = np.arange(len(hashed)) - (np.cumsum(sizes) - sizes)[row]
    whole = offset + length <= sizes[row]
    return row[whole], offset[whole], hashed[whole]


def _spans(flags_at: np.ndarray) -> list[tuple[int, int]]:
    """Runs of whole numbers in a row as (first, last + 1)."""
    cut = np.flatnonzero(np.diff(flags_at) != 1) + 1
    return [(int(x[0]), int(x[-1]) + 1) for x in np.split(flags_at, cut) if len(x)]


def _resolve_groups(length: int):
    """Windows of the contexts of one lead that occur again among them; rows come sorted by lead, groups are bounded."""

    def resolve(group: list[tuple]) -> Iterator[tuple[int, int, int]]:
        row, offset, hashed = _hashed([g[4] for g in group], length)
        _, inverse = np.unique(hashed, return_inverse=True)
        weight = np.bincount(inverse, weights=np.array([2 if g[3] else 1 for g in group])[row])
        again = weight[inverse] > 1
        bounds = np.searchsorted(row, np.arange(len(group) + 1))
        for k, g in enumerate(group):
            if not g[3]:
                here = slice(bounds[k], bounds[k + 1])
                for a, b in _spans(offset[here][again[here]]):
                    yield g[1], g[2] + a, g[2] + b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in _with_end(batches):
            out: list[tuple[int, int, int]] = []
            rows = zip(*[batch.column(c).to_pylist() for c in ("lead", "node", "at", "repeated", "bytes")]) if batch else [(None,)]
            for r in rows:
                if group and r[0] != group[0][0]:
                    out += resolve(group)
                    group = []
                group.append(r)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32()))], ["node", "start", "end"]
            )

    return run


def _exploded(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, offset, hashed = _hashed(batch.column("bytes").to_pylist(), length)
            at, take = batch.column("at").to_numpy(), pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("lead").take(take),
                    pa.array(hashed.view(np.int64)),
                    batch.column("node").take(take),
                    pa.array((at[row] + offset).astype(np.int32)),
                    batch.column("repeated").take(take),
                ],
                ["lead", "window", "node", "start", "repeated"],
            )

    return run


def repeated_windows(texts: DataFrame, length: int = LENGTH, lead: int = LEAD) -> DataFrame:
    """node, start, end: runs of windows of ``texts`` (node, text, twice) that occur elsewhere too.

    A context that occurs again settles all its windows. A run whose lead is shared but whose context is not, which
    happens at the ends of repeats, is compared window by window with one run of each other context of its lead: in
    one task while these are few, else by grouping the windows themselves, which spreads any number of them.
    """
    runs = stored(neighbours(texts, length, lead), "shared")
    settled = runs.filter("repeated").select("node", F.col("at").alias("start"), (F.col("at") + F.col("n")).alias("end"))
    needed = runs.filter("first OR NOT repeated")
    by_lead = needed.groupBy("lead").agg(F.sum(F.col("n") + length - 1).alias("size"), F.max(~F.col("repeated")).alias("open"))
    by_lead = stored(by_lead.filter("open").select("lead", (F.col("size") > GROUP_BYTES).alias("hot")), "leads")
    contexts = stored(_contexts(needed.join(by_lead, "lead"), texts, length), "contexts")
    few = contexts.filter("NOT hot").repartition("lead").sortWithinPartitions("lead")
    some = few.mapInArrow(_resolve_groups(length), "node bigint, start int, end int")
    each = contexts.filter("hot").mapInArrow(_exploded(length), "lead bigint, window bigint, node bigint, start int, repeated boolean")
    again = each.groupBy("lead", "window").agg(F.sum(F.when(F.col("repeated"), 2).otherwise(1)).alias("w")).filter("w > 1")
    many = each.filter("NOT repeated").join(stored(again.drop("w"), "windows"), ["lead", "window"])
    return settled.union(some).union(many.select("node", "start", (F.col("start") + 1).alias("end")))


def without_repeats(documents: DataFrame, length: int = LENGTH, lead: int = LEAD) -> DataFrame:
    """Every row of ``documents`` with the bytes of its text that no repeated string of ``length`` bytes covers.

    Needs doc_id and text; other columns are ignored. Returns doc_id, kept (binary), n_bytes, n_removed, n_spans. Texts
    are taken as UTF-8 bytes, null as empty; a byte goes if a string of ``length`` bytes that covers it also starts
    anywhere else, in the same text or another one; overlaps count, and all is judged on the input. A text shorter than
    ``length`` loses nothing; a text of that length or more with an equal one loses all. Texts, leads and windows are
    told apart by 64-bit hashes, windows within their lead. An empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    texts = documents.select("doc_id", text.alias("text"), F.xxhash64(text).alias("node"))
    copies = stored(texts.groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("_id")).filter("copies > 1"), "copies")
    total = documents.count()
    hot = copies.filter(F.col("copies") >= max(HOT_COPIES, total // HOT_SHARE)).select("node", "_id", F.lit(True).alias("twice"))
    once = texts.join(F.broadcast(hot), "node", "left")
    # Of a hot text one row stands for all; where its doc_id is repeated or null, several do.
    once = once.filter(F.col("twice").isNull() | F.col("doc_id").eqNullSafe(F.col("_id")))
    once = once.select("node", "text", F.coalesce("twice", F.lit(False)).alias("twice"))
    spans = repeated_windows(once, length, lead)
    marks = spans.groupBy("node").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    marked = texts.join(stored(marks, "marks"), "node", "left").join(copies.select("node", "copies"), "node", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [t.as_py().encode() for t in batch.column(1)]
            kept, removed, runs = [], [], []
            for raw, spans, copies in zip(raws, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                out, gone, n = raw, 0, 0
                if copies and len(raw) >= length:
                    out, gone, n = b"", len(raw), 1
                elif spans:
                    edge = np.zeros(len(raw) + 1, np.int64)
                    np.add.at(edge, [s["start"] for s in spans], 1)
                    np.add.at(edge, [s["end"] + length - 1 for s in spans], -1)
                    covered = np.cumsum(edge)[:-1] > 0
                    gone = int(covered.sum())
                    n = int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum())
                    out = np.frombuffer(raw, np.uint8)[~covered].tobytes()
                kept.append(out), removed.append(gone), runs.append(n)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(kept, pa.binary()),
                    pa.array([len(r) for r in raws], pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(runs, pa.int64()),
                ],
                ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"],
            )

    return marked.select("doc_id", "text", "spans", "copies").mapInArrow(
        cut, "doc_id bigint, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint"
    )


#: The same from all windows of the texts as hexadecimal strings, cut into pieces of 500 bytes first.
ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, j // 500 AS k, substr(h, 2 * j + 1, 1398) AS part FROM (SELECT doc_id, h, unnest(range(0, CAST(len(h) // 2 - 199 AS BIGINT), 500)) AS j FROM d)),
w AS (SELECT doc_id, 500 * k + i AS p, md5_number(substr(part, 2 * i + 1, 400)) AS g FROM (SELECT *, unnest(range(0, CAST(len(part) // 2 - 199 AS BIGINT))) AS i FROM c)),
again AS (SELECT g FROM w GROUP BY g HAVING count(*) > 1),
s AS (SELECT doc_id, p, p + 200 AS q FROM w WHERE g IN (SELECT g FROM again)),
m AS (SELECT *, max(q) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
r AS (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run, q FROM m),
runs AS (SELECT doc_id, run, min(p) AS a, max(q) AS b FROM r GROUP BY ALL),
per AS (SELECT doc_id, list(a ORDER BY a) AS aa, list(b ORDER BY a) AS bb, sum(b - a) AS gone FROM runs GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(len(aa), 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN aa IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(aa) + 1), lambda k:
    substr(h, CAST(2 * (CASE WHEN k = 0 THEN 0 ELSE bb[k] END) + 1 AS BIGINT), CAST(2 * ((CASE WHEN k = len(aa) THEN len(h) // 2 ELSE aa[k + 1] END) - (CASE WHEN k = 0 THEN 0 ELSE bb[k] END)) AS BIGINT))), '') END)) AS kept_sha256
FROM d LEFT JOIN per USING (doc_id)
"""
