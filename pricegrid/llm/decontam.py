"""Benchmark decontamination by a broadcast hash set of word n-grams."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricegrid.llm.common import Prefixes, aside, byte_column, chunks, mixed, restored, sent_by_value, stored, word_hashes, words

sent_by_value(__name__)

WINDOW = 13

#: Bytes of benchmark text whose n-grams are broadcast at once, about 170,000 n-grams; a larger benchmark takes as many scans.
BLOCK_BYTES = 1 << 20

_FILTER_BITS = 20


def grams_of(items: list[tuple[str, str]], window: int) -> SimpleNamespace:
    """The n-grams of some benchmark items: a hash set to scan with, and their words and items to verify hits."""
    lengths: set[int] = set()
    found: dict[bytes, set[str]] = defaultdict(set)
    hashes: dict[bytes, int] = {}
    for name, text in items:
        data = np.frombuffer(text.encode(), np.uint8)
        low, starts, ends, _ = words(data, np.array([0, len(data)]))
        if not len(starts):
            continue
        n = min(window, len(starts))
        lengths.add(n)
        at = np.arange(len(starts) - n + 1)
        raw, own = low.tobytes(), window_hashes(low, starts, ends, at, n)
        for p, h in zip(at.tolist(), own.tolist()):
            gram = spelled(raw, starts, ends, p, n)
            found[gram].add(name)
            hashes[gram] = h
    by_hash: dict[int, list[tuple[bytes, frozenset]]] = {}
    for gram, names in found.items():
        by_hash.setdefault(hashes[gram], []).append((gram, frozenset(names)))
    known = np.sort(np.array(list(by_hash), np.uint64))
    marked = np.zeros(1 << _FILTER_BITS, bool)
    marked[known >> np.uint64(64 - _FILTER_BITS)] = True
    return SimpleNamespace(lengths=sorted(lengths), by_hash=by_hash, sorted=known, filter=marked)


def spelled(raw: bytes, starts: np.ndarray, ends: np.ndarray, p: int, n: int) -> bytes:
    return b" ".join([raw[a:b] for a, b in zip(starts[p : p + n].tolist(), ends[p : p + n].tolist())])


def window_hashes(low, starts, ends, at: np.ndarray, n: int, each: Prefixes | None = None) -> np.ndarray:
    each = each or Prefixes(word_hashes(low, starts, ends))
    return mixed(each.of(at, at + n) + np.uint64(n))


def scan(data: np.ndarray, offsets: np.ndarray, grams: SimpleNamespace) -> tuple[np.ndarray, list[list[int]], list[set[str]], tuple]:
    """For each text: number of words, merged ranges of hit words (flat: start, end), names of items; and the words."""
    low, starts, ends, before = words(data, offsets)
    n_words = np.diff(before)
    hits: list[list[tuple[int, int]]] = [[] for _ in n_words]
    names: list[set[str]] = [set() for _ in n_words]
    each, raw = Prefixes(word_hashes(low, starts, ends)), None
    for n in grams.lengths:
        at = np.arange(max(0, len(starts) - n + 1))
        hashed = window_hashes(low, starts, ends, at, n, each)
        maybe = np.flatnonzero(grams.filter[hashed >> np.uint64(64 - _FILTER_BITS)])
        maybe = maybe[np.isin(hashed[maybe], grams.sorted)]
        row = np.searchsorted(before, maybe, side="right") - 1
        inside = maybe + n <= before[row + 1]
        for p, r in zip(maybe[inside].tolist(), row[inside].tolist()):
            raw = raw or low.tobytes()
            gram = spelled(raw, starts, ends, p, n)
            for known, items in grams.by_hash[int(hashed[p])]:
                if known == gram:
                    names[r] |= items
                    hits[r].append((p - int(before[r]), p - int(before[r]) + n))
    return n_words, [merged(h) for h in hits], names, (starts, ends, before)


def merged(ranges: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The items, about ``block_bytes`` of text at a time; an item without an id has an empty name."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes)
    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    for k in range(n):
        part = named if n == 1 else named.filter(F.pmod(F.xxhash64("name", "text"), F.lit(n)) == k)
        yield [tuple(r) for r in part.collect()]


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every row of ``documents`` with the words that it shares with benchmark items.

    Needs text, and item_id and text of ``benchmark``; all columns stay, and n_words, n_hit, n_items, items (ids as
    sorted strings), hit_ranges (flat array of word numbers: start, end, ...) and contaminated are added; columns of
    these names are replaced. Words are runs of 0-9, a-z and code points above 127 once A-Z are lower-cased. A window
    is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window. Every window of a
    text is looked up in the broadcast hash set and verified word by word. A word is hit inside any occurrence; a text
    is contaminated if at least a twentieth of its words are hit. A null or empty text has no words and is clean; an
    item without words has no window; repeated items count once by id. With an empty benchmark everything is clean. A
    benchmark larger than ``block_bytes`` is taken in blocks, one scan each, so that the broadcast stays bounded.
    """
    spark = documents.sparkSession
    rows = documents.drop("n_words", "n_hit", "n_items", "items", "hit_ranges", "contaminated")
    kept = rows.schema
    found = T.StructType(
        [
            *kept.fields,
            T.StructField("n_words", T.LongType()),
            T.StructField("hit_ranges", T.ArrayType(T.IntegerType())),
            T.StructField("items", T.ArrayType(T.StringType())),
            T.StructField("n_hit", T.LongType()),
        ]
    )
    width = len(kept.fields)
    for k, items in enumerate(blocks(benchmark, block_bytes)):
        if k:
            rows = stored(rows, "decontam")
        rows = rows.mapInArrow(_scanner(spark.sparkContext.broadcast(grams_of(items, window)), width, kept.names.index("text")), found)
    if rows.schema == kept:  # no item has a text
        rows = rows.mapInArrow(_scanner(spark.sparkContext.broadcast(grams_of([], window)), width, kept.names.index("text")), found)
    return rows.withColumns(
        {
            "n_items": F.size("items").cast("long"),
            "contaminated": (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")),
        }
    )


def _scanner(shared, width: int, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = shared.value
        for batch in batches:
            data, offsets = byte_column(batch.column(text))
            earlier = batch.schema.get_field_index("hit_ranges")
            for a, b in chunks(offsets):
                part = batch.slice(a, b - a)
                n_words, ranges, names, _ = scan(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], grams)
                if earlier >= 0:
                    before = part.column(earlier).to_pylist(), part.column(earlier + 1).to_pylist()
                    ranges = [merged([*pairs(x), *pairs(y)]) for x, y in zip(ranges, before[0])]
                    names = [x | set(y) for x, y in zip(names, before[1])]
                added = [
                    pa.array(n_words, pa.int64()),
                    pa.array(ranges, pa.list_(pa.int32())),
                    pa.array([sorted(x) for x in names], pa.list_(pa.string())),
                    pa.array([sum(r[1::2]) - sum(r[::2]) for r in ranges], pa.int64()),
                ]
                columns = [part.column(i) for i in range(width)] + added
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:width], "n_words", "hit_ranges", "items", "n_hit"])

    return run


def pairs(flat: list[int]) -> list[tuple[int, int]]:
    return list(zip(flat[::2], flat[1::2]))


def without_hits(text: str, ranges: list[int]) -> str:
    """A text with its hit words cut out, each range from the first word's start to the last one's end."""
    data = np.frombuffer(text.encode(), np.uint8)
    _, starts, ends, _ = words(data, np.array([0, len(data)]))
    keep = np.ones(len(data), bool)
    for a, b in pairs(ranges):
        keep[starts[a] : ends[b - 1]] = False
    return data[keep].tobytes().decode()


def clean(documents: DataFrame, benchmark: DataFrame, spans: bool = False) -> DataFrame:
    """``documents`` without contaminated rows; with ``spans`` all rows stay and their hit words are cut out instead."""
    found = contamination(aside(documents, "text"), benchmark)
    if not spans:
        return restored(found.filter(~F.col("contaminated")), documents.columns, "text")
    at, out = documents.columns.index("text"), documents.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, ranges = batch.column(at).to_pylist(), batch.column(len(out)).to_pylist()
            new = pa.array([without_hits(t, r) if r else t for t, r in zip(text, ranges)], batch.column(at).type)
            columns = [new if i == at else batch.column(i) for i in range(len(out))]
            yield pa.RecordBatch.from_arrays(columns, out.names)

    return found.select(*aside(documents, "text").columns, "hit_ranges").mapInArrow(cut, out)


#: The same from joins of all windows as text.
ORACLE = r"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bn AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM bn)),
dw AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d CROSS JOIN (SELECT DISTINCT n FROM bw))),
h AS (SELECT doc_id, p, n, item_id FROM dw JOIN bw USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS k FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
