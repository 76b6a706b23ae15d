"""Contiguous shards of equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricegrid.llm.common import running_sums

#: Bytes that a document takes beside its text.
OVERHEAD = 8


def byte_shards(documents: DataFrame, shards: int) -> DataFrame:
    """Every row of ``documents`` with its shard, cut from the order of doc_id at equal targets of bytes.

    Takes doc_id and text; other columns are ignored. Returns doc_id, size, text_crc32, shard, slot. The size of a
    row is the UTF-8 bytes of its text (null: none) plus ``OVERHEAD``. A row goes to the shard in which the middle of
    its bytes falls, so that a shard misses its target by less than a row at either end; with fewer rows than shards,
    some stay empty. Rows of one doc_id are ordered by size and checksum, null comes first; rows equal in all three
    are interchangeable. An empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    sized = documents.select(
        "doc_id",
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit(1).cast("long").alias("one"),
        F.lit(0).alias("all"),
    )
    placed = running_sums(sized, "all", ["doc_id", "size", "text_crc32"], {"start": "size", "row": "one"}, "shard-ranges")
    middle = F.col("start") + F.col("size") / 2
    cut = placed.select(
        "doc_id",
        "size",
        "text_crc32",
        "row",
        F.least(F.floor(middle * shards / F.col("start_total")), F.lit(shards - 1)).cast("int").alias("shard"),
    )
    firsts = cut.groupBy("shard").agg(F.min("row").alias("first"))  # one row a shard
    return cut.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot")
    )
