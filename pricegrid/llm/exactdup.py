"""Exact duplicates by a tree merge of sorted digest runs, on built-in Spark expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricegrid.llm.common import stored

#: Runs that documents are dealt into, and how many of them one merge takes in: two binary digits a round.
RUNS = 64
FAN_IN = 4

SPACE = "[ \\t-\\r]+"


def digests(documents: DataFrame, runs: int = RUNS) -> DataFrame:
    """doc_id, n_chars (code points), digest (64 bits, the sort key), text_sha256 (which verifies it), run."""
    text = F.coalesce("text", F.lit(""))
    squeezed = F.regexp_replace(text, SPACE, "")
    hashed = documents.select("doc_id", F.length(text).cast("long").alias("n_chars"), F.sha2(squeezed, 256).alias("text_sha256"))
    return hashed.select(
        "doc_id",
        "n_chars",
        F.conv(F.substring("text_sha256", 1, 15), 16, 10).cast("long").alias("digest"),
        "text_sha256",
        F.pmod(F.xxhash64("doc_id", "n_chars"), F.lit(runs)).cast("int").alias("run"),
    )


def merge_runs(digested: DataFrame, runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """One row a distinct text: digest, text_sha256, keep (first of its rows), group_size.

    A run has one row for each of its texts: the number of rows and the best identifier (most code points, then
    smallest doc_id, null last). In each round the runs whose numbers differ in the last digits only are merged, so
    that after the last round one run is left. A run is spread over all tasks by its digests, and every round combines
    before it exchanges rows: a text held by a third of all rows sends one row from each task. Rows of a digest are
    merged only if their SHA-256 agrees too.
    """
    best = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id")).alias("keep")
    key = ["digest", "text_sha256"]
    merged = digested.groupBy("run", *key).agg(best, F.count(F.lit(1)).alias("group_size"))
    while runs > 1:
        runs = -(-runs // fan_in)
        merged = (
            merged.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
            .groupBy("run", *key)
            .agg(F.min("keep").alias("keep"), F.sum("group_size").alias("group_size"))
        )
    return merged.select(*key, F.col("keep.doc_id").alias("keep_id"), "group_size", F.col("keep.less").alias("less"))


def exact_duplicates(documents: DataFrame) -> DataFrame:
    """Every row of ``documents`` with the row that stays for its text.

    Takes doc_id and text; other columns are ignored. Returns doc_id, keep_id, group_size, kept, text_sha256. Texts
    are equal if they are the same after white space (space, tab to carriage return) is deleted; null counts as empty,
    so null, empty and blank texts are one group. The row with the most code points, then the smallest doc_id, stays;
    a null doc_id stays only if its group has no other among the longest. Rows that agree in doc_id and length cannot
    be told apart: all of them that tie for the first place are marked as kept. An empty table gives an empty result.
    """
    digested = stored(digests(documents), "digests")
    # Stored, so that the join deals both sides out anew and adaptive execution can split a hot text.
    groups = stored(merge_runs(digested), "digest-groups")
    joined = digested.join(groups, ["digest", "text_sha256"])
    return joined.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == -F.col("less"))).alias("kept"),
        "text_sha256",
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""
