"""Helpers shared by the corpus operators: tables, stored intermediates, global running sums, byte arrays of texts."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window



def sent_by_value(module: str) -> None:
    """Functions of ``module`` go to the workers as they are, so that no executor needs this package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


sent_by_value(__name__)

SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}

#: Bytes of text that a Python task works on at once; a longer single text is worked on alone.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; one of its own only where it is unset on one machine."""
    conf = spark.sparkContext.getConf()
    named = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="pricegrid-llm-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``stored``, and the number of rows, which the write itself counts."""
    seen = Observation()
    return stored(df.observe(seen, F.count(F.lit(1)).alias("n")), name), seen.get["n"]


def tasks_for(spark: SparkSession, rows: int, rows_a_task: int = 50_000) -> int:
    """Tasks for a table of narrow rows: one for every ``rows_a_task``, up to one a shuffle partition."""
    return max(1, min(partitions(spark), -(-rows // rows_a_task)))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: cuts lineage and survives lost executors.

    The table read back has no partitioning that Spark relies on, so a later join exchanges it like any other table
    and adaptive execution may split its hot partitions.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def aside(df: DataFrame, *needed: str) -> DataFrame:
    """``df`` with its columns renamed, but those needed, so that none clashes with what an operator adds."""
    return df.select(*[F.col(f"`{c}`").alias(c if c in needed else f"_c{i}") for i, c in enumerate(df.columns)])


def restored(df: DataFrame, columns: list[str], *needed: str) -> DataFrame:
    """The columns that were put ``aside``, under their own names again."""
    return df.select(*[F.col(c if c in needed else f"_c{i}").alias(c) for i, c in enumerate(columns)])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_sums(df: DataFrame, group: str, order: list[str], sums: dict[str, str], name: str) -> DataFrame:
    """Exclusive running sums of columns within each group, in a total order, without one task per group.

    ``sums`` maps a new column to the column it adds up; ``<new>_total`` has the sum over the whole group. Rows are dealt out by ranges of (group, order), each
    partition adds up its own rows, and the totals of the partitions before it are added: one row for each partition
    and group is all that is put in one place. The ranges are stored, so that a rerun task sees the same ones.
    """
    spark = df.sparkSession
    dealt = stored(
        df.repartitionByRange(partitions(spark), group, *order).withColumn("_range", F.spark_partition_id()), name
    )
    here = Window.partitionBy("_range", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(group)
    zero = F.lit(0).cast("long")
    totals = dealt.groupBy("_range", group).agg(*[F.sum(c).alias(f"_{out}") for out, c in sums.items()])
    totals = totals.select(
        F.col("_range").alias("_r"),
        F.col(group).alias("_g"),
        *[F.coalesce(F.sum(f"_{out}").over(before), zero).alias(f"_{out}") for out in sums],
        *[F.sum(f"_{out}").over(every).alias(f"{out}_total") for out in sums],
    )
    local = dealt.withColumns({out: F.coalesce(F.sum(c).over(here), zero) for out, c in sums.items()})
    joined = local.join(totals, (F.col("_range") == F.col("_r")) & F.col(group).eqNullSafe(F.col("_g")))
    return joined.withColumns({out: F.col(out) + F.col(f"_{out}") for out in sums}).drop(
        "_r", "_g", "_range", *[f"_{out}" for out in sums]
    )


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, null as empty, and the offsets of its rows (one more than rows)."""
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offs = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows [a, b) of at most ``limit`` bytes, or a single longer row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, b
        a = b


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the result."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD1B54A32D192ED03)
    return x ^ (x >> np.uint64(32))


_BASE = np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class Kept(dict):
    """What a Python process keeps between calls; never sent to another one."""

    def __reduce__(self):
        return Kept, ()


_POWERS = Kept()


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; kept, at twice the length last asked for."""
    have = _POWERS.get(int(base))
    if have is None or len(have) <= n:
        have = np.full(2 * n + 2, base, np.uint64)
        have[0] = 1
        have = _POWERS[int(base)] = np.multiply.accumulate(have)
    return have[: n + 1]


class Prefixes:
    """Hashes of any slices of an array of whole numbers, from one running sum (polynomial modulo 2**64)."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values.astype(np.uint64) * _powers(_BASE, n)[:n], out=self.sums[1:])
        self.back = _powers(_INVERSE, n)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]


#: Bytes of words once A-Z are lower-cased: digits, a-z and every byte of a code point above 127.
IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts: lower-cased bytes, starts, ends, and for each text the number of words before it (and all)."""
    low = LOWER[data]
    inside = IS_WORD[low]
    if not len(low):
        none = np.zeros(0, np.int64)
        return low, none, none, np.zeros(len(offsets), np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(low))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return low, starts, ends, np.searchsorted(starts, offsets)


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words; bytes count from 1, so that no byte is lost at the front."""
    return mixed(Prefixes(low.astype(np.uint64) + np.uint64(1)).of(starts, ends) + (ends - starts).astype(np.uint64))
