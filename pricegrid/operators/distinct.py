"""Exact distinct counts that can be merged: bitmaps of dictionary-coded entities, kept for each day.

Counts of distinct stations or areas cannot be added up over days; bitmaps can be or-ed. Each entity gets a place once
and for all, from a dictionary that only grows; a day is the set of its places. Weeks, months or years are then counted
from the stored days, without the station rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricegrid.functions.columns import observed_on

#: What is counted, by the name of the count.
ENTITIES = {
    "unique_stations": ["eess_id"],
    "unique_station_labels": ["label"],
    "unique_provinces": ["province"],
    "unique_municipalities": ["municipality_id"],
    "unique_municipality_names": ["municipality"],
    "unique_localities": ["locality", "province_id", "municipality_id"],
    "unique_locality_names": ["locality"],
    "unique_communities": ["ccaa_id"],
}

#: Places of a bitmap, and chains of bitmaps that entities are dealt to, so that numbering is shared out.
BITS, CHAINS = 1 << 15, 32


def daily_entities(snapshots: DataFrame) -> DataFrame:
    """``date, kind, value``: every entity once a day. The first column of an entity must not be null; others may be."""
    found = [
        F.struct(F.lit(kind).alias("kind"), F.when(F.col(columns[0]).isNotNull(), F.to_json(F.array(*[F.col(c).cast("string") for c in columns]))).alias("value"))
        for kind, columns in ENTITIES.items()
    ]
    long = snapshots.select(observed_on().alias("date"), F.inline(F.array(*found)))
    return long.where(F.col("value").isNotNull()).groupBy("date", "kind", "value").agg(F.count("*").alias("n")).drop("n")


DICTIONARY_SCHEMA = "kind string, value string, chain int, number bigint"


def extend_dictionary(dictionary: DataFrame, entities: DataFrame) -> DataFrame:
    """Places of the entities that ``dictionary`` does not know yet, to be appended to it; known places never change."""
    fresh = entities.select("kind", "value").distinct().join(dictionary, ["kind", "value"], "left_anti")
    fresh = fresh.withColumn("chain", F.pmod(F.xxhash64("value"), F.lit(CHAINS)).cast("int"))
    last = dictionary.groupBy("kind", "chain").agg(F.max("number").alias("last"))
    order = Window.partitionBy("kind", "chain").orderBy("value")
    number = F.row_number().over(order) + F.coalesce("last", F.lit(-1))
    return fresh.join(last, ["kind", "chain"], "left").select("kind", "value", "chain", number.cast("long").alias("number"))


def day_states(entities: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``date, kind, chain, part, bits``: each day's entities as bitmaps of their places."""
    placed = entities.join(dictionary, ["kind", "value"])
    part = F.floor(F.col("number") / BITS).cast("int").alias("part")
    return placed.groupBy("date", "kind", "chain", part).agg(F.bitmap_construct_agg(F.col("number") % BITS).alias("bits"))


def counts_from_states(states: DataFrame, period: Column) -> DataFrame:
    """One row a ``period`` (of ``date``) with every count of ``ENTITIES``, from stored days alone."""
    merged = states.groupBy(period.alias("period"), "kind", "chain", "part").agg(F.bitmap_or_agg("bits").alias("bits"))
    held = F.sum(F.bitmap_count("bits"))
    counts = merged.groupBy("period").pivot("kind", list(ENTITIES)).agg(held)
    return counts.select("period", *[F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in ENTITIES])
