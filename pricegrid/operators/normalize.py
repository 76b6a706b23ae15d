"""Landed documents -> clean snapshot rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricegrid import schema as S
from pricegrid.functions.columns import clean_text, local_time_to_utc_iso, parse_decimal


def document_problem():
    """Why a document cannot be used, or null for a usable one. The first failing test names the reason."""
    return (
        F.when(F.col("ResultadoConsulta").isNull() | (F.col("ResultadoConsulta") != "OK"), "status")
        .when(F.coalesce(F.size("ListaEESSPrecio"), F.lit(-1)) <= 0, "no_stations")
        .when(F.coalesce(F.col("Fecha"), F.lit("")) == "", "no_time")
        .when(local_time_to_utc_iso("Fecha").isNull(), "bad_time")
    )


def split_documents(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable documents, and the rejected ones with a ``reason`` (their stations left out)."""
    checked = documents.withColumn("reason", document_problem())
    usable = checked.where(F.col("reason").isNull()).drop("reason")
    rejected = checked.where(F.col("reason").isNotNull()).drop("ListaEESSPrecio")
    return usable, rejected


def sort_out(landed: DataFrame, column: str = "document") -> tuple[DataFrame, DataFrame]:
    """Usable documents, parsed, and the rejected rows as they landed, with a ``reason``.

    ``column`` has a document's text. A text that is null, empty, cut off or not of the documents' types is
    ``unreadable``; other reasons are those of ``document_problem``. Rejected rows keep their text, so that they can
    be stored, repaired and sorted out again; other columns pass through on both sides.
    """
    schema = T.StructType([*S.RAW_DOCUMENT_SCHEMA.fields, T.StructField("_unread", T.StringType())])
    read = F.from_json(column, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_unread"})
    carried = [c for c in landed.columns if c != column]
    parsed = landed.withColumn("_d", read).select(*landed.columns, "_d.*")
    unreadable = F.col("_unread").isNotNull() | F.coalesce(F.trim(column), F.lit("")).isin("", "null")
    checked = parsed.withColumn("reason", F.when(unreadable, "unreadable").otherwise(document_problem()))
    usable = checked.where("reason IS NULL").select(*carried, *S.RAW_DOCUMENT_SCHEMA.names)
    return usable, checked.where("reason IS NOT NULL").select(*landed.columns, "reason")


def explode_documents(documents: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per station: ``Fecha`` plus the mapped source fields under their column names, still text."""
    rows = documents.select(*keep, "Fecha", F.explode("ListaEESSPrecio").alias("station"))
    fields = [F.col("station").getField(src).alias(dst) for src, dst in S.SOURCE_FIELDS.items()]
    return rows.select(*keep, "Fecha", *fields)


def normalize_stations(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Typed snapshot rows in contract order: cleaned text, decimal prices, UTC time stamp."""
    typed = [
        (parse_decimal(c) if c in S.FLOAT_COLUMNS else clean_text(c)).alias(c) for c in S.SNAPSHOT_COLUMNS if c != "timestamp"
    ]
    return rows.select(*keep, local_time_to_utc_iso("Fecha").alias("timestamp"), *typed)


def normalize_documents(documents: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    usable, _ = split_documents(documents)
    return normalize_stations(explode_documents(usable, keep), keep)


def public_sale(stations: DataFrame) -> DataFrame:
    """Stations open to the public; snapshots without the column pass through."""
    return stations.where(F.col("sale_type") == "p") if "sale_type" in stations.columns else stations


def with_labels(stations: DataFrame, labels: Sequence[str] | None) -> DataFrame:
    """Only the given labels; no labels means no filter."""
    return stations.where(F.col("label").isin(list(labels))) if labels else stations
