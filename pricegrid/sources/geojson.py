"""Polygon features from GeoJSON files; gzipped files are read transparently."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ``coordinates`` nests three levels deep for Polygon and four for MultiPolygon: it is kept as text first and parsed
# by the geometry's type.
_FEATURE = T.StructType(
    [
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
        T.StructField(
            "geometry", T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])
        ),
    ]
)
_COLLECTION = T.StructType([T.StructField("features", T.ArrayType(_FEATURE))])
_RING = "array<array<double>>"
ZIP_PROPERTY = "COD_POSTAL"


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """``feature_idx, properties, geometry`` of every feature of FeatureCollection files.

    Features are numbered through all files, in the order of the file names: the high bits are the file's number.
    """
    rows = spark.read.schema(_COLLECTION).option("multiLine", True).json(path).withColumn("_file", F.col("_metadata.file_path"))
    files = rows.select("_file").distinct().withColumn("_no", F.row_number().over(Window.orderBy("_file")) - 1)  # one row a file
    numbered = explode_features(rows, ["_file"]).join(F.broadcast(files), "_file")
    return numbered.select(
        (F.shiftleft(F.col("_no").cast("long"), 32) + F.col("feature_idx")).alias("feature_idx"), "properties", "geometry"
    )


def explode_features(collections: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    found = collections.select(*keep, F.posexplode("features").alias("feature_idx", "f"))
    return found.select(*keep, "feature_idx", "f.properties", "f.geometry")


def parse_features(texts: DataFrame, column: str = "geojson") -> DataFrame:
    """Features from a table that holds one Feature object per row as text, with its ``feature_idx``."""
    parsed = texts.select("feature_idx", F.from_json(column, _FEATURE).alias("f"))
    return parsed.select("feature_idx", "f.properties", "f.geometry")


def outer_rings(features: DataFrame, name_property: str) -> DataFrame:
    """One row per outer ring: ``feature_idx, name, ring``. Other geometry types have no rings."""
    kind, text = F.col("geometry.type"), F.col("geometry.coordinates")
    single = F.array(F.from_json(text, f"array<{_RING}>")[0])
    multiple = F.transform(F.from_json(text, f"array<array<{_RING}>>"), lambda polygon: polygon[0])
    rings = F.when(kind == "Polygon", single).when(kind == "MultiPolygon", multiple)
    named = features.select("feature_idx", F.element_at("properties", name_property).alias("name"), F.explode(rings).alias("ring"))
    return named.where(F.size("ring") > 0)


def zip_features(features: DataFrame) -> DataFrame:
    """Postal-code features keyed by ``zip_code``; features without a code are dropped, the last of a repeated code stays."""
    coded = features.withColumn("zip_code", F.trim(F.element_at("properties", ZIP_PROPERTY))).where(F.col("zip_code") != "")
    last = F.max_by(F.struct("feature_idx", "geometry"), "feature_idx").alias("f")
    return coded.groupBy("zip_code").agg(last).select("zip_code", "f.*")
