"""Table contracts and fixed domain values."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------------------------
# Source field -> column name, in the order of the published feed.
SOURCE_FIELDS = {
    "C.P.": "zip_code",
    "IDEESS": "eess_id",
    "IDCCAA": "ccaa_id",
    "IDMunicipio": "municipality_id",
    "IDProvincia": "province_id",
    "Tipo Venta": "sale_type",
    "Rótulo": "label",
    "Dirección": "address",
    "Municipio": "municipality",
    "Provincia": "province",
    "Localidad": "locality",
    "Latitud": "latitude",
    "Longitud (WGS84)": "longitude",
    "Precio Biodiesel": "biodiesel_price",
    "Precio Bioetanol": "bioethanol_price",
    "Precio Gas Natural Comprimido": "compressed_natural_gas_price",
    "Precio Gas Natural Licuado": "liquefied_natural_gas_price",
    "Precio Gases licuados del petróleo": "liquefied_petroleum_gases_price",
    "Precio Gasoleo A": "diesel_a_price",
    "Precio Gasoleo B": "diesel_b_price",
    "Precio Gasoleo Premium": "diesel_premium_price",
    "Precio Gasolina 95 E10": "gasoline_95_e10_price",
    "Precio Gasolina 95 E5": "gasoline_95_e5_price",
    "Precio Gasolina 95 E5 Premium": "gasoline_95_e5_premium_price",
    "Precio Gasolina 98 E10": "gasoline_98_e10_price",
    "Precio Gasolina 98 E5": "gasoline_98_e5_price",
    "Precio Hidrogeno": "hydrogen_price",
}
SOURCE_TIME_ZONE = "Europe/Madrid"
# ---------------------------------------------------------------------------------------------

PRICE_COLUMNS = [name for name in SOURCE_FIELDS.values() if name.endswith("_price")]
FLOAT_COLUMNS = ["latitude", "longitude", *PRICE_COLUMNS]
SNAPSHOT_COLUMNS = ["timestamp", *SOURCE_FIELDS.values()]

SNAPSHOT_SCHEMA = T.StructType(
    [T.StructField(c, T.DoubleType() if c in FLOAT_COLUMNS else T.StringType()) for c in SNAPSHOT_COLUMNS]
)

# One landed document: every leaf is text; ``Horario`` is published but not kept downstream.
RAW_STATION = T.StructType([T.StructField(f, T.StringType()) for f in [*SOURCE_FIELDS, "Horario"]])
RAW_DOCUMENT_SCHEMA = T.StructType(
    [
        T.StructField("ResultadoConsulta", T.StringType()),
        T.StructField("Fecha", T.StringType()),
        T.StructField("Nota", T.StringType()),
        T.StructField("ListaEESSPrecio", T.ArrayType(RAW_STATION)),
    ]
)

STAT_COLUMNS = ["avg_price", "min_price", "max_price", "station_count"]
ZIP_DAILY_COLUMNS = ["date", "zip_code", "province", "fuel_type", *STAT_COLUMNS]

# ---------------------------------------------------------------------------------------------
# Product groups (first member is the group's primary product) and look-back periods.
FUEL_GROUPS = {
    "diesel": ["diesel_a_price", "diesel_b_price", "diesel_premium_price"],
    "gasoline_95": ["gasoline_95_e5_price", "gasoline_95_e10_price", "gasoline_95_e5_premium_price"],
    "gasoline_98": ["gasoline_98_e5_price", "gasoline_98_e10_price"],
    "biofuel": ["biodiesel_price", "bioethanol_price"],
    "natural_gas": ["compressed_natural_gas_price", "liquefied_natural_gas_price"],
}
PERIOD_DAYS = {"week": 7, "month": 30, "quarter": 90, "half_year": 180, "year": 365}

# Brand clean-up.
BRAND_ALIASES = {
    "cepsa estaciones de servicio": "cepsa",
    "repsol autogas": "repsol",
    "bp oil": "bp",
    "bp oil españa": "bp",
    "shell recharge": "shell",
    "galp energia": "galp",
    "avia operador": "avia",
    "costco wholesale": "costco",
}
# Labels that are station identifiers rather than brands (matched at the start of the label).
NOT_A_BRAND = r"(?i)^(n\.?[ºo°.]?\s*\d|\d{3,}|estacion\s+n|e\.?\s*s\.?\s*\d)"
MIN_BRAND_STATIONS = 10

# Loyalty programmes, (brand key) -> (programme, discount per litre), and label aliases.
LOYALTY_PROGRAMS = {
    "repsol": ("Waylet", 0.03),
    "moeve": ("Club Moeve GOW", 0.05),
    "cepsa": ("Club Moeve GOW", 0.05),
    "galp": ("MundoGalp", 0.10),
    "bp": ("Mi BP", 0.03),
    "shell": ("Shell", 0.05),
}
LOYALTY_ALIASES = {
    "cepsa estaciones de servicio": "cepsa",
    "repsol autogas": "repsol",
    "bp oil": "bp",
    "bp oil españa": "bp",
    "shell recharge": "shell",
    "galp energia": "galp",
}

# Province names in the data -> names on the map, where they differ.
PROVINCE_MAP_NAMES = {
    "coruña (a)": "A Coruña",
    "rioja (la)": "La Rioja",
    "palmas (las)": "Las Palmas",
    "balears (illes)": "Illes Balears",
    "valencia / valència": "València/Valencia",
    "castellón / castelló": "Castelló/Castellón",
    "gipuzkoa": "Gipuzkoa/Guipúzcoa",
    "bizkaia": "Bizkaia/Vizcaya",
    "araba/álava": "Araba/Álava",
    "alicante": "Alacant/Alicante",
}
OFF_MAINLAND = ["palmas (las)", "santa cruz de tenerife", "balears (illes)", "ceuta", "melilla"]

# Report and rule thresholds.
REPORT_BRANDS = ["ballenoil", "repsol", "costco"]
REPORT_FUELS = ["gasoline_95_e5_price", "diesel_a_price"]
REPORT_GEOS = ["zip_code", "locality", "municipality"]
COMPETITIVENESS_BRANDS = ["ballenoil", "repsol"]
MIN_APPEARANCES_WIN_RATE = 30
MIN_APPEARANCES_COMPARISON = 10
CONFIDENCE_HIGH = 384
CONFIDENCE_MEDIUM = 100
ZIP_RETENTION_DAYS = 365
MIN_SNAPSHOT_ROWS = 5000
PRICE_RANGE = (0.5, 3.0)
LATITUDE_RANGE = (27.0, 44.0)
LONGITUDE_RANGE = (-19.0, 5.0)
NATIONAL = "__national__"
# ---------------------------------------------------------------------------------------------
