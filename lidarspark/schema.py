"""Schemas and fixed tables of the point-cloud model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

POINTS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("easting", T.DoubleType(), False),
        T.StructField("northing", T.DoubleType(), False),
        T.StructField("altitude", T.DoubleType()),
        T.StructField("zone_id", T.IntegerType()),
        T.StructField("class_code", T.IntegerType()),
    ]
)
METRICS = ("normal_x", "normal_y", "normal_z", "slope", "rough", "curvature", "trav_score")
PROCESSED = T.StructType([*POINTS.fields, *(T.StructField(m, T.DoubleType()) for m in METRICS)])
ZONES = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("label", T.StringType())])
CLASSES = T.StructType([T.StructField("code", T.IntegerType()), T.StructField("label", T.StringType())])

_PAIR = T.ArrayType(T.ArrayType(T.DoubleType()))
ANTENNA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("name", "model", "type", "notes")]
    + [T.StructField(n, T.DoubleType()) for n in ("gain_db", "hp_bw_deg", "vp_bw_deg", "fwd_back_db", "freq_hz_min", "freq_hz_max", "sidelobe_db")]
    + [T.StructField("hard_null", T.BooleanType()), T.StructField("azimuth_pattern", _PAIR), T.StructField("elevation_pattern", _PAIR)]
)

# Labels of the standard LAS classification codes.
CLASS_LABELS = {
    0: "Never Classified",
    1: "Unclassified",
    2: "Ground",
    3: "Low Vegetation",
    4: "Medium Vegetation",
    5: "High Vegetation",
    6: "Building",
    7: "Low Point Noise",
    8: "Reserved",
    9: "Water",
    10: "Rail",
    11: "Road Surface",
    12: "Reserved",
    13: "Wire Guard Shield",
    14: "Wire Conductor Phase",
    15: "Transmission Tower",
    16: "Wire Structure Connector",
    17: "Bridge Deck",
    18: "High Noise",
    19: "Overhead Structure",
    20: "Ignored Ground",
    21: "Snow",
    22: "Temporal Exclusion",
    23: "Reserved",
}

# The three built-in antennas, patterns as [angle in degrees, gain in dB].
ANTENNAS = [
    {
        "name": "AMY-9M16",
        "model": "airMAX Yagi AMY-9M16",
        "type": "yagi",
        "notes": "Derived defaults & sample patterns from uploaded AMY-9M16 datasheet.",
        "gain_db": 16.0,
        "hp_bw_deg": 31.5,
        "vp_bw_deg": 31.5,
        "fwd_back_db": 20.0,
        "freq_hz_min": 902e6,
        "freq_hz_max": 928e6,
        "sidelobe_db": -20.0,
        "hard_null": False,
        "azimuth_pattern": [[0.0, 16.0], [5.0, 15.5], [10.0, 14.0], [15.0, 13.0], [20.0, 10.0], [30.0, 6.0], [60.0, -4.0], [120.0, -5.0], [180.0, -4.0], [240.0, -5.0], [300.0, -4.0], [330.0, 10.0]],
        "elevation_pattern": [[-30.0, -18.0], [-10.0, -3.0], [0.0, 0.0], [10.0, -3.0], [30.0, -12.0]],
    },
    {
        "name": "AM-2G16-90",
        "model": "AM-2G16-90 Sector (2.3-2.7 GHz)",
        "type": "sector",
        "notes": "Approximated azimuth & elevation patterns digitized from datasheet polar plots. HPOL ~91° (6 dB).",
        "gain_db": 16.0,
        "hp_bw_deg": 91.0,
        "vp_bw_deg": 90.0,
        "fwd_back_db": 20.0,
        "freq_hz_min": 2.3e9,
        "freq_hz_max": 2.7e9,
        "sidelobe_db": -18.0,
        "hard_null": False,
        "azimuth_pattern": [[0.0, 16.0], [10.0, 15.0], [20.0, 13.0], [30.0, 10.0], [40.0, 6.0], [45.5, 4.0], [60.0, -2.0], [90.0, -12.0], [120.0, -18.0], [150.0, -20.0], [180.0, -20.0], [210.0, -20.0], [240.0, -18.0], [270.0, -12.0], [300.0, -2.0], [319.0, 6.0], [330.0, 10.0], [340.0, 13.0]],
        "elevation_pattern": [[-30.0, -18.0], [-10.0, -4.0], [0.0, 0.0], [5.0, -1.0], [10.0, -3.0], [20.0, -9.0], [30.0, -16.0]],
    },
    {
        "name": "AM-5G20-90",
        "model": "AM-5G20-90 Sector (5.15-5.85 GHz)",
        "type": "sector",
        "notes": "Approximate azimuth & elevation patterns digitized from datasheet polar plots. HPOL ~91° (6 dB). Gain ~19.5-20.3 dBi range.",
        "gain_db": 20.0,
        "hp_bw_deg": 91.0,
        "vp_bw_deg": 85.0,
        "fwd_back_db": 28.0,
        "freq_hz_min": 5.15e9,
        "freq_hz_max": 5.85e9,
        "sidelobe_db": -18.0,
        "hard_null": False,
        "azimuth_pattern": [[0.0, 20.0], [6.0, 19.2], [12.0, 17.8], [20.0, 15.0], [30.0, 10.0], [40.0, 3.0], [45.5, 0.0], [60.0, -6.0], [90.0, -12.0], [120.0, -18.0], [150.0, -20.0], [180.0, -20.0], [210.0, -20.0], [240.0, -18.0], [270.0, -12.0], [300.0, -6.0], [319.0, 3.0], [330.0, 10.0], [340.0, 15.0]],
        "elevation_pattern": [[-30.0, -18.0], [-10.0, -5.0], [0.0, 0.0], [5.0, -1.5], [10.0, -4.0], [20.0, -10.0], [30.0, -18.0]],
    },
]


def classifications(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CLASS_LABELS.items()), CLASSES)


def default_antennas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(a[f.name] for f in ANTENNA.fields) for a in ANTENNAS], ANTENNA)
