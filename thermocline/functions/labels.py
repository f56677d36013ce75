"""Named regions, depth bands and flags.  First match wins; a null falls through to the last branch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------------------
# north, south, east, west of each named region
REGIONS = {
    "Indian Ocean": (30.0, -60.0, 120.0, 20.0),
    "Arabian Sea": (25.0, 5.0, 75.0, 50.0),
    "Bay of Bengal": (22.0, 5.0, 95.0, 80.0),
    "Equatorial Indian Ocean": (10.0, -10.0, 100.0, 50.0),
    "Southern Indian Ocean": (-20.0, -60.0, 120.0, 20.0),
}
# regions drawn as outlines on the map
OUTLINED = ("Indian Ocean", "Arabian Sea", "Bay of Bengal", "Equatorial Indian Ocean")
QUALITY_FLAGS = {
    0: "No QC performed",
    1: "Good data",
    2: "Probably good data",
    3: "Bad data that are potentially correctable",
    4: "Bad data",
    5: "Value changed",
    6: "Not used",
    7: "Not used",
    8: "Interpolated value",
    9: "Missing value",
}
DEPTH_BANDS = ((100.0, "Surface (0-100m)"), (500.0, "Intermediate (100-500m)"), (1000.0, "Deep (500-1000m)"))
DEEPEST_BAND = "Very Deep (>1000m)"
OCEAN_ZONES = ((200.0, "Euphotic Zone"), (1000.0, "Mesopelagic Zone"))
DEEPEST_ZONE = "Bathypelagic Zone"
INDIAN = ((20, 120), (-70, 30))  # longitudes, latitudes; tested first
PACIFIC, ATLANTIC = ((-180, -70), (120, 180)), (-70, 20)  # longitudes
QUALITY_LEVELS = ((0.95, "Excellent"), (0.85, "Good"), (0.70, "Fair"), (0.50, "Poor"))
# ----------------------------------------------------------------------------------------------------------


def basin(lat: Column, lon: Column) -> Column:
    """Four-way ocean label; the Indian box is tested before the Pacific and Atlantic strips."""
    return (
        F.when(lon.between(*INDIAN[0]) & lat.between(*INDIAN[1]), "Indian Ocean")
        .when(lon.between(*PACIFIC[0]) | lon.between(*PACIFIC[1]), "Pacific Ocean")
        .when(lon.between(*ATLANTIC), "Atlantic Ocean")
        .otherwise("Other")
    )


def _ladder(value: Column, steps, last: str) -> Column:
    chain = F
    for bound, label in steps:
        chain = chain.when(value < bound, label)
    return chain.otherwise(last)


def depth_band(depth: Column) -> Column:
    return _ladder(depth, DEPTH_BANDS, DEEPEST_BAND)


def ocean_zone(depth: Column) -> Column:
    return _ladder(depth, OCEAN_ZONES, DEEPEST_ZONE)


def quality_level(share: Column) -> Column:
    """Excellent / Good / Fair / Poor by share 0..1; anything lower, or null, is Unknown."""
    chain = F
    for bound, label in QUALITY_LEVELS:
        chain = chain.when(share >= bound, label)
    return chain.otherwise("Unknown")


def region_table(spark: SparkSession) -> DataFrame:
    """The region boxes as a five-row table."""
    return spark.createDataFrame(
        [(name, *box) for name, box in REGIONS.items()],
        "region string, north double, south double, east double, west double",
    )


def flag_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(QUALITY_FLAGS.items()), "quality_flag int, flag_label string")
