"""Exports: CSV, JSON, fixed-width text, Parquet with units, and a package of all of it.

Every export is a distributed write; nothing passes through the driver.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from ..functions.columns import fixed_text
from ..operators.quality import quality_report

# --- fixed values -----------------------------------------------------------------------------------------
CSV_COLUMNS = ("time", "lat", "lon", "depth", "temperature", "salinity")
ESSENTIAL = ("id", "float_id", "time", "lat", "lon", "depth", "temperature", "salinity")
MISSING = "     NaN"
ATTRIBUTES = {
    "temperature": {
        "long_name": "Sea Water Temperature", "standard_name": "sea_water_temperature", "units": "degree_Celsius",
        "valid_min": -2.0, "valid_max": 40.0,
    },
    "salinity": {
        "long_name": "Sea Water Practical Salinity", "standard_name": "sea_water_practical_salinity", "units": "psu",
        "valid_min": 0.0, "valid_max": 50.0,
    },
}
# comment lines of the text export
ASCII_HEADER = (
    "# ARGO Float Data Export",
    "# Generated: {time} UTC",
    "# Number of profiles: {count}",
    "# Format: DATE TIME LAT LON DEPTH TEMP SALINITY",
    "# Units: YYYY-MM-DD HH:MM:SS degrees degrees meters celsius psu",
    "#" + "=" * 70,
)
# ----------------------------------------------------------------------------------------------------------


def export_rows(m: DataFrame, ids: DataFrame | None = None, tie_key: str = "id") -> DataFrame:
    """The six exported columns of the listed measurements in time and depth order."""
    rows = m if ids is None else m.join(ids.select("id").distinct(), "id", "left_semi")
    return rows.orderBy("time", "depth", tie_key).select(*CSV_COLUMNS)


def export_selection(df: DataFrame) -> DataFrame:
    """Wide tables are cut to the essential columns."""
    return df.select(*(c for c in ESSENTIAL if c in df.columns)) if len(df.columns) > 10 else df


def ascii_line() -> Column:
    """One fixed-width data line."""
    def number(c: str, digits: int) -> Column:
        return F.coalesce(fixed_text(F.col(c), digits, 8), F.lit(MISSING))

    return F.concat_ws(
        " ", F.date_format("time", "yyyy-MM-dd HH:mm:ss"), number("lat", 3), number("lon", 3), number("depth", 1),
        number("temperature", 3), number("salinity", 3),
    )


def ascii_header(count: int, as_of: dt.datetime) -> list[str]:
    return [line.format(count=count, time=f"{as_of:%Y-%m-%d %H:%M:%S}") for line in ASCII_HEADER]


def export_ascii(m: DataFrame, as_of: dt.datetime, ids: DataFrame | None = None, tie_key: str = "id") -> DataFrame:
    """All lines of the text export in order: six comment lines, then the data.

    Lines are written out after the sort, so the sort moves numbers instead of text.
    """
    rows = m if ids is None else m.join(ids.select("id").distinct(), "id", "left_semi")
    rows = rows.select(tie_key, *CSV_COLUMNS)
    count = (ids if ids is not None else rows).count()
    header = ascii_header(count, as_of)
    head = m.sparkSession.createDataFrame(list(enumerate(header)), "line int, comment string")
    for field in rows.schema.fields:
        head = head.withColumn(field.name, F.lit(None).cast(field.dataType))
    both = head.unionByName(rows.withColumn("line", F.lit(len(header))), allowMissingColumns=True)
    ordered = both.orderBy("line", "time", "depth", tie_key)
    return ordered.select(F.when(F.col("line") < len(header), F.col("comment")).otherwise(ascii_line()).alias("value"))


def write_csv(df: DataFrame, path: str, compression: str = "none") -> None:
    df.write.mode("overwrite").option("header", True).option("compression", compression).csv(path)


def write_json(df: DataFrame, path: str, compression: str = "none") -> None:
    df.write.mode("overwrite").option("compression", compression).json(path)


def write_ascii(lines: DataFrame, path: str, compression: str = "none") -> None:
    lines.select("value").write.mode("overwrite").option("compression", compression).text(path)


def json_records(df: DataFrame) -> DataFrame:
    """One JSON text per row."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))


def with_attributes(df: DataFrame) -> DataFrame:
    """Long name, units and valid range attached to the columns they describe."""
    for name, attributes in ATTRIBUTES.items():
        if name in df.columns:
            df = df.withMetadata(name, attributes)
    return df


def export_columnar(m: DataFrame, path: str, compression: str = "zstd") -> None:
    """Parquet whose schema carries the attributes."""
    columns = [c for c in ("temperature", "salinity", "lat", "lon", "depth", "time") if c in m.columns]
    rows = m.select(*columns).withColumnsRenamed({"lat": "latitude", "lon": "longitude"})
    with_attributes(rows).write.mode("overwrite").option("compression", compression).parquet(path)


def export_metadata(df: DataFrame, kind: str, fmt: str, as_of: dt.datetime, **details) -> DataFrame:
    """One JSON row about an export."""
    record = {
        "export_type": kind, "export_timestamp": as_of.isoformat(), "data_source": "ARGO Float Network",
        "export_details": {"format": fmt, "record_count": df.count(), "columns": df.columns, **details},
    }
    return df.sparkSession.createDataFrame([(json.dumps(record),)], "value string")


def export_package(raw: DataFrame, filtered: DataFrame, folder: str, as_of: dt.datetime) -> None:
    """Raw and filtered rows, metadata and quality report below one folder."""
    write_csv(raw, f"{folder}/data/raw_data")
    write_csv(filtered, f"{folder}/data/filtered_data")
    write_csv(quality_report(filtered), f"{folder}/reports/quality_report")
    export_metadata(filtered, "package", "CSV", as_of).write.mode("overwrite").text(f"{folder}/metadata")


def chat_history(log: DataFrame) -> DataFrame:
    """Chat rows as JSON texts."""
    return json_records(log.select("timestamp", "type", "role", "content"))


def report_text(report: DataFrame) -> DataFrame:
    """Report rows as lines of text."""
    percent = F.col("measure").endswith("percentage")
    shown = F.when(percent, F.format_string("%.1f%%", "value")).otherwise(F.format_string("%.2f", "value"))
    return report.select(F.concat_ws(" ", F.lit("-"), F.concat("name", F.lit(":")), "measure", shown).alias("value"))


