"""Small column helpers: lenient casts, formatting, bins."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: unit text per parameter ---------------------------------------------------------------
UNITS = {
    "temperature": "°C",
    "salinity": "PSU",
    "depth": "m",
    "pressure": "dbar",
    "oxygen": "ml/L",
    "ph": "",
    "chlorophyll": "mg/m³",
    "nitrate": "μmol/kg",
}
# ----------------------------------------------------------------------------------------------------------


def n_rows() -> Column:
    return F.count(F.lit(1))


def nan_to_null(value: Column) -> Column:
    """Spark sorts NaN above every number and lets it poison averages; a missing value is null here."""
    return F.when(~F.isnan(value), value)


def safe_float(value: Column) -> Column:
    """Number or null, never an error."""
    return nan_to_null(value.try_cast("double"))


def safe_timestamp(value: Column) -> Column:
    return value.try_cast("timestamp_ntz")


def fixed_text(value: Column, digits: int, width: int = 0) -> Column:
    """``%.<digits>f`` as C and Python print it, padded on the left to ``width``.

    Java rounds the shortest decimal text of a double half up; C and Python round its exact binary value.  The two
    differ near a tie, where the sign of the exact distance to the tie decides: the number is split into two halves
    whose products are exact.  The text is put together from integers, which is also several times faster than the
    built-in formatter; that one is left for numbers of sixteen digits and more.
    """
    scale = float(10**digits)
    size = F.abs(F.coalesce(value, F.lit(0.0)))
    product = F.least(size * scale, F.lit(4e15))
    odd = F.rint(product - 0.5) * 2.0 + 1.0
    big = size * 134217729.0
    high = big - (big - size)
    apart = F.signum(high * (2.0 * scale) - odd + (size - high) * (2.0 * scale))
    tie = F.abs(product * 2.0 - odd) < 1e-6 + product * 1e-15
    units = F.when(tie, F.rint((odd + apart * 0.5) / 2.0)).otherwise(F.rint(product)).cast("bigint")
    small = size * scale < 4e15
    sign = F.when(small & (value < 0), "-").when(small & (value >= 0), "")
    if digits:
        parts = [F.floor(units / int(scale)).cast("string"), F.lit("."),
                 F.lpad((units % int(scale)).cast("string"), digits, "0")]
    else:
        parts = [units.cast("string")]
    slow = F.when(value.isNotNull(), F.format_string(f"%.{digits}f", value))
    text = F.coalesce(F.concat(sign, *parts), slow)
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), " ") if width else text


def scientific(value: Column, digits: int = 2) -> Column:
    """``%.2e`` below 0.01 and from 1000 up in magnitude, ``%.2f`` between, ``N/A`` for null."""
    far = (F.abs(value) < 0.01) | (F.abs(value) >= 1000)
    return (
        F.when(value.isNull(), "N/A")
        .when(far, F.format_string(f"%.{digits}e", value))
        .otherwise(fixed_text(value, digits))
    )


def with_unit(value: Column, parameter: str) -> Column:
    """Value and unit; pH carries no unit, depth and pressure no decimals."""
    name = parameter.lower()
    unit = UNITS.get(name, "")
    if name == "ph":
        text = fixed_text(value, 2)
    elif name in ("depth", "pressure"):
        text = F.concat(fixed_text(value, 0), F.lit(f" {unit}"))
    else:
        text = F.concat(fixed_text(value, 2), F.lit(f" {unit}"))
    return F.when(value.isNull(), "N/A").otherwise(text)


def safe_divide(top: Column, bottom: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(default))


def truncated(text: Column, length: int = 100) -> Column:
    """At most ``length`` characters, the last three being dots when something was cut."""
    cut = F.concat(F.substring(text, 1, length - 3), F.lit("..."))
    return F.when(F.length(text) > length, cut).otherwise(text)


def utc_text(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))


def compact(value: Column, digits: int = 6) -> Column:
    return F.round(value, digits)


def month_of(ts: Column) -> Column:
    return F.date_trunc("month", ts).cast("timestamp_ntz")


def right_closed_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin 0..bins-1, closed on the right; the minimum itself belongs to bin 0."""
    step = (high - low) / F.lit(float(bins))
    number = F.ceil(F.try_divide(value - low, step)).cast("int") - 1
    return F.when(value.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.coalesce(number, F.lit(0)))))


def left_closed_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin 0..bins-1, closed on the left, clipped at both ends."""
    step = (high - low) / F.lit(float(bins))
    number = F.floor(F.try_divide(value - low, step)).cast("int")
    return F.when(value.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.coalesce(number, F.lit(0)))))


def seconds(ts: Column) -> Column:
    """A zone-less timestamp as seconds since 1970, whatever the session zone."""
    day = F.unix_date(F.to_date(ts)).cast("double") * 86400
    return day + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.date_part(F.lit("SECOND"), ts).cast("double")


def micros(time: Column) -> Column:
    """A time with or without zone as microseconds."""
    return F.unix_micros(time.cast("timestamp"))


def packed_order(first: Column, second: Column) -> Column:
    """Two whole numbers as a decimal that sorts like the pair, nulls first: a key of fixed width, over which aggregates
    hash instead of sorting.

    ``first`` has up to 18 digits, which covers microseconds of all dates; ``second`` is any bigint.
    """
    high = F.coalesce(first, F.lit(-10 ** 18)).cast("decimal(19,0)") * F.lit(Decimal(2 * 10 ** 19)).cast("decimal(20,0)")
    low = F.coalesce(second, F.lit(-(1 << 63))).cast("decimal(20,0)") + F.lit(Decimal(1 << 63)).cast("decimal(20,0)")
    return (high.cast("decimal(38,0)") + low).cast("decimal(38,0)")
