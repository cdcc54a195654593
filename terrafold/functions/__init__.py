"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decimal_comma(c: Column) -> Column:
    """Text with a decimal comma, with a point."""
    return F.translate(c, ",", ".")


def reading_time(data: Column, hora: Column) -> Column:
    """Timestamp from a day (`/` or `-`) and an hour (`HH:MM`, or `HHMM` with anything after it); null if unreadable."""
    digits = F.replace(hora, F.lit(":"), F.lit(""))
    text = F.concat(F.replace(data, F.lit("/"), F.lit("-")), F.lit(" "), F.substring(digits, 1, 2), F.lit(":"), F.substring(digits, 3, 2))
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz")


def days_in_month(d: Column) -> Column:
    return F.day(F.last_day(d))


def season(month: Column) -> Column:
    """Season of a two-digit month."""
    # Fixed values.
    names = (("01_summer", 1), ("02_autumn", 4), ("03_winter", 7), ("04_spring", 10))
    out = F.lit("others")
    for name, first in names:
        out = F.when(month.isin(*[f"{m:02d}" for m in range(first, first + 3)]), name).otherwise(out)
    return out


def rain_class(obs: Column, est: Column, wet: float = 0.0, thr: float = 0.2) -> Column:
    """n11, n01, n10 or n00 of an observed and an estimated value; `others` for est equal to thr, obs under wet and nulls.
    The names and the defaults of wet and thr are fixed values."""
    hit, dry, high, low = obs > wet, obs == wet, est > thr, est < thr
    return F.when(hit & high, "n11").when(dry & high, "n01").when(hit & low, "n10").when(dry & low, "n00").otherwise("others")


def pixel_center(row: Column, col: Column, x0, sx, y0, sy) -> tuple[Column, Column]:
    """World x and y of the centre of a pixel."""
    return x0 + (col + 0.5) * sx, y0 + (row + 0.5) * sy


def world_to_pixel(x: Column, y: Column, x0, sx, rx, y0, ry, sy) -> tuple[Column, Column]:
    """Row and column of a point by the inverse geotransform, truncated toward zero; null where it has no inverse.
    Points up to a pixel left of or above the raster truncate to 0, so test the extent first."""
    det = sx * sy - rx * ry
    col = F.try_divide((x - x0) * sy - (y - y0) * rx, det)
    row = F.try_divide((y - y0) * sx - (x - x0) * ry, det)
    return row.cast("int"), col.cast("int")


def raster_extent(x0, sx, y0, sy, width, height, rx=None, ry=None) -> tuple[Column, Column, Column, Column]:
    """minx, maxx, miny, maxy of a raster; rx and ry are its rotation terms, none by default."""
    if rx is None or ry is None:
        x1, y1 = x0 + sx * width, y0 + sy * height
        return F.least(x0, x1), F.greatest(x0, x1), F.least(y0, y1), F.greatest(y0, y1)
    xs = [x0, x0 + sx * width, x0 + rx * height, x0 + sx * width + rx * height]
    ys = [y0, y0 + ry * width, y0 + sy * height, y0 + ry * width + sy * height]
    return F.least(*xs), F.greatest(*xs), F.least(*ys), F.greatest(*ys)


def inside(x: Column, y: Column, minx, maxx, miny, maxy, inclusive: bool = True) -> Column:
    if inclusive:
        return (x >= minx) & (x <= maxx) & (y >= miny) & (y <= maxy)
    return (x > minx) & (x < maxx) & (y > miny) & (y < maxy)


def floor_mod(a: Column, n) -> Column:
    """The remainder with the sign of n (pmod has the wrong one for a negative n)."""
    return a - n * F.floor(a / n)


#: The parts of granule names that don't tell the time. Fixed values.
HALF_HOURLY, MONTHLY, GRANULE, VERSION = "3B-HHR-L", "3B-MO-GIS", "MS.MRG.3IMERG", "V06B"


def granule_start(name: Column) -> Column:
    """Start of a granule from its name."""
    return F.try_to_timestamp(F.regexp_extract(name, r"\.(\d{8}-S\d{6})-", 1), F.lit("yyyyMMdd-'S'HHmmss")).cast("timestamp_ntz")


def granule_name(start: Column, product: str = HALF_HOURLY, version: str = VERSION) -> Column:
    """Name of the half-hourly granule of a product and version that starts at start."""
    end = start + F.expr("interval 1799 seconds")
    minute = F.lpad((F.hour(start) * 60 + F.minute(start)).cast("string"), 4, "0")
    return F.concat(
        F.lit(f"{product}.{GRANULE}."), F.date_format(start, "yyyyMMdd"), F.lit("-S"), F.date_format(start, "HHmmss"), F.lit("-E"), F.date_format(end, "HHmmss"),
        F.lit("."), minute, F.lit(f".{version}.30min"),
    )


def month_granule_name(year: Column, month: Column, product: str = MONTHLY, version: str = VERSION) -> Column:
    """File name of the monthly raster of a year and a month, both numbers."""
    mm = F.lpad(month.cast("string"), 2, "0")
    return F.concat(F.lit(f"{product}.{GRANULE}."), F.lpad(year.cast("string"), 4, "0"), mm, F.lit("01-S000000-E235959."), mm, F.lit(f".{version}.total.accum.tif"))


def granule_month(name: Column) -> tuple[Column, Column]:
    """Year and two-digit month as text from the name of a raster, monthly or half-hourly; null where there is no date."""
    day = F.regexp_extract(name, r"\.(\d{4})(\d{2})\d{2}-S", 0)
    known = day != ""
    return F.when(known, F.substring(day, 2, 4)), F.when(known, F.substring(day, 6, 2))
