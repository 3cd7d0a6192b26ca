"""Points and distances. Distances are those on the WGS 84 ellipsoid, by Lambert's formula: within a few centimetres over the
reach of a city."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ellipsoid's equatorial radius and flattening; metres of a mile.
EARTH_M, FLAT = 6_378_137.0, 1 / 298.257223563
MILE_M = 1609.34
#: Metres of a degree of latitude, at the least.
DEGREE_M = 110_500.0
#: Width of a cell in degrees; a whole number of cells goes round the earth.
CELL_DEG = 0.02


def point_wkt(lat: Column, lon: Column) -> Column:
    return F.when(lat.isNotNull() & lon.isNotNull(), F.format_string("POINT(%s %s)", lon.cast("string"), lat.cast("string")))


def read_wkt(wkt: Column) -> tuple[Column, Column]:
    """lat, lon of ``POINT(lon lat)``; nulls for anything else."""
    p = r"^\s*POINT\s*\(\s*(-?[\d.]+)\s+(-?[\d.]+)\s*\)\s*$"
    return F.nullif(F.regexp_extract(wkt, p, 2), F.lit("")).try_cast("double"), F.nullif(F.regexp_extract(wkt, p, 1), F.lit("")).try_cast("double")


def read_ewkb(hexes: Column) -> tuple[Column, Column]:
    """lat, lon of a two-dimensional EWKB point with an SRID, in hexadecimal: a byte for the order of bytes (1: little
    endian), four of type, four of SRID, x and y as doubles. Nulls for anything shorter or not hexadecimal."""
    h = F.upper(F.trim(hexes))
    good = h.rlike("^[0-9A-F]*$") & (F.length(h) >= 50) & (F.length(h) % 2 == 0)

    def number(at: int) -> Column:
        raw = F.substring(h, at, 16)
        pairs = F.transform(F.sequence(F.lit(1), F.lit(15), F.lit(2)), lambda i: raw.substr(i, F.lit(2)))
        bits = F.when(F.substring(h, 1, 2) == "01", F.array_join(F.reverse(pairs), "")).otherwise(raw)
        high, low = (F.conv(F.substring(bits, k, 8), 16, 10).cast("long") for k in (1, 9))
        exponent, negative = F.shiftright(high, 20).bitwiseAND(F.lit(2047)), high >= (1 << 31)
        fraction = (high.bitwiseAND(F.lit((1 << 20) - 1)).cast("double") * F.lit(2.0**32) + low.cast("double")) / F.lit(2.0**52)
        size = F.when(exponent == 0, fraction * F.lit(2.0**-1022)).otherwise((1 + fraction) * F.pow(F.lit(2.0), (exponent - 1023).cast("double")))
        return F.when(good & (exponent < 2047), F.when(negative, -size).otherwise(size))

    return number(35), number(19)


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    b1, b2 = (F.atan(F.lit(1 - FLAT) * F.tan(F.radians(x))) for x in (lat1, lat2))
    h = F.pow(F.sin((b2 - b1) / 2), 2) + F.cos(b1) * F.cos(b2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    h = F.least(h, F.lit(1.0))
    angle = F.lit(2.0) * F.asin(F.sqrt(h))
    p, q = (b1 + b2) / 2, (b2 - b1) / 2
    x = (angle - F.sin(angle)) * F.pow(F.sin(p) * F.cos(q), 2) / (1 - h)
    y = (angle + F.sin(angle)) * F.pow(F.cos(p) * F.sin(q), 2) / h
    return F.when(h == 0, F.lit(0.0)).otherwise(F.lit(EARTH_M) * (angle - F.lit(FLAT / 2) * (x + y)))


def miles(metres: Column) -> Column:
    return F.bround(metres / MILE_M, 2)


def in_box(lat: Column, lon: Column, lat0: float, lon0: float, radius_m: float) -> Column:
    """A box that holds the circle: plain comparisons that reach the scan."""
    d_lat = radius_m / DEGREE_M
    box = (lat >= lat0 - d_lat) & (lat <= lat0 + d_lat)
    if abs(lat0) + d_lat >= 89.9:
        return box
    d_lon = d_lat / math.cos(math.radians(abs(lat0) + d_lat))
    # over the line where longitudes jump, the box has two parts
    return box & F.greatest(*[(lon >= lon0 + k - d_lon) & (lon <= lon0 + k + d_lon) for k in ((0, 360) if lon0 - d_lon < -180 else (0, -360) if lon0 + d_lon > 180 else (0, 0))])


def cell(lat: Column, lon: Column, size: float = CELL_DEG) -> Column:
    return F.struct(F.floor(lat / size).alias("y"), F.pmod(F.floor(lon / size), F.lit(round(360 / size))).alias("x"))


def cells_within(lat: Column, lon: Column, radius_m: float, size: float = CELL_DEG) -> Column:
    """The cells that a circle around a point reaches, at any latitude."""
    d_lat = radius_m / DEGREE_M
    d_lon = F.least(F.lit(d_lat) / F.cos(F.radians(F.least(F.abs(lat) + d_lat, F.lit(89.9)))), F.lit(180.0 - size))
    ys = F.sequence(F.floor((lat - d_lat) / size), F.floor((lat + d_lat) / size))
    xs = F.sequence(F.floor((lon - d_lon) / size), F.floor((lon + d_lon) / size))
    return F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(y.alias("y"), F.pmod(x, F.lit(round(360 / size))).alias("x")))))
