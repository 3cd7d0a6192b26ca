"""Events laid out along a space-filling curve, so that a radius reads few row groups.

A point's ``place`` is its Morton key: the bits of its cell's column and row, in turns. Cells of a quadtree are ranges of keys,
so that a circle's box becomes a few ranges. A table sorted by place keeps neighbours in the same files and row groups,
whose least and greatest keys tell a scan which of them to skip.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo

#: Bits of a column and of a row: cells of about 40 by 20 metres.
BITS = 20
#: Ranges into which a circle's box is put, at the most.
RANGES = 32
#: (how far a half of the bits is moved, the bits that stay) to put a gap between any two of 32 bits; from the definition.
SPREADS = [(k, sum(((1 << k) - 1) << (2 * k * i) for i in range(32 // k))) for k in (16, 8, 4, 2, 1)]


def _spread(c: Column) -> Column:
    for k, mask in SPREADS:
        c = c.bitwiseOR(F.shiftleft(c, k)).bitwiseAND(F.lit(mask))
    return c


def _along(degrees: Column, low: float, width: float) -> Column:
    at = F.floor((degrees - low) / width * (1 << BITS)).cast("long")
    return F.when(degrees.isNotNull(), F.least(F.greatest(at, F.lit(0)), F.lit((1 << BITS) - 1)))


def place(lat: Column, lon: Column) -> Column:
    """The Morton key of a point; null without one."""
    return _spread(_along(lon, -180.0, 360.0)).bitwiseOR(F.shiftleft(_spread(_along(lat, -90.0, 180.0)), 1))


def by_place(events: DataFrame) -> DataFrame:
    """events(lat, lon, …) with place, in its order over all partitions."""
    return events.withColumn("place", place(F.col("lat"), F.col("lon"))).repartitionByRange("place").sortWithinPartitions("place")


def ranges_within(lat: float, lon: float, radius_m: float, most: int = RANGES) -> list[tuple[int, int]]:
    """Ranges of keys, both ends included, that hold every point of a circle."""
    top = 1 << BITS
    cell = lambda x, low, width: min(max(math.floor((x - low) / width * top), 0), top - 1)
    # a little more than the box, for points that rounding puts into the next cell
    d_lat = radius_m / geo.DEGREE_M * 1.0001
    rows = cell(lat - d_lat, -90, 180), cell(lat + d_lat, -90, 180)
    if abs(lat) + d_lat >= 89.9:
        columns = [(0, top - 1)]
    else:
        d_lon = d_lat / math.cos(math.radians(abs(lat) + d_lat))
        west, east = lon - d_lon, lon + d_lon
        parts = [(-180, 180)] if d_lon >= 180 else [(west, 180), (-180, east - 360)] if east > 180 else [(west + 360, 180), (-180, east)] if west < -180 else [(west, east)]
        columns = [(cell(a, -180, 360), cell(b, -180, 360)) for a, b in parts]

    def meets(x: int, y: int, side: int) -> int:
        """0: outside, 1: in part, 2: inside."""
        if y > rows[1] or y + side - 1 < rows[0]:
            return 0
        over = [c for c in columns if x <= c[1] and x + side - 1 >= c[0]]
        if not over:
            return 0
        return 2 if y >= rows[0] and y + side - 1 <= rows[1] and any(x >= a and x + side - 1 <= b for a, b in over) else 1

    # cells as (key of the first point, column, row, side), those in part inside split as long as ranges are few
    done: list[tuple[int, int]] = []
    cells, side = [(0, 0, 0)], top
    while side > 1 and cells:
        half, inside, split = side // 2, list(done), []
        for key, x, y in cells:
            for k in range(4):
                at, cx, cy = key + k * half * half, x + half * (k & 1), y + half * (k >> 1)
                kind = meets(cx, cy, half)
                if kind == 2:
                    inside.append((at, at + half * half - 1))
                elif kind:
                    split.append((at, cx, cy))
        if len(_merged(inside + [(c[0], c[0] + half * half - 1) for c in split])) > most:
            break
        done, cells, side = inside, split, half
    return _merged(done + [(c[0], c[0] + side * side - 1) for c in cells])


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, neighbours joined."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def near(events: DataFrame, lat: float, lon: float, radius_m: float) -> DataFrame:
    """Of events with place, those in the ranges around a point: a filter that reaches the scan; distances are still to be
    compared."""
    within = None
    for low, high in ranges_within(lat, lon, radius_m):
        one = F.col("place").between(low, high)
        within = one if within is None else within | one
    return events.where(within)
