"""Geohash cells and distances as column expressions."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, let

# Sphere radius in metres, latitude limit of the cells, units in metres, base 32 letters.
RADIUS_M = 6372797.560856
LAT_LIMIT = 85.05112878
UNITS = {"m": 1.0, "km": 1000.0, "ft": 0.3048, "mi": 1609.34}
SEARCH_UNITS = UNITS | {"mi": 1609.344}
LETTERS = "0123456789bcdefghjkmnpqrstuvwxyz"
STEP = 26


def _cell(x: Column, low: float, high: float) -> Column:
    return F.floor((x - low) / (high - low) * (1 << STEP)).cast("bigint")


def _step(shift, mask: int):
    return lambda y: y.bitwiseOR(shift(y)).bitwiseAND(F.lit(mask))


def _spread(x: Column) -> Column:
    """Bits of a 32-bit number moved to the even places."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = let(x, _step(partial(F.shiftleft, numBits=shift), mask))
    return x


def _gather(x: Column) -> Column:
    x = x.bitwiseAND(F.lit(0x5555555555555555))
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        x = let(x, _step(partial(F.shiftright, numBits=shift), mask))
    return x


def encode(lon, lat, lat_limit: float = LAT_LIMIT) -> Column:
    """52-bit interleaved cell number; longitude has the odd bits."""
    x, y = _cell(col(lon), -180.0, 180.0), _cell(col(lat), -lat_limit, lat_limit)
    return F.shiftleft(_spread(x), 1).bitwiseOR(_spread(y))


def decode(cell) -> tuple[Column, Column]:
    """Longitude and latitude of the cell's centre."""
    c = col(cell).cast("bigint")
    x, y = _gather(F.shiftright(c, 1)), _gather(c)
    unit = 1.0 / (1 << STEP)
    return (x + 0.5) * (360.0 * unit) - 180.0, (y + 0.5) * (2 * LAT_LIMIT * unit) - LAT_LIMIT


def geohash(cell) -> Column:
    """11 letters; the cell is encoded again over the whole latitude range, and the last letter is always 0."""
    lon, lat = decode(cell)
    letter = lambda bits, i: F.substring(F.lit(LETTERS), F.shiftright(bits, 52 - 5 * (i + 1)).bitwiseAND(31).cast("int") + 1, F.lit(1))
    return let(encode(lon, lat, 90.0), lambda bits: F.concat(*[letter(bits, i) for i in range(10)], F.lit("0")))


def distance_m(lon1, lat1, lon2, lat2) -> Column:
    """Haversine distance in metres."""
    lon1, lat1, lon2, lat2 = (F.radians(col(c)) for c in (lon1, lat1, lon2, lat2))
    u, v = F.sin((lat2 - lat1) / 2), F.sin((lon2 - lon1) / 2)
    return 2.0 * RADIUS_M * F.asin(F.sqrt(u * u + F.cos(lat1) * F.cos(lat2) * v * v))


def in_radius(lon, lat, lon0: float, lat0: float, radius: float, unit: str = "m") -> Column:
    return distance_m(lon, lat, F.lit(lon0), F.lit(lat0)) <= radius * UNITS[unit]


def in_box(lon, lat, lon0: float, lat0: float, width: float, height: float, unit: str = "m") -> Column:
    """Latitude distance against half the height, longitude distance at the point's latitude against half the width."""
    lon, lat = col(lon), col(lat)
    up = distance_m(F.lit(lon0), lat, F.lit(lon0), F.lit(lat0))
    across = distance_m(lon, lat, F.lit(lon0), lat)
    return (up <= height * UNITS[unit] / 2) & (across <= width * UNITS[unit] / 2)
