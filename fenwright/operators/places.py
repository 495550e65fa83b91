"""Geo sets, tables of (key, member, lon, lat): search by radius or box, nearest first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo


def add(points: DataFrame) -> DataFrame:
    """Points as a ranked set of cells; points out of range go."""
    ok = F.col("lon").between(-180, 180) & F.col("lat").between(-geo.LAT_LIMIT, geo.LAT_LIMIT)
    return points.where(ok).select("key", "member", geo.encode("lon", "lat").cast("double").alias("score"))


def positions(cells: DataFrame) -> DataFrame:
    lon, lat = geo.decode("score")
    return cells.select("key", "member", lon.alias("lon"), lat.alias("lat"))


def search(
    points: DataFrame, lon: float, lat: float, radius: float | None = None, box: tuple[float, float] | None = None, unit: str = "m", descending: bool | None = None, count: int | None = None
) -> DataFrame:
    """Points within the radius or box with `dist` in the unit; sorted if descending is given or count asks for the nearest."""
    here = geo.in_radius("lon", "lat", lon, lat, radius, unit) if radius is not None else geo.in_box("lon", "lat", lon, lat, *box, unit)
    out = points.where(here).withColumn("dist", geo.distance_m("lon", "lat", F.lit(lon), F.lit(lat)) / geo.UNITS[unit])
    if descending is not None or count is not None:
        d = F.col("dist")
        out = out.orderBy(d.desc() if descending else d, "member")
    return out.limit(count) if count is not None else out


def search_by_member(points: DataFrame, key, member, **options) -> DataFrame:
    """Like search, around a member: a join with its one row, so nothing is collected."""
    me = points.where((F.col("key") == F.lit(key)) & (F.col("member") == F.lit(member))).select("key", F.col("lon").alias("_lon"), F.col("lat").alias("_lat"))
    unit, radius, box = options.get("unit", "m"), options.get("radius"), options.get("box")
    out = points.join(me, "key").withColumn("dist", geo.distance_m("lon", "lat", "_lon", "_lat") / geo.UNITS[unit])
    if radius is not None:
        out = out.where(F.col("dist") <= radius)
    else:
        up = geo.distance_m("_lon", "lat", "_lon", "_lat")
        across = geo.distance_m("lon", "lat", "_lon", "lat")
        out = out.where((up <= box[1] * geo.UNITS[unit] / 2) & (across <= box[0] * geo.UNITS[unit] / 2))
    return out.drop("_lon", "_lat")
