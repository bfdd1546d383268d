"""Positions: map projection, unit of angles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Web Mercator latitude limit, Earth radius and equator length in metres.
MAX_LATITUDE = 85.05112878
EARTH_RADIUS = 6378137.0
EQUATOR = 40075016.68557849

# Angles of a whole data set below this are taken as radians.
RADIAN_LIMIT = 1.6


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    clamped = F.greatest(F.least(lat, F.lit(MAX_LATITUDE)), F.lit(-MAX_LATITUDE))
    x = F.radians(lon) * F.lit(EARTH_RADIUS)
    y = F.ln(F.tan(F.radians(clamped) / 2 + F.lit(math.pi / 4))) * F.lit(EARTH_RADIUS)
    return x, y


def zoom_span(zoom: Column) -> Column:
    """Width in metres of a map view at a zoom level."""
    return F.lit(EQUATOR) / F.pow(F.lit(2.0), zoom)


def probe_angle(target: float, target_lat: float, data_in_radians: Column) -> Column:
    """A searched angle in the unit of the data; ``target_lat`` decides the unit of the search."""
    degrees = abs(target_lat) > RADIAN_LIMIT
    if degrees:
        return F.when(data_in_radians, F.lit(math.radians(target))).otherwise(F.lit(target))
    return F.when(data_in_radians, F.lit(target)).otherwise(F.lit(math.degrees(target)))


def in_radians(lat: Column) -> Column:
    """Aggregate: the data's angles look like radians."""
    return F.max(F.abs(lat)) < F.lit(RADIAN_LIMIT)
