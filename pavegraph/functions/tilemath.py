"""Slippy-map tile arithmetic, projections and affine maps as column expressions (no UDFs, so scans and filters fuse)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Half the web-mercator world in metres, and its radius. Fixed values.
HALF_WORLD = 20037508.342789244
RADIUS = 6378137.0


def _c(x: Column | str | float | int) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def tile_count(zoom: Column | int) -> Column:
    """Tiles along one axis, as a double."""
    return F.pow(F.lit(2.0), _c(zoom))


def tile_x(lon: Column | str, zoom: Column | int) -> Column:
    return F.floor((_c(lon) + F.lit(180.0)) / F.lit(360.0) * tile_count(zoom))


def tile_y(lat: Column | str, zoom: Column | int) -> Column:
    return F.floor((F.lit(1.0) - F.asinh(F.tan(F.radians(_c(lat)))) / F.lit(3.141592653589793)) / F.lit(2.0) * tile_count(zoom))


def tile_lon(x: Column | str, zoom: Column | int) -> Column:
    """Western edge of a tile column."""
    return _c(x).cast("double") / tile_count(zoom) * F.lit(360.0) - F.lit(180.0)


def tile_lat(y: Column | str, zoom: Column | int) -> Column:
    """Northern edge of a tile row."""
    return F.degrees(F.atan(F.sinh(F.lit(3.141592653589793) * (F.lit(1.0) - F.lit(2.0) * _c(y).cast("double") / tile_count(zoom)))))


def mercator_x(lon: Column | str) -> Column:
    return _c(lon) * F.lit(HALF_WORLD) / F.lit(180.0)


def mercator_y(lat: Column | str) -> Column:
    return F.lit(RADIUS) * F.log(F.tan(F.lit(3.141592653589793) / F.lit(4.0) + F.radians(_c(lat)) / F.lit(2.0)))


def lon_of_mercator(x: Column | str) -> Column:
    return _c(x) / F.lit(HALF_WORLD) * F.lit(180.0)


def lat_of_mercator(y: Column | str) -> Column:
    return F.degrees(F.lit(2.0) * F.atan(F.exp(_c(y) / F.lit(RADIUS))) - F.lit(3.141592653589793) / F.lit(2.0))


def affine(a: Column, b: Column, d: Column, e: Column, xoff: Column, yoff: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return a * x + b * y + xoff, d * x + e * y + yoff


def affine_inverse(a: Column, b: Column, d: Column, e: Column, xoff: Column, yoff: Column, x: Column, y: Column) -> tuple[Column, Column]:
    det = a * e - b * d
    return (e * (x - xoff) - b * (y - yoff)) / det, (a * (y - yoff) - d * (x - xoff)) / det


def padding(width: Column, step: Column) -> Column:
    """Tiles that fill up a width to a multiple of the step."""
    return F.pmod(step - F.pmod(width, step), step)


def stitched(width: Column, pad: Column, tile_step: Column, stitch_step: Column) -> Column:
    """Tiles of the stepped grid along one axis after stitching, in whole super-tiles."""
    return F.floor(F.floor((width + pad) / tile_step) / stitch_step) * stitch_step


def grid_id(col: Column | str, row: Column | str, height: Column | int) -> Column:
    """Column-major number of a tile."""
    return _c(col) * _c(height) + _c(row)


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Compass bearing in degrees from the first point to the second."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    angle = F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))
    return F.when(angle < 0, angle + F.lit(360.0)).otherwise(angle)


def turn(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Signed angle in degrees from vector a to vector b."""
    return F.degrees(F.atan2(ax * by - ay * bx, ax * bx + ay * by))


def human_bytes(n: Column) -> Column:
    """Bytes in the largest unit that leaves a whole part, with two decimals."""
    power = F.when(n < 1, 0).otherwise(F.floor(F.log(1024.0, F.greatest(n.cast("double"), F.lit(1.0)))))
    units = F.array(*map(F.lit, ("B", "KB", "MB", "GB", "TB", "PB", "EB", "ZB", "YB")))
    return F.concat(F.round(n.cast("double") / F.pow(F.lit(1024.0), power), 2).cast("string"), F.lit(" "), F.get(units, power.cast("int")))
