"""Checks of what users pass in, as columns: the first fault of each row, null where there is none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def box_fault(south: Column, west: Column, north: Column, east: Column) -> Column:
    """Latitudes lie within 90 degrees and longitudes within 180, and the corners are in order."""
    return (
        F.when((F.abs(south) > 90) | (F.abs(north) > 90), "latitude")
        .when((F.abs(west) > 180) | (F.abs(east) > 180), "longitude")
        .when((south > north) | (west > east), "order")
    )


def raster_fault(tile_size: Column, zoom: Column, tile_step: Column, percent: Column, source: Column, input_dir: Column) -> Column:
    """Tile sizes are multiples of 256, steps powers of two, percentages 0 to 100; one of source and folder is given, and a zoom."""
    return (
        F.when((tile_size < 256) | (tile_size % 256 != 0), "tile size")
        .when(zoom.isNull(), "zoom")
        .when((tile_step < 1) | (tile_step.bitwiseAND(tile_step - 1) != 0), "tile step")
        .when(~percent.between(0, 100), "percent")
        .when(source.isNull() == input_dir.isNull(), "source or folder")
    )


def extension(source: Column, input_dir: Column) -> Column:
    """The image format of the source, else that of the folder's template."""
    return F.coalesce(source, F.nullif(F.regexp_extract(input_dir, r"\.([A-Za-z0-9]+)$", 1), F.lit("")))


def grid_shape(tiles: DataFrame) -> DataFrame:
    """(n, width, height, whole): whether a grid (col, row) has one tile at every place of its box."""
    width, height = F.max("col") - F.min("col") + 1, F.max("row") - F.min("row") + 1
    n = F.count(F.lit(1))
    return tiles.agg(n.alias("n"), width.alias("width"), height.alias("height"), ((n == width * height) & (F.count_distinct("col", "row") == n)).alias("whole"))


def boundary_source(city: Column, address: Column, path: Column, location: Column) -> Column:
    """What a boundary is looked up by: the first that is given."""
    named = ((city, "city"), (address, "address"), (path, "path"), (location, "location"))
    return F.coalesce(*(F.when(c.isNotNull(), F.concat(F.lit(f"{n}:"), c)) for c, n in named))


def binarised(channels: Column, weights: list[float] | None, threshold: float) -> Column:
    """255 where the (weighted) sum of channels exceeds a threshold, else 0."""
    scaled = channels if weights is None else F.zip_with(channels, F.array(*map(F.lit, weights)), lambda c, k: c * k)
    return F.when(F.aggregate(scaled, F.lit(0.0), lambda s, x: s + x) > threshold, 255).otherwise(0)
