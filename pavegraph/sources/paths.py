"""Tile paths and URLs, location strings, and what is there and what is missing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def template_format(template: Column) -> Column:
    """A path with one-letter tokens x, y and perhaps z as a format with {x}, {y}, {z}.

    Tokens stand alone between separators; x and y must be there, and a file extension; else null.
    """
    token = lambda c, k: F.regexp_replace(c, f"(?<![A-Za-z0-9]){k}(?![A-Za-z0-9{{}}])", f"{{{k}}}")
    stem = F.regexp_extract(template, r"^(.*)\.([A-Za-z0-9]+)$", 1)
    ext = F.regexp_extract(template, r"^(.*)\.([A-Za-z0-9]+)$", 2)
    out = stem
    for k in "xyz":
        out = token(out, k)
    return F.when((ext != "") & F.contains(out, F.lit("{x}")) & F.contains(out, F.lit("{y}")), F.concat(out, F.lit("."), ext))


def fill_template(template: Column, x: str = "x", y: str = "y", z: str = "z") -> Column:
    out = template
    for token, column in (("{x}", x), ("{y}", y), ("{z}", z)):
        out = F.replace(out, F.lit(token), F.col(column).cast("string"))
    return out


def parse_path(path: Column, format_: str, token: str) -> Column:
    """The number that stands for a token in a path; null if the path does not have the format."""
    names = re.findall(r"\{([xyz])\}", format_)
    pattern = re.sub(r"\\\{[xyz]\\\}", r"(\\d+)", re.escape(format_))
    found = F.regexp_extract(path, f"{pattern}$", names.index(token) + 1)
    return F.nullif(found, F.lit(""))


def existing(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, length) of files under a folder, by listing alone: no content is read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder).select("path", "length")


def images_with_masks(images: DataFrame, masks: DataFrame) -> DataFrame:
    """(stem, image, mask) of paths that share a file stem."""
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    return images.select(stem.alias("stem"), F.col("path").alias("image")).join(masks.select(stem.alias("stem"), F.col("path").alias("mask")), "stem")


def excluded(tiles: DataFrame, ids: DataFrame) -> DataFrame:
    """Tiles whose number is not in a list of ``ids``."""
    return tiles.join(ids, tiles["idd"] == ids["ids"], "left_anti")


def fates(tiles: DataFrame, there: DataFrame) -> DataFrame:
    """(idd, fate) of tiles (idd, status) that are not there yet: loaded, a black filler for 404, or an error."""
    missing = tiles.join(there, "idd", "left_anti")
    return missing.select("idd", F.when(F.col("status") == 404, "black").when(F.col("status") == 200, "loaded").otherwise("error").alias("fate"))


def parse_location(rows: DataFrame) -> DataFrame:
    """(id, kind, south, west, north, east) of location strings: four numbers are a box, two a centroid, else an address.

    Numbers are latitude, longitude pairs in any corner order, rounded to ten places.
    """
    numbers = F.transform(F.split("location", r"\s*,\s*"), lambda s: s.try_cast("double"))
    n = F.when(F.exists(numbers, lambda v: v.isNull()), 0).otherwise(F.size(numbers))
    kind = F.when(n == 4, "box").when(n == 2, "centroid").otherwise("address")
    at = lambda i: F.when(n >= 2, F.get(numbers, F.lit(i)))
    a, b = at(0), at(1)
    c, d = F.when(n == 4, at(2)).otherwise(a), F.when(n == 4, at(3)).otherwise(b)
    corner = lambda f, x, y, name: F.round(f(x, y), 10).alias(name)
    return rows.select("id", kind.alias("kind"), corner(F.least, a, c, "south"), corner(F.least, b, d, "west"), corner(F.greatest, a, c, "north"), corner(F.greatest, b, d, "east"))


def geocode(addresses: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Boxes of addresses (id, address) from a local gazetteer (place, south, west, north, east), without a network."""
    key = F.lower(F.trim(F.split_part("address", F.lit(","), F.lit(1))))
    return addresses.withColumn("place", key).join(gazetteer.withColumn("place", F.lower("place")), "place", "left").drop("place")


def short_name(display: Column) -> Column:
    """The first part of a display name, in lower case, with underscores for spaces."""
    return F.lower(F.replace(F.split_part(display, F.lit(","), F.lit(1)), F.lit(" "), F.lit("_")))


def name_faults(name: Column) -> Column:
    return F.array_compact(F.array(F.when(F.contains(name, F.lit(" ")), "space"), F.when(F.contains(name, F.lit(".")), "dot"), F.when(F.length(name) > 15, "long")))


def project_paths(root: Column, name: Column) -> dict[str, Column]:
    """The folders of a project."""
    parts = {"tiles": ("tiles",), "static": ("tiles", "static"), "stitched": ("tiles", "stitched"), "segmentation": ("segmentation",), "polygons": ("polygons",), "network": ("network",)}
    return {k: F.concat_ws("/", root, name, *map(F.lit, v)) for k, v in parts.items()}


def digest(content: Column) -> Column:
    """The SHA-256 of a file's content, in lower-case hex, to hold against the one that is published."""
    return F.sha2(content, 256)


def numbered_files(files: DataFrame) -> DataFrame:
    """(idd, path): files by the number at the end of their stem, after the last underscore."""
    number = F.regexp_extract("path", r"_(\d+)\.[^./]+$", 1)
    return files.filter(number != "").select(number.cast("long").alias("idd"), "path")


def found_files(files: DataFrame, prefix: str = "", suffix: str = "") -> DataFrame:
    """(path, matches) of files whose name begins and ends so; ``matches`` is how many there are, 1 where a name is told by them."""
    name = F.element_at(F.split("path", "/"), -1)
    kept = files.filter(name.startswith(prefix) & name.endswith(suffix))
    return kept.select("path").crossJoin(F.broadcast(kept.agg(F.count(F.lit(1)).alias("matches"))))  # one row on the right
