"""Queries on projections, tiles against polygons, resampling and cached relations."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import projections as pj
from ..functions.storage import shared_dir
from ..operators import cover, resample
from ..sources import cache
from .fixtures import Views
from .registry import query
from .shapes import with_ctes

TERMS = lambda series, form: " + ".join(f"({c!r}) * " + form.format(k=2 * j) for j, c in enumerate(series, 1))
UTM = f"""z as (select id, lon, lat, cast(floor((lon + 180e0) / 6e0) as bigint) % 60 + 1 as zone, radians(lon - ((cast(floor((lon + 180e0) / 6e0) as bigint) % 60 + 1) * 6e0 - 183e0)) as away, sin(radians(lat)) as s from geo_point),
    t as (select *, sinh(atanh(s) - {pj.E!r} * atanh({pj.E!r} * s)) as t from z),
    x as (select *, atan2(t, cos(away)) as xi, atanh(sin(away) / sqrt(1e0 + t * t)) as eta from t)"""


def _near(lon: Column, lat: Column, back: tuple[Column, Column]) -> Column:
    return (F.abs(back[0] - lon) < 1e-6) & (F.abs(back[1] - lat) < 1e-6)


@query(
    with_ctes(
        UTM,
        f"""select id, zone, round(500000e0 + {0.9996 * pj.MERIDIAN!r} * (eta + {TERMS(pj.FORWARD, "cos({k} * xi) * sinh({k} * eta)")}), 2) as east,
        round(case when lat < 0 then 10000000e0 else 0e0 end + {0.9996 * pj.MERIDIAN!r} * (xi + {TERMS(pj.FORWARD, "sin({k} * xi) * cosh({k} * eta)")}), 2) as north, true as back_again from x""",
    ),
    "geo_point",
)
def zone_projection(v: Views) -> DataFrame:
    """All points in metres of the zone they lie in, and back to where they were."""
    lon, lat = F.col("lon"), F.col("lat")
    placed = v.geo_point().withColumn("zone", pj.zone(lon))
    into = pj.of_zone(F.col("zone"), lat)
    x, y = into.forward(lon, lat)
    there = placed.select("id", "lon", "lat", "zone", x.alias("x"), y.alias("y"))
    return there.select("id", F.col("zone").cast("long").alias("zone"), F.round("x", 2).alias("east"), F.round("y", 2).alias("north"), _near(lon, lat, pj.of_zone(F.col("zone"), lat).back(F.col("x"), F.col("y"))).alias("back_again"))


#: A state's plane: parallels, origin, false easting. Fixed values.
PLANE = pj.Conic(41 + 2 / 60, 40 + 40 / 60, 40 + 10 / 60, -74.0, 300_000.0)
EXPONENT, FACTOR, ORIGIN = PLANE.shape


@query(
    with_ctes(
        f"""r as (select id, {pj.RADIUS * FACTOR!r} * pow(tan(pi() / 4e0 - radians(lat) / 2e0) / pow((1e0 - {pj.E!r} * sin(radians(lat))) / (1e0 + {pj.E!r} * sin(radians(lat))), {pj.E / 2!r}), {EXPONENT!r}) as r,
        {EXPONENT!r} * radians(lon + 74e0) as turn from geo_point)""",
        f"select id, round(300000e0 + r * sin(turn), 2) as east, round({ORIGIN!r} - r * cos(turn), 2) as north, true as back_again from r",
    ),
    "geo_point",
)
def conic_projection(v: Views) -> DataFrame:
    """All points in the plane of one state, and back."""
    lon, lat = F.col("lon"), F.col("lat")
    x, y = PLANE.forward(lon, lat)
    there = v.geo_point().select("id", "lon", "lat", x.alias("x"), y.alias("y"))
    lon2, lat2 = PLANE.back(F.col("x"), F.col("y"))
    round_the_world = F.pmod(lon2 - lon + 180.0, F.lit(360.0)) - 180.0 + lon
    return there.select("id", F.round("x", 2).alias("east"), F.round("y", 2).alias("north"), _near(lon, lat, (round_the_world, lat2)).alias("back_again"))


#: Side of a tile on the plane of the polygons.
SIDE = 8.0
HIT = """l as (select x0, y0, x0 + w as x1, y0 + h / 2e0 as y1 from rect where kind <> 0 union all select x0, y0 + h / 2e0, x0 + w / 2e0, y0 + h from rect where kind <> 0),
    cells as (select distinct cast(floor(x0 / 8e0) as bigint) + a as cx, cast(floor(y0 / 8e0) as bigint) + b as cy from l, (select unnest(range(9)) as a) i, (select unnest(range(4)) as b) j
        where (cast(floor(x0 / 8e0) as bigint) + a) * 8e0 < x1 and (cast(floor(y0 / 8e0) as bigint) + b) * 8e0 < y1)"""


@query(with_ctes(HIT, "select idd, exists (select 1 from cells where cx = col and cy = row) as inside from tile"), "rect", "tile")
def tiles_in_polygons(v: Views) -> DataFrame:
    """Which tiles share area with an L-shape, and which do not."""
    layer = v.polygon().filter("kind <> 0").select("geom_id", F.array("ring").alias("rings"))
    return cover.tiles_marked(v.tile(), layer, SIDE).select("idd", "inside")


@query(with_ctes(HIT.replace("select x0, y0, x0 + w as x1", "select geom_id, x0, y0, x0 + w as x1").replace("union all select x0,", "union all select geom_id, x0,").replace("select distinct cast", "select distinct geom_id, cast"), "select geom_id, count(*) as tiles from cells join tile on cx = col and cy = row group by geom_id"), "rect", "tile")
def polygon_tiles(v: Views) -> DataFrame:
    """How many tiles of the grid each L-shape shares area with."""
    layer = v.polygon().filter("kind <> 0").select("geom_id", F.array("ring").alias("rings"))
    return cover.meeting(v.tile(), layer, SIDE).groupBy("geom_id").agg(F.count(F.lit(1)).alias("tiles"))


SIZES = [(5, 6, "bilinear"), (3, 4, "area"), (12, 16, "bilinear")]


def _along(n: int, out: str, at: str) -> str:
    """Weights of one side of eight pixels, as SQL, for ``n`` pixels."""
    return f"""select i as {out}, least(greatest(floor((i + 0.5e0) * {8 / n!r} - 0.5e0) + k, 0), 7) as {at}, case k when 1 then 1e0 else 0e0 end + (1 - 2 * k) * (1e0 - ((i + 0.5e0) * {8 / n!r} - 0.5e0 - floor((i + 0.5e0) * {8 / n!r} - 0.5e0))) as w_{at}
        from (select unnest(range({n})) as i) a, (select unnest([0, 1]) as k) b"""


def _shares(n: int, out: str, at: str) -> str:
    return f"select i as {out}, k as {at}, greatest(least((i + 1) * {8 / n!r}, k + 1) - greatest(i * {8 / n!r}, k), 0e0) / {8 / n!r} as w_{at} from (select unnest(range({n})) as i) a, (select unnest(range(8)) as k) b"


def _resized_sql() -> str:
    parts = []
    for h, w, method in SIZES:
        side = _shares if method == "area" else _along
        parts.append(
            f"select tile, '{method} {h}x{w}' as how, round(sum(v * w_r * w_c), 6) as total, round(sum(v * w_r * w_c * (i * 31 + j)), 6) as checked from mask_px join ({side(h, 'i', 'r')}) a using (r) join ({side(w, 'j', 'c')}) b using (c) group by tile"
        )
    nearest = "select tile, 'nearest 12x5' as how, cast(sum(v) as double) as total, cast(sum(v * (i * 31 + j)) as double) as checked from mask_px join (select i, floor((i + 0.5e0) * 8e0 / 12e0) as r from (select unnest(range(12)) as i) a) x using (r) join (select j, floor((j + 0.5e0) * 8e0 / 5e0) as c from (select unnest(range(5)) as j) b) y using (c) group by tile"
    return " union all ".join([*parts, nearest])


@query(_resized_sql(), "mask_px")
def resized_masks(v: Views) -> DataFrame:
    """All masks at other sizes, by weights of near pixels, of areas, and by the nearest pixel."""
    px = v.mask_px().withColumn("value", F.col("v").cast("double"))
    found = []
    for h, w, method in [*SIZES, (12, 5, "nearest")]:
        at = F.col("value") * (F.col("r") * 31 + F.col("c"))
        total = resample.resized(px, (8, 8), (h, w), method).groupBy("tile").agg(F.round(F.sum("value"), 6).alias("total"), F.round(F.sum(at), 6).alias("checked"))
        found.append(total.select("tile", F.lit(f"{method} {h}x{w}").alias("how"), "total", "checked"))
    return found[0].union(found[1]).union(found[2]).union(found[3])


@query(
    f"""select tile, round(sum((value - 1.5e0) / 2e0 * (i * 31 + 3 - j)), 6) as checked, cast(sum(cls * (i * 31 + 3 - j)) as bigint) as classes from (
        select tile, i - 1 as i, j - 2 as j, sum(v * w_r * w_c) as value from mask_px join ({_along(6, 'i', 'r')}) a using (r) join ({_along(6, 'j', 'c')}) b using (c) where i between 1 and 4 and j between 2 and 5 group by 1, 2, 3) x
        join (select tile, i - 1 as i, j - 2 as j, v as cls from mask_px join (select i, floor((i + 0.5e0) * 8e0 / 6e0) as r from (select unnest(range(6)) as i) a) x using (r) join (select j, floor((j + 0.5e0) * 8e0 / 6e0) as c from (select unnest(range(6)) as j) b) y using (c)) y using (tile, i, j) group by tile""",
    "mask_px",
)
def transform_chain(v: Views) -> DataFrame:
    """Image and mask resized together, cropped, mirrored and normalised, as one plan."""
    px = v.mask_px().withColumn("value", F.col("v").cast("double"))
    out = resample.chain(px, lambda d: resample.resized_pair(d, (8, 8), (6, 6)), lambda d: resample.cropped(d, 1, 2, 4, 4), lambda d: resample.mirrored(d, 4), lambda d: resample.normalised(d, 1.5, 2.0))
    at = F.col("r") * 31 + F.col("c")
    return out.groupBy("tile").agg(F.round(F.sum(F.col("value") * at), 6).alias("checked"), F.sum(F.col("v") * at).cast("long").alias("classes"))


@query("select v as cls, count(*) as n, turn > 0 as reused from mask_px, (select unnest([0, 1]) as turn) t group by v, turn", "mask_px")
def cached_relation(v: Views) -> DataFrame:
    """A relation of counts by class asked for twice: built at first, then read as it is."""
    folder = f"{shared_dir(v.spark).rstrip('/')}/cache-{uuid.uuid4().hex}"
    px = v.mask_px()
    key = cache.fingerprint(v.table("embeddings"), grid=8)
    ask = lambda: cache.cached(v.spark, folder, key, lambda: px.groupBy(F.col("v").alias("cls")).agg(F.count(F.lit(1)).alias("n")))
    found = [ask(), ask()]
    return found[0].rows.withColumn("reused", F.lit(found[0].reused)).union(found[1].rows.withColumn("reused", F.lit(found[1].reused)))


@query("select tile, r, c, v from mask_px union all select tile, r, c + 8, 3 - v from mask_px union all select tile, r, 23 - c, v from mask_px", "mask_px")
def composites(v: Views) -> DataFrame:
    """Each mask, its negative and its mirror image beside each other."""
    px = v.mask_px()
    return resample.side_by_side(8, px, px.withColumn("v", 3 - F.col("v")), resample.mirrored(px, 8))
