"""Views over the driver tables that stand in for tiles, polygons, lines and masks, for Spark and as SQL for the oracle.

Planes of polygons and lines grow eastwards with the keys, so shapes lie as close in large tables as in small ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same views as common table expressions.
SQL = {
    "geo_point": "select c_custkey as id, c_nationkey as nation, -60e0 + cast((c_custkey * 7919) % 120000 as double) / 1e3 as lat, -179e0 + cast((c_custkey * 104729) % 358000 as double) / 1e3 as lon from customer",
    "region_box": "select cast(nation as varchar) as name, min(lat) as south, min(lon) as west, max(lat) as north, max(lon) as east from geo_point group by nation",
    "rect": "select p_partkey as geom_id, cast(p_size as double) as w, cast(p_partkey % 17 + 1 as double) as h, cast((p_partkey * 7919) % 2000 + p_partkey // 2000 * 2100 as double) as x0, cast((p_partkey * 104729) % 1500 as double) as y0, p_partkey % 3 as kind from part",
    "dense_rect": "select * replace (floor(x0 / 4e0) as x0, floor(y0 / 4e0) as y0) from rect",
    "vertex": """select geom_id, vtx_no, x0 + dx as x, y0 + dy as y from (
        select geom_id, x0, y0, 0 as vtx_no, 0e0 as dx, 0e0 as dy from rect union all
        select geom_id, x0, y0, 1, w, 0e0 from rect union all
        select geom_id, x0, y0, 2, w, case when kind = 0 then h else h / 2e0 end from rect union all
        select geom_id, x0, y0, 3, w / 2e0, h / 2e0 from rect where kind <> 0 union all
        select geom_id, x0, y0, 4, w / 2e0, h from rect where kind <> 0 union all
        select geom_id, x0, y0, 5, 0e0, h from rect union all
        select geom_id, x0, y0, 6, 0e0, 0e0 from rect) t""",
    "polyline_vertex": """select l_orderkey as line_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as vtx_no,
        cast(l_partkey % 200 + l_orderkey // 15000 * 210 as double) as x, cast(l_suppkey % 200 as double) as y from lineitem""",
    "street": """select line_id, vtx_no, x, y from (select l_orderkey as line_id, count(*) over (partition by l_orderkey) as n, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as vtx_no,
        cast(((l_orderkey % 10007) * (l_orderkey % 10007) * 7919 + l_orderkey) % 1201 + l_partkey % 9 + l_orderkey // 15000 * 1300 as double) as x, cast(((l_orderkey % 10009) * (l_orderkey % 10009) * 104729 + l_orderkey * 31) % 1303 + l_suppkey % 9 as double) as y from lineitem) t where n > 1""",
    "tile": "select o_orderkey as idd, cast(floor(o_orderkey / 64e0) as bigint) as col, o_orderkey % 64 as row from orders",
    "labelled": "select doc_id as id, quality as truth, toxic as pred from labels",
    "metric_stream": "select event_id as seq, floor(value * 100e0) as val, user_id % 7 + 1 as n from events",
}
NEEDS = {"region_box": ["geo_point"], "vertex": ["rect"], "dense_rect": ["rect"]}


def mask_sql(grid: int = 8) -> str:
    """Embeddings as grid x grid masks of four classes."""
    return f"select vec_id as tile, cast(floor(i / {grid}e0) as int) as r, cast(i % {grid} as int) as c, case when e < -0.1e0 then 0 when e < 0e0 then 1 when e < 0.1e0 then 2 else 3 end as v"


SQL["mask_px"] = mask_sql() + " from (select vec_id, unnest(embedding) as e, unnest(range(64)) as i from embeddings) t"


def with_views(sql: str, *names: str) -> str:
    """``sql`` with the named views in front."""
    order: list[str] = []
    for n in names:
        order += [x for x in [*NEEDS.get(n, []), n] if x not in order]
    recursive = "recursive " if "reach(" in sql else ""
    more = sql.lstrip()
    joint = "" if more.startswith(",") else " "
    return f"with {recursive}{', '.join(f'{n} as ({SQL[n]})' for n in order)}{joint}{more}"


class Views:
    """The views as DataFrames over one table directory."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def geo_point(self) -> DataFrame:
        place = lambda m, n: F.pmod(F.col("c_custkey") * m, F.lit(n)).cast("double") / F.lit(1000.0)
        return self.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), (F.lit(-60.0) + place(7919, 120000)).alias("lat"), (F.lit(-179.0) + place(104729, 358000)).alias("lon"))

    def region_box(self) -> DataFrame:
        return self.geo_point().groupBy(F.col("nation").cast("string").alias("name")).agg(F.min("lat").alias("south"), F.min("lon").alias("west"), F.max("lat").alias("north"), F.max("lon").alias("east"))

    def rect(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.table("part").select(k.alias("geom_id"), F.col("p_size").cast("double").alias("w"), (k % 17 + 1).cast("double").alias("h"), ((k * 7919) % 2000 + F.floor(k / 2000) * 2100).cast("double").alias("x0"), ((k * 104729) % 1500).cast("double").alias("y0"), (k % 3).alias("kind"))

    def dense_rect(self) -> DataFrame:
        """The rectangles moved together, so that they overlap."""
        return self.rect().withColumns({"x0": F.floor(F.col("x0") / 4).cast("double"), "y0": F.floor(F.col("y0") / 4).cast("double")})

    def polygon(self) -> DataFrame:
        """(geom_id, ring) with rectangles and L-shapes."""
        w, h, half = F.col("w"), F.when(F.col("kind") == 0, F.col("h")).otherwise(F.col("h") / 2.0), F.lit(2.0)
        point = lambda no, dx, dy: F.struct(F.lit(no).alias("vtx_no"), (F.col("x0") + dx).alias("x"), (F.col("y0") + dy).alias("y"))
        zero = F.lit(0.0)
        full = [point(0, zero, zero), point(1, w, zero), point(2, w, h), point(3, w / half, F.col("h") / half), point(4, w / half, F.col("h")), point(5, zero, F.col("h")), point(6, zero, zero)]
        ring = F.when(F.col("kind") == 0, F.array(*(full[i] for i in (0, 1, 2, 5, 6)))).otherwise(F.array(*full))
        return self.rect().select("geom_id", "kind", ring.alias("ring"))

    def vertex(self) -> DataFrame:
        return self.polygon().select("geom_id", F.explode("ring").alias("p")).select("geom_id", "p.vtx_no", "p.x", "p.y")

    def line(self) -> DataFrame:
        """(line_id, pts) in vertex order."""
        p = F.struct(F.col("l_linenumber").alias("k1"), F.col("l_partkey").alias("k2"), F.col("l_suppkey").alias("k3"), F.col("l_extendedprice").alias("k4"), F.col("l_shipdate").alias("k5"))
        lines = self.table("lineitem").groupBy(F.col("l_orderkey").alias("line_id")).agg(F.sort_array(F.collect_list(p)).alias("v"))
        return lines.select("line_id", F.transform("v", lambda v: F.struct((v["k2"] % 200 + F.floor(F.col("line_id") / 15000) * 210).cast("double").alias("x"), (v["k3"] % 200).cast("double").alias("y"))).alias("pts"))

    def street(self) -> DataFrame:
        """Short lines (line_id, pts) of two points or more, as far apart on a larger plane as streets are."""
        p = F.struct(F.col("l_linenumber").alias("k1"), F.col("l_partkey").alias("k2"), F.col("l_suppkey").alias("k3"), F.col("l_extendedprice").alias("k4"), F.col("l_shipdate").alias("k5"))
        lines = self.table("lineitem").groupBy(F.col("l_orderkey").alias("line_id")).agg(F.sort_array(F.collect_list(p)).alias("v")).filter(F.size("v") > 1)
        k = F.col("line_id")
        x0, y0 = ((k % 10007) * (k % 10007) * 7919 + k) % 1201 + F.floor(k / 15000) * 1300, ((k % 10009) * (k % 10009) * 104729 + k * 31) % 1303
        return lines.select("line_id", F.transform("v", lambda v: F.struct((x0 + v["k2"] % 9).cast("double").alias("x"), (y0 + v["k3"] % 9).cast("double").alias("y"))).alias("pts"))

    def tile(self) -> DataFrame:
        return self.table("orders").select(F.col("o_orderkey").alias("idd"), F.floor(F.col("o_orderkey") / 64).alias("col"), (F.col("o_orderkey") % 64).alias("row"))

    def mask_px(self) -> DataFrame:
        e = F.col("e")
        px = self.table("embeddings").select(F.col("vec_id").alias("tile"), F.posexplode("embedding").alias("i", "e"))
        return px.select("tile", F.floor(F.col("i") / 8).cast("int").alias("r"), (F.col("i") % 8).cast("int").alias("c"), F.when(e < -0.1, 0).when(e < 0.0, 1).when(e < 0.1, 2).otherwise(3).alias("v"))

    def labelled(self) -> DataFrame:
        return self.table("labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("truth"), F.col("toxic").alias("pred"))

    def metric_stream(self) -> DataFrame:
        return self.table("events").select(F.col("event_id").alias("seq"), F.floor(F.col("value") * 100.0).alias("val"), (F.col("user_id") % 7 + 1).alias("n"))
