from __future__ import annotations

import struct
import zlib
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import functions as F

from pavegraph.sources import files, images, paths, vectors
from pavegraph.streaming.metrics import confusion_stream, weighted_mean_stream


def test_png_and_spark_image_reader_agree(spark, tmp_path):
    pixels = np.arange(4 * 4 * 3, dtype=np.uint8).reshape(4, 4, 3)
    (tmp_path / "1_2.png").write_bytes(images.png(pixels))
    row = images.read_images(spark, str(tmp_path)).first()
    assert (row.height, row.width) == (4, 4)
    assert (np.frombuffer(row.data, np.uint8).reshape(4, 4, 3)[..., ::-1] == pixels).all()
    body = images.black_tile(2)
    n = struct.unpack(">I", body[33:37])[0]
    assert set(zlib.decompress(body[41 : 41 + n])) == {0}


def test_stitching_fills_missing_tiles_with_black(spark):
    tiles = spark.createDataFrame([(0, 0, bytes([9] * 12)), (1, 1, bytes([7] * 12)), (0, 1, None)], "col long, row long, data binary")
    image = np.frombuffer(images.stitch_images(tiles, 2, 2).first().image, np.uint8).reshape(4, 4, 3)
    assert image[0, 0, 0] == 9 and image[3, 3, 0] == 7 and image[3, 0, 0] == 0 and image[0, 3, 0] == 0


def test_layers_are_read_by_class(spark, tmp_path):
    lines = spark.createDataFrame([(1, "sidewalk", [(0.0, 0.0), (1.0, 1.0)]), (2, "road", [(2.0, 2.0), (3.0, 1.0)])], "id int, f_type string, pts array<struct<x:double,y:double>>")
    path = str(tmp_path / "net.parquet")
    vectors.write_layer(lines, path)
    assert vectors.read_layer(spark, path, ["id", "f_type"]).filter("f_type = 'road'").collect()[0].id == 2
    vectors.write_features(lines, str(tmp_path / "net"))
    assert spark.read.json(str(tmp_path / "net")).select(F.col("geometry.coordinates")).count() == 2
    back = lines.select(vectors.points_of_wkt(vectors.wkt_line(F.col("pts"))).alias("p"), "pts")
    assert back.filter("p != pts").count() == 0


def test_confusion_over_a_stream_equals_batch(spark, tmp_path):
    rows = spark.range(200).select((F.col("id") % 3).cast("int").alias("truth"), (F.col("id") % 2).cast("int").alias("pred"), F.timestamp_seconds(F.col("id") * 10).alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = confusion_stream(stream, "ts", "10 minutes", "1 minute").writeStream.outputMode("complete").format("memory").queryName("confusion").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.truth, r.pred): r.n for r in spark.sql("select truth, pred, sum(n) as n from confusion group by truth, pred").collect()}
    assert got == {(r.truth, r.pred): r["count"] for r in rows.groupBy("truth", "pred").count().collect()}


def test_weighted_means_over_a_stream_equal_batch(spark, tmp_path):
    rows = spark.range(300).select((F.col("id") % 7).cast("double").alias("val"), (F.col("id") % 4).alias("n"), F.timestamp_seconds(F.col("id") * 10).alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = weighted_mean_stream(stream, "ts", "10 minutes", "1 minute").writeStream.outputMode("complete").format("memory").queryName("means").start()
    q.processAllAvailable()
    q.stop()
    want = rows.groupBy(F.window("ts", "10 minutes").alias("window")).agg((F.sum(F.col("val") * F.col("n")) / F.sum("n")).alias("mean"), F.sum("n").alias("n"))
    by_start = lambda found: {r.window.start: (round(r["mean"], 9), r.n) for r in found.collect()}
    assert by_start(spark.table("means")) == by_start(want)


def test_files_are_written_and_read_in_any_thread(spark, tmp_path):
    rows = spark.createDataFrame([("a.bin", b"\n\x00"), ("b.bin", b"x")], "name string, content binary")
    with ThreadPoolExecutor(1) as pool:
        pool.submit(files.write_files, rows, str(tmp_path / "out")).result()
    assert {(r.name, bytes(r.content)) for r in files.read_files(spark, str(tmp_path / "out")).collect()} == {("a.bin", b"\n\x00"), ("b.bin", b"x")}
    assert {(r.path[-5:], r.length) for r in paths.existing(spark, str(tmp_path / "out"), "*.bin").collect()} == {("a.bin", 2), ("b.bin", 1)}


#: Fixed values. Places with a box (south, west, north, east) and a display name, as a gazetteer would have them.
PLACES = [
    ("New York City", "City of New York, New York, United States", 40.477, -74.259, 40.918, -73.700),
    ("New Jersey", "New Jersey, United States", 38.789, -75.564, 41.357, -73.886),
    ("New Brunswick, New Jersey", "New Brunswick, Middlesex County, New Jersey, United States", 40.460, -74.490, 40.507, -74.412),
    ("Massachusetts", "Massachusetts, United States", 41.187, -73.508, 42.887, -69.859),
    ("King County, Washington", "King County, Washington, United States", 47.084, -122.541, 47.781, -121.066),
    ("Washington, DC", "Washington, District of Columbia, United States", 38.792, -77.120, 38.996, -76.909),
    ("Los Angeles", "Los Angeles, Los Angeles County, California, United States", 33.659, -118.668, 34.337, -118.155),
    ("Jersey City", "Jersey City, Hudson County, New Jersey, United States", 40.662, -74.117, 40.769, -74.021),
    ("Hoboken", "Hoboken, Hudson County, New Jersey, United States", 40.733, -74.044, 40.760, -74.021),
    ("Spring Hill, TN", "Spring Hill, Maury County, Tennessee, United States", 35.691, -86.996, 35.790, -86.862),
    ("Virginia", "Virginia, United States", 36.541, -83.675, 39.466, -75.166),
    ("Maywood, CA", "Maywood, Los Angeles County, California, United States", 33.980, -118.203, 33.994, -118.176),
]
#: Items and the sources that they are about.
WANTED = {
    "New York City": "nyc", "new jersey": "nj", "New Brunswick, New Jersey": "nj", "Massachusetts": "ma", "King County, Washington": "king",
    "Washington, DC": "dc", "Los Angeles": "la", "Jersey City": "nj", "Hoboken": "nj", "Spring Hill, TN": "sh_tn", "Virginia": "va", "Maywood, CA": "la",
    "40.72663613847755, -73.99494276578649": "nyc", "38.90277706745021, -77.03617656372798": "dc", "43.05052202494481, -76.19505424681927": "ny",
    "33.97576931943177, -118.19841961122856, 34.116579445776445, -117.97154942950205": "la", "40.496044, -74.443672, 40.561051, -74.332089": "nj",
    "nyc": "nyc", "ny": "ny", "nj": "nj", "la": "la", "va": "va",
    "-15.49933207, 28.203229539, -15.338660813, 28.358324353": None, "39.525834067367256, 116.21383162969653, 39.582584, 116.292915": None,
    "-37.15612782594927, 64.98947402062927, -37.15612782594927, 64.98947402062927": None, "73.59343881883807, -51.62165778082543": None,
    "54.998172689668486, 36.68930259694381, 55.00000000000001, 36.69112990727614": None, "25.06763435341293, -0.7971811600872423": None,
    "21.82528963135751, -93.76345422053639": None, "Nowhere": None,
}


def test_places_find_their_source(spark):
    from pavegraph.sources import catalog

    gazetteer = spark.createDataFrame(PLACES, "address string, display string, south double, west double, north double, east double")
    items = spark.createDataFrame([(i,) for i in WANTED], "item string")
    assert {r["item"]: r["source"] for r in catalog.resolve(items, gazetteer, catalog.sources(spark)).collect()} == WANTED


def test_every_source_is_found_by_its_own_coverage_and_keyword(spark):
    from pyspark.sql import functions as F

    from pavegraph.sources import catalog

    table = catalog.sources(spark)
    gazetteer = table.select(F.concat(F.lit("place of "), "source").alias("address"), F.col("keyword")[0].alias("display"), "south", "west", "north", "east")
    found = catalog.resolve(gazetteer.select(F.col("address").alias("item")), gazetteer, table).collect()
    assert {r["item"]: r["source"] for r in found} == {f"place of {r.source}": r.source for r in table.collect()}
