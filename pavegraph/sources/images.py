"""Tile images without an imaging library: PNG in and out, black filler, and stitching of whole images."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files


def png(pixels: np.ndarray) -> bytes:
    """An 8-bit RGB or gray image as PNG."""
    h, w = pixels.shape[:2]
    colour = 2 if pixels.ndim == 3 else 0
    rows = np.zeros((h, 1 + pixels.size // h), np.uint8)
    rows[:, 1:] = pixels.reshape(h, -1)
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows.tobytes(), 6)) + part(b"IEND", b"")


def pngs(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """Rows with ``content``, the PNG of each row's ``pixels`` (RGB bytes, height x width x 3), in place of them."""
    names = [c for c in pixels.columns if c != "pixels"]
    schema = ", ".join(f"`{c}` {pixels.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = [png(np.frombuffer(b.as_py(), np.uint8).reshape(height, width, 3)) for b in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(content, pa.binary())], names=[*names, "content"])

    return pixels.select(*names, "pixels").mapInArrow(run, f"{schema}, content binary")


def black_tile(size: int = 256) -> bytes:
    return png(np.zeros((size, size, 3), np.uint8))


def unpng(content: bytes) -> np.ndarray | None:
    """The pixels (height, width, channels) of an 8-bit PNG without interlacing; null for anything else."""
    if content[:8] != b"\x89PNG\r\n\x1a\n" or len(content) < 33:
        return None
    w, h, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", content[16:29])
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or interlaced or channels is None:
        return None
    at, body = 8, b""
    while at + 8 <= len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body += content[at + 8 : at + 8 + size] if kind == b"IDAT" else b""
        at += size + 12
    try:
        rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * channels)
    except (zlib.error, ValueError):
        return None
    kinds, out = rows[:, 0], rows[:, 1:].reshape(h, w, channels).copy()
    if kinds.any():
        _unfiltered(kinds.tolist(), out)
    return out


def _unfiltered(kinds: list[int], px: np.ndarray) -> None:
    """Undoes the filter of each row of pixels in place: 1 adds the left pixel, 2 the one above, 3 their mean, 4 the one of three that fits best."""
    none = np.zeros(px.shape[2], np.int64)
    for r, kind in enumerate(kinds):
        if kind == 1:
            px[r] = np.cumsum(px[r], axis=0, dtype=np.uint8)
        elif kind == 2 and r:
            px[r] += px[r - 1]
        elif kind in (3, 4):
            left = corner = none
            for c in range(px.shape[1]):
                up = px[r - 1, c].astype(np.int64) if r else none
                near = [abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)]
                add = (left + up) // 2 if kind == 3 else np.where((near[0] <= near[1]) & (near[0] <= near[2]), left, np.where(near[1] <= near[2], up, corner))
                left, corner = (px[r, c] + add) % 256, up
                px[r, c] = left


def read_pngs(spark: SparkSession, folder: str) -> DataFrame:
    """(image, height, width, channels, data) of 8-bit PNG files, blue first; other files are left out. Tasks list, read and decode them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(name, px) for name, px in zip(batch.column(0).to_pylist(), map(unpng, batch.column(1).to_pylist())) if px is not None]
            shapes = [pa.array([px.shape[k] for _, px in found], pa.int32()) for k in range(3)]
            data = [(px[..., [2, 1, 0, *range(3, px.shape[2])]] if px.shape[2] > 2 else px).tobytes() for _, px in found]
            yield pa.RecordBatch.from_arrays([pa.array([name for name, _ in found], pa.string()), *shapes, pa.array(data, pa.binary())], names=["image", "height", "width", "channels", "data"])

    return files.read_files(spark, folder).mapInArrow(run, "image string, height int, width int, channels int, data binary")


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, height, width, channels, data) of images, by Spark's own decoder; channels come blue first."""
    return spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(folder).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").toDF("path", "height", "width", "channels", "data")


def stitch_images(tiles: DataFrame, k: int, size: int) -> DataFrame:
    """(big_col, big_row, image): RGB canvases of k x k tiles (col, row, data as RGB bytes); missing and wrong-sized tiles are black.

    A group is k*k tiles at most, so its size is fixed however large the grid.
    """
    def paste(t: pa.Table) -> pa.Table:
        canvas = np.zeros((k * size, k * size, 3), np.uint8)
        for c, r, data in zip(t.column("col").to_pylist(), t.column("row").to_pylist(), t.column("data").to_pylist()):
            if data is not None and len(data) == size * size * 3:
                y, x = r % k * size, c % k * size
                canvas[y : y + size, x : x + size] = np.frombuffer(data, np.uint8).reshape(size, size, 3)
        first = {n: t.column(n)[:1] for n in ("big_col", "big_row")}
        return pa.Table.from_arrays([*(pa.array(v.to_pylist(), pa.int64()) for v in first.values()), pa.array([canvas.tobytes()], pa.binary())], names=["big_col", "big_row", "image"])

    keyed = tiles.select(F.floor(F.col("col") / k).alias("big_col"), F.floor(F.col("row") / k).alias("big_row"), "col", "row", "data")
    return keyed.groupBy("big_col", "big_row").applyInArrow(paste, "big_col long, big_row long, image binary")


#: Class colours: sidewalk, road, crosswalk, background. Fixed values.
PALETTE = ((0, 0, 255), (0, 128, 0), (255, 0, 0), (0, 0, 0))


def colour_rule(images: np.ndarray) -> np.ndarray:
    """The class whose colour is nearest, for each pixel: a stand-in for a trained network."""
    away = ((images[..., None, :].astype(np.int32) - np.array(PALETTE)) ** 2).sum(-1)
    return away.argmin(-1).astype(np.uint8)


def segment(images: DataFrame, size: int, predict=colour_rule) -> DataFrame:
    """(big_col, big_row, mask) of canvases (big_col, big_row, image) of ``size`` pixels by a pluggable ``predict(images) -> classes``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4):
                part = batch.slice(start, 4)
                stack = np.stack([np.frombuffer(b, np.uint8).reshape(size, size, 3) for b in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([m.tobytes() for m in predict(stack)], pa.binary())], names=["big_col", "big_row", "mask"])

    return images.select("big_col", "big_row", "image").mapInArrow(run, "big_col long, big_row long, mask binary")


def mask_pixels(masks: DataFrame, size: int, width: int) -> DataFrame:
    """(tile, r, c, v): the pixel relation of masks, tile numbered by row of a grid ``width`` tiles wide."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, c = (a.ravel().astype(np.int32) for a in np.mgrid[:size, :size])
        for batch in batches:
            for k in range(batch.num_rows):
                tile = batch.column(0)[k].as_py() * width + batch.column(1)[k].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), tile, np.int64)), pa.array(r), pa.array(c), pa.array(np.frombuffer(batch.column(2)[k].as_py(), np.uint8).astype(np.int32))], names=["tile", "r", "c", "v"])

    return masks.mapInArrow(run, "tile long, r int, c int, v int")


def write_arrays(px: DataFrame, folder: str, height: int, width: int, key: str = "tile", value: str = "v") -> None:
    """The pixels (key, r, c, value) of each image as an array file {key}.npy of unsigned bytes; pixels not there are 0."""
    each = px.groupBy(key).agg(F.collect_list(F.struct((F.col("r") * width + F.col("c")).cast("int").alias("at"), F.col(value).cast("int").alias("v"))).alias("px"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = []
            for pixels in batch.column(1):
                grid, out = np.zeros(height * width, np.uint8), io.BytesIO()
                grid[pixels.values.field("at").to_numpy()] = pixels.values.field("v").to_numpy()
                np.lib.format.write_array(out, grid.reshape(height, width))
                content.append(out.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary())], names=["name", "content"])

    named = each.select(F.concat(F.col(key).cast("string"), F.lit(".npy")).alias("name"), "px")
    files.write_files(named.mapInArrow(run, "name string, content binary"), folder)


def read_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """(tile, r, c, v) of the two-dimensional arrays in files {tile}.npy; other files are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grid = np.lib.format.read_array(io.BytesIO(content), allow_pickle=False)
                r, c = (a.ravel().astype(np.int32) for a in np.indices(grid.shape))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(grid.size, int(name), np.int64)), pa.array(r), pa.array(c), pa.array(grid.ravel().astype(np.int32))], names=["tile", "r", "c", "v"])

    found = files.read_files(spark, folder).select(F.regexp_extract("name", r"^(-?\d+)\.npy$", 1).alias("tile"), "content")
    return found.filter("tile != ''").mapInArrow(run, "tile long, r int, c int, v int")


def write_images(canvases: DataFrame, folder: str, extension: str) -> None:
    """Images (col, row, i, content) as files {row}_{col}_{i}.{extension}, byte for byte, many a task."""
    name = F.concat(F.concat_ws("_", "row", "col", "i"), F.lit(f".{extension}"))
    files.write_files(canvases.select(name.alias("name"), "content"), folder)


def read_written(spark: SparkSession, folder: str) -> DataFrame:
    """(image, content) of images that ``write_images`` wrote."""
    return files.read_files(spark, folder).withColumnRenamed("name", "image")
