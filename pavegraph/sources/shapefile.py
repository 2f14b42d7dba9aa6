"""Shapefiles as a Spark data source: .shp, .shx and .dbf, written a set for each task and read in ranges of records.

The geometry is one column, ``parts``: the rings or lines of a shape, null for a shape without geometry. All other
columns are attributes: whole numbers, doubles, booleans, dates and texts.
"""

from __future__ import annotations

import datetime
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, DataType, DateType, DoubleType, LongType, StringType, StructField, StructType

from .files import FolderWriter, opened, register

#: Numbers of the format. Fixed values.
FILE_CODE, VERSION, SHAPES = 9994, 1000, {"line": 3, "polygon": 5}
NAME_CHARS, TEXT_BYTES = 10, 254
#: Bytes after which a task begins another set of files, and records that one task reads.
LARGEST, RECORDS = 1 << 30, 50_000
#: Records that are handed on at once.
TOGETHER = 2_000
POINT = StructType([StructField("x", DoubleType()), StructField("y", DoubleType())])
PARTS = ArrayType(ArrayType(POINT))
#: Kind, width and decimals of each type's field.
FIELDS = {"bigint": ("N", 20, 0), "int": ("N", 11, 0), "double": ("F", 24, 15), "string": ("C", TEXT_BYTES, 0), "boolean": ("L", 1, 0), "date": ("D", 8, 0)}


def _area(ring: np.ndarray) -> float:
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum())


def encoded_shape(parts: list | None, kind: str) -> tuple[bytes, tuple[float, float, float, float] | None]:
    """A record's content with its box. The first ring of a polygon is clockwise, and so is any ring outside of it; holes are not."""
    lines = [np.array([(p["x"], p["y"]) for p in part], float) for part in parts or [] if part]
    if not lines:
        return struct.pack("<i", 0), None
    if kind == "polygon":
        outer = lines[0]
        low, high = outer.min(0), outer.max(0)
        turned = []
        for k, ring in enumerate(lines):
            hole = k > 0 and bool(((ring >= low) & (ring <= high)).all())
            turned.append(ring[::-1] if (_area(ring) > 0) != hole else ring)
        lines = turned
    every = np.concatenate(lines)
    box = (*every.min(0).tolist(), *every.max(0).tolist())
    starts = np.cumsum([0, *map(len, lines[:-1])]).astype("<i4")
    return struct.pack("<i4dii", SHAPES[kind], *box, len(lines), len(every)) + starts.tobytes() + every.astype("<f8").tobytes(), box


def decoded_shape(raw: bytes) -> list[list[dict]] | None:
    if struct.unpack_from("<i", raw)[0] == 0:
        return None
    n_parts, n_points = struct.unpack_from("<ii", raw, 36)
    starts = [*np.frombuffer(raw, "<i4", n_parts, 44).tolist(), n_points]
    xy = np.frombuffer(raw, "<f8", 2 * n_points, 44 + 4 * n_parts).reshape(-1, 2).tolist()
    return [[{"x": x, "y": y} for x, y in xy[a:b]] for a, b in zip(starts, starts[1:])]


def decoded_shapes(bodies: list[bytes]) -> pa.ListArray:
    """``decoded_shape`` of many records as a column, without a Python object for each point."""
    known = [struct.unpack_from("<i", raw)[0] != 0 for raw in bodies]
    sizes = [struct.unpack_from("<ii", raw, 36) if ok else (0, 0) for raw, ok in zip(bodies, known)]
    starts, points, base = [np.empty(0, np.int64)], [np.empty((0, 2))], 0
    for raw, (n_parts, n_points) in zip(bodies, sizes):
        if n_parts:
            starts.append(np.frombuffer(raw, "<i4", n_parts, 44) + base)
            points.append(np.frombuffer(raw, "<f8", 2 * n_points, 44 + 4 * n_parts).reshape(-1, 2))
            base += n_points
    xy = np.concatenate(points)
    line = pa.ListArray.from_arrays(pa.array(np.append(np.concatenate(starts), base), pa.int32()), pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], names=["x", "y"]))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(n for n, _ in sizes)]), pa.int32()), line, mask=pa.array([not ok for ok in known], pa.bool_()))


def encoded_value(value: object, kind: str, width: int) -> bytes:
    """A fixed-width field; null is zeros for texts and blanks for all else."""
    if value is None:
        return (b"\0" if kind == "C" else b" ") * width
    if kind == "C":
        raw = str(value).encode("utf-8")
        if len(raw) > width:
            raise ValueError(f"a text of more than {width} bytes does not fit: {str(value)[:40]!r}")
        return raw.ljust(width)
    text = {"L": lambda v: "T" if v else "F", "D": lambda v: v.strftime("%Y%m%d"), "N": str, "F": repr}[kind](value)
    return text.encode().rjust(width)


def decoded_value(raw: bytes, kind: str) -> object:
    if kind == "C":
        return None if raw[:1] == b"\0" else raw.rstrip(b" ").decode("utf-8")
    text = raw.strip(b" \0").decode()
    if not text:
        return None
    return {"L": lambda t: t in "TtYy", "D": lambda t: datetime.datetime.strptime(t, "%Y%m%d").date(), "N": int, "F": float}[kind](text)


def _header(n_bytes: int, kind: str, box: list[float] | None) -> bytes:
    return struct.pack(">i20xi", FILE_CODE, n_bytes // 2) + struct.pack("<ii4d32x", VERSION, SHAPES[kind], *(box or (0.0, 0.0, 0.0, 0.0)))


def _table_header(n: int, fields: list[tuple[str, str, int, int]]) -> bytes:
    head = struct.pack("<B3BIHH20x", 3, 95, 7, 26, n, 33 + 32 * len(fields), 1 + sum(w for _, _, w, _ in fields))
    return head + b"".join(struct.pack("<11sc4xBB14x", name.encode(), kind.encode(), width, digits) for name, kind, width, digits in fields) + b"\r"


class ShapefileWriter(FolderWriter):
    def __init__(self, options: dict, overwrite: bool, schema: StructType) -> None:
        super().__init__(options, overwrite)
        self.kind = options.get("kind", "polygon")
        if self.kind not in SHAPES or "parts" not in schema.fieldNames():
            raise ValueError(f"a layer has a column `parts`, and is of one of {sorted(SHAPES)}")
        self.fields = []
        for f in schema.fields:
            if f.name != "parts":
                if len(f.name.encode()) > NAME_CHARS or f.dataType.simpleString() not in FIELDS:
                    raise ValueError(f"no such field in a shapefile: {f.name} {f.dataType.simpleString()}")
                self.fields.append((f.name, *FIELDS[f.dataType.simpleString()]))

    def put(self, fs: pafs.FileSystem, folder: str, rows: Iterator[Row]) -> int:
        """Records go to a file without header, as its length and box are known at the end; then it is copied behind one."""
        total, number, row = 0, 0, next(rows, None)
        while row is not None:
            stem, n, at, box, index = f"{folder}/layer-{number:04d}", 0, 100, None, []
            with fs.open_output_stream(f"{stem}.shp.body") as shp, fs.open_output_stream(f"{stem}.dbf.body") as dbf:
                while row is not None and at < LARGEST:
                    body, own = encoded_shape(row["parts"], self.kind)
                    n += 1
                    shp.write(struct.pack(">ii", n, len(body) // 2) + body)
                    dbf.write(b" " + b"".join(encoded_value(row[name], kind, width) for name, kind, width, _ in self.fields))
                    index.append(struct.pack(">ii", at // 2, len(body) // 2))
                    at += 8 + len(body)
                    if own:
                        box = own if box is None else (min(box[0], own[0]), min(box[1], own[1]), max(box[2], own[2]), max(box[3], own[3]))
                    row = next(rows, None)
            self._behind(fs, f"{stem}.shp", _header(at, self.kind, box))
            self._behind(fs, f"{stem}.dbf", _table_header(n, self.fields))
            for name, body in ((f"{stem}.shx", _header(100 + 8 * n, self.kind, box) + b"".join(index)), (f"{stem}.cpg", b"UTF-8")):
                with fs.open_output_stream(name) as out:
                    out.write(body)
            total, number = total + n, number + 1
        return total

    @staticmethod
    def _behind(fs: pafs.FileSystem, path: str, head: bytes) -> None:
        with fs.open_output_stream(path) as out, fs.open_input_stream(f"{path}.body") as body:
            out.write(head)
            while chunk := body.read(1 << 20):
                out.write(chunk)
        fs.delete_file(f"{path}.body")


def _fields_of(fs: pafs.FileSystem, stem: str) -> tuple[list[tuple[str, str, int, int]], int, int]:
    """Fields, the header's length and a record's length of a .dbf."""
    with fs.open_input_file(f"{stem}.dbf") as f:
        head = f.read(32)
        header, record = struct.unpack_from("<HH", head, 8)
        raw = f.read(header - 33)
    out = []
    for at in range(0, len(raw), 32):
        name, kind, width, digits = struct.unpack_from("<11sc4xBB", raw, at)
        out.append((name.rstrip(b"\0").decode(), kind.decode(), width, digits))
    return out, header, record


def _type_of(kind: str, digits: int) -> DataType:
    return {"C": StringType(), "L": BooleanType(), "D": DateType(), "F": DoubleType()}.get(kind, DoubleType() if digits else LongType())


@dataclass
class Records(InputPartition):
    stem: str
    first: int
    count: int


class ShapefileReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.schema = path, to_arrow_schema(schema)

    def partitions(self) -> list[Records]:
        fs, path = opened(self.path)
        out = []
        for info in fs.get_file_info(pafs.FileSelector(path, recursive=True)):
            if info.path.endswith(".shx") and "/_temporary-" not in info.path:
                n = (info.size - 100) // 8
                out += [Records(info.path.removesuffix(".shx"), at, min(RECORDS, n - at)) for at in range(0, n, RECORDS)]
        return out or [Records("", 0, 0)]

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        fs, _ = opened(self.path)
        fields, header, record = _fields_of(fs, partition.stem)
        with fs.open_input_file(f"{partition.stem}.shx") as f:
            f.seek(100 + 8 * partition.first)
            index = np.frombuffer(f.read(8 * partition.count), ">i4").reshape(-1, 2).astype(np.int64) * 2
        with fs.open_input_file(f"{partition.stem}.dbf") as f, fs.open_input_file(f"{partition.stem}.shp") as shapes:
            f.seek(header + record * partition.first)
            for some in np.array_split(index, -(-len(index) // TOGETHER)):
                raw, columns, k = f.read(record * len(some)), {}, 1
                for name, kind, width, digits in fields:
                    as_ = "F" if kind == "N" and digits else kind
                    columns[name] = [decoded_value(raw[at + k : at + k + width], as_) for at in range(0, len(raw), record)]
                    k += width
                bodies = []
                for at, length in some.tolist():
                    shapes.seek(at + 8)
                    bodies.append(shapes.read(length))
                schema = self.schema
                arrays = [decoded_shapes(bodies) if f_.name == "parts" else pa.array(columns[f_.name], f_.type) for f_ in schema]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)


class Shapefiles(DataSource):
    """Format ``pavegraph_shapefile``; option ``kind`` (polygon or line) when writing."""

    @classmethod
    def name(cls) -> str:
        return "pavegraph_shapefile"

    def schema(self) -> StructType:
        fs, path = opened(self.options["path"])
        stems = sorted(i.path.removesuffix(".dbf") for i in fs.get_file_info(pafs.FileSelector(path, recursive=True)) if i.path.endswith(".dbf") and "/_temporary-" not in i.path)
        fields = _fields_of(fs, stems[0])[0] if stems else []
        return StructType([*(StructField(name, _type_of(kind, digits if kind != "F" else 1)) for name, kind, _, digits in fields), StructField("parts", PARTS)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return ShapefileReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ShapefileWriter(self.options, overwrite, schema)


def write_shapefile(layer: DataFrame, folder: str, kind: str = "polygon", mode: str = "overwrite") -> None:
    """A layer (attributes, parts) as sets of .shp, .shx, .dbf and .cpg, one or more a task.

    Names have up to 10 bytes, texts up to 254; longer ones are an error. Trailing blanks of texts are lost, as blanks
    fill the fields. An empty layer leaves an empty folder.
    """
    register(layer.sparkSession, Shapefiles)
    layer.write.format("pavegraph_shapefile").option("kind", kind).mode(mode).save(folder)


def read_shapefile(spark: SparkSession, folder: str) -> DataFrame:
    register(spark, Shapefiles)
    return spark.read.format("pavegraph_shapefile").load(folder)
