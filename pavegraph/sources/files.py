"""A Spark data source that writes rows as files, byte for byte, with commit and abort.

A task writes its files into a folder of its own under a temporary one; the driver's commit moves one folder a task, so
its work grows with the tasks, not with the files. A task that fails or is run twice leaves nothing behind.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.storage import dealt, remove, table

#: Files, and bytes of them, that are handed on at once.
BATCH_FILES, BATCH_BYTES = 1_000, 1 << 24
#: Files that are there at once where they are read back, about: each takes a block of the disk and an entry of its own.
TURN_FILES = 1 << 18


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, local or remote, and the path within it."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


@dataclass
class Written(WriterCommitMessage):
    folder: str | None
    count: int


class FolderWriter(DataSourceWriter):
    """Has every task write into a folder of its own, and moves the folders of tasks that ended well."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite, self.run = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex

    @property
    def temporary(self) -> str:
        return f"{self.path}/_temporary-{self.run}"

    def put(self, fs: pafs.FileSystem, folder: str, rows: Iterator[Row]) -> int:
        """Write ``rows`` into ``folder``, which is there, and tell how many."""
        raise NotImplementedError

    def write(self, iterator: Iterator[Row]) -> Written:
        at = TaskContext.get()
        fs, path = opened(self.temporary)
        folder = f"{path}/part-{at.partitionId():05d}-{at.taskAttemptId()}"
        first = next(iterator, None)
        if first is None:
            return Written(None, 0)
        fs.create_dir(folder, recursive=True)

        def every() -> Iterator[Row]:
            yield first
            yield from iterator

        return Written(folder, self.put(fs, folder, every()))

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = opened(self.path)
        fs.create_dir(path, recursive=True)
        if self.overwrite:
            for old in fs.get_file_info(pafs.FileSelector(path)):
                if not old.base_name.startswith("_temporary-"):
                    (fs.delete_dir if old.type == pafs.FileType.Directory else fs.delete_file)(old.path)
        for m in messages:
            if m is not None and m.folder is not None:
                fs.move(m.folder, f"{path}/{m.folder.rpartition('/')[2]}-{self.run[:8]}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, path = opened(self.temporary)
        if fs.get_file_info(path).type == pafs.FileType.Directory:
            fs.delete_dir(path)


class _Files(FolderWriter):
    def put(self, fs: pafs.FileSystem, folder: str, rows: Iterator[Row]) -> int:
        n = 0
        for row in rows:
            if not row["name"] or "/" in row["name"] or row["name"] in (".", ".."):
                raise ValueError(f"not a file's name: {row['name']!r}")
            with fs.open_output_stream(f"{folder}/{row['name']}") as out:
                out.write(row["content"] or b"")
            n += 1
        return n


class FileSink(DataSource):
    """``df.write.format("pavegraph_files").save(folder)`` for rows (name, content): one file a row."""

    @classmethod
    def name(cls) -> str:
        return "pavegraph_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if {"name", "content"} - set(schema.fieldNames()):
            raise ValueError("rows need a name and a content")
        return _Files(self.options, overwrite)


def register(spark: SparkSession, source: type[DataSource]) -> None:
    """Registers a source for callers in any thread: Spark looks it up in the session active there, which making a table sets."""
    spark.createDataFrame([], "none int")
    spark.dataSource.register(source)


def write_files(rows: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """Rows (name, content) as files under ``folder``; null content is an empty file, and equal names in one task overwrite each other."""
    register(rows.sparkSession, FileSink)
    dealt(rows.select("name", F.col("content").cast("binary").alias("content"))).write.format("pavegraph_files").mode(mode).save(folder)


def _tops(folder: str) -> list[pafs.FileInfo]:
    fs, path = opened(folder)
    return fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, content) of the files that ``write_files`` wrote, or that lie under ``folder`` in others; empty ones are left out.

    The driver lists the top of the folder alone, where every task that wrote has one of its own; tasks list and read these.
    """
    shown = lambda found: not found.base_name.startswith(("_", "."))
    tops = [(i.path, i.type == pafs.FileType.Directory) for i in _tops(folder) if shown(i)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(folder)
        for batch in batches:
            for top, is_folder in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                todo, names, contents, held = [top], [], [], 0
                while todo:
                    at = todo.pop()
                    for found in fs.get_file_info(pafs.FileSelector(at) if is_folder else [at]):
                        if found.type == pafs.FileType.Directory and shown(found):
                            todo.append(found.path)
                        elif found.type == pafs.FileType.File and found.size and shown(found):
                            with fs.open_input_file(found.path) as stream:
                                contents.append(stream.read())
                            names.append(found.base_name)
                            held += found.size
                            if len(names) >= BATCH_FILES or held >= BATCH_BYTES:
                                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["name", "content"])
                                names, contents, held = [], [], 0
                if names:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["name", "content"])

    return dealt(spark.createDataFrame(tops, "path string, is_folder boolean"), "path").mapInArrow(run, "name string, content binary")


def remove_files(spark: SparkSession, folder: str) -> None:
    """Delete a folder that ``write_files`` wrote; tasks delete what lies at its top."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(folder)
        for batch in batches:
            for top, is_folder in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if fs.get_file_info(top).type != pafs.FileType.NotFound:  # a task may run twice
                    (fs.delete_dir if is_folder else fs.delete_file)(top)
            yield batch

    tops = [(i.path, i.type == pafs.FileType.Directory) for i in _tops(folder)]
    dealt(spark.createDataFrame(tops, "path string, is_folder boolean"), "path").mapInArrow(run, "path string, is_folder boolean").count()
    remove(spark, folder)


def in_turns(rows: DataFrame, by: str, write: Callable[[DataFrame, str], None], read: Callable[[str], DataFrame], folder: str) -> DataFrame:
    """What ``read(folder)`` has after ``write(rows, folder)``, where each row becomes a file and equal ``by`` may be equal names.

    No more than about TURN_FILES are there at a time: all rows are written, a share of them after the other, and the
    files of a share are deleted once what was read of them is a table.
    """
    spark = rows.sparkSession
    turns, found = max(1, -(-rows.count() // TURN_FILES)), []
    for turn in range(turns):
        own = f"{folder}-{turn}"
        write(rows.filter(F.pmod(F.xxhash64(by), F.lit(turns)) == turn), own)
        found.append(table(read(own)))
        remove_files(spark, own)
    return spark.read.schema(found[0].schema).parquet(*(f._stored_at for f in found))
