"""Relations that are built once: a manifest tells what they were built from, and they are built again if that has changed.

A relation is written whole into a folder of its own; then its manifest takes the place of the one before by a rename. So
readers see the old relation or the new one, and a build that fails or runs twice does no harm.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.storage import remove


@dataclass(frozen=True)
class Cached:
    """A relation with whether it was there already."""

    rows: DataFrame
    reused: bool


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def fingerprint(*inputs: DataFrame, **parameters: object) -> str:
    """A digest of the files that ``inputs`` read (path, length, time) and of the parameters, whatever their order."""
    facts = []
    for df in inputs:
        for path in df.inputFiles():
            where, fs = _at(df.sparkSession, path)
            status = fs.getFileStatus(where)
            facts.append(f"{path}\t{status.getLen()}\t{status.getModificationTime()}")
    return hashlib.sha256(json.dumps([sorted(facts), parameters], sort_keys=True, default=repr).encode()).hexdigest()


def _manifest(spark: SparkSession, folder: str) -> dict | None:
    where, fs = _at(spark, f"{folder}/manifest.json")
    if not fs.exists(where):
        return None
    return json.loads("".join(r.value for r in spark.read.text(str(where)).collect()))  # one short line


def _publish(spark: SparkSession, folder: str, manifest: dict) -> None:
    new, fs = _at(spark, f"{folder}/manifest-{uuid.uuid4().hex}.tmp")
    out = fs.create(new)
    try:
        out.write(bytearray(json.dumps(manifest).encode()))
    finally:
        out.close()
    final, _ = _at(spark, f"{folder}/manifest.json")
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark._jsparkSession.sessionState().newHadoopConf())
    overwrite = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(overwrite, 1)
    how[0] = overwrite.OVERWRITE
    context.rename(new, final, how)


def cached(spark: SparkSession, folder: str, key: str, build: Callable[[], DataFrame], keep_old: bool = False) -> Cached:
    """The relation under ``folder`` if its manifest has ``key``; else ``build()``, written and published under that key.

    The relation before is deleted then, unless ``keep_old``. A relation whose folder has gone is built again.
    """
    folder = folder.rstrip("/")
    before = _manifest(spark, folder)
    if before and before["key"] == key:
        where, fs = _at(spark, before["path"])
        if fs.exists(where):
            return Cached(spark.read.parquet(before["path"]), True)
    path = f"{folder}/rows-{uuid.uuid4().hex}.parquet"
    build().write.parquet(path)
    _publish(spark, folder, {"key": key, "path": path})
    if before and not keep_old and before["path"] != path:
        remove(spark, before["path"])
    return Cached(spark.read.parquet(path), False)
