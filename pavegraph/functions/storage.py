"""Where intermediate tables go: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a folder of our own where that is unset and all tasks run on this machine."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if folder is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="pavegraph-"))
    return folder or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and drop its lineage; lost executors cost nothing before it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame) -> DataFrame:
    """Like ``cut``, as a Parquet table: compressed, and without what the optimizer had inferred of the old plan.

    A checkpoint keeps its plan's constraints; in a loop they multiply with every alias, and planning never ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


#: Rows that one task gets at most, about, of those that were counted.
TASK_ROWS = 500_000


def dealt(df: DataFrame, *by: str, rows: int = 0) -> DataFrame:
    """``df`` dealt out over all cores, by columns or evenly, however few bytes it has: a small file may be a lot of work.

    The number of ``rows``, where it is known, makes for as many tasks as keep what one has to sort bounded.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism, rows // TASK_ROWS)
    return df.repartition(tasks, *by)


def discard(*tables: DataFrame) -> None:
    """Delete what ``table`` wrote, once nothing that is still to run reads it."""
    for df in tables:
        if path := getattr(df, "_stored_at", None):
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours in whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
