"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import cut, discard, remove, shared_dir, table

__all__ = ["blocks_for", "cut", "discard", "numbered", "read", "remove", "shared_dir", "small_batches", "table", "text_of", "without"]


#: Rows that a task hands to Python at once; whole texts may be long, and both sides hold a batch.
BATCH_ROWS = 1_000
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Have texts go to Python in batches of at most BATCH_ROWS from now on; a smaller setting stays."""
    now = int(spark.conf.get(BATCH_CONF, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def blocks_for(n_rows: int, rows_per_block: int) -> int:
    return max(8, -(-n_rows // rows_per_block))


#: Rows that are broadcast to drop them from a table, after counting; more of them are joined by shuffle.
BROADCAST_DROPS = 1_000_000


def without(rows: DataFrame, drop: DataFrame, key: str) -> DataFrame:
    """``rows`` but for those whose ``key`` is in ``drop`` (one column); a null key is in no such list. Any other columns may be there."""
    name = "drop"
    while name in map(str.lower, rows.columns):
        name += "_"
    drop = cut(drop.toDF(name))
    small = drop.count() <= BROADCAST_DROPS
    return rows.join(F.broadcast(drop) if small else drop, rows[key] == drop[name], "left_anti")


def numbered(docs: DataFrame) -> DataFrame:
    """(uid, row): the rows of ``docs`` whole, each with a number of its own, written so that the number stays."""
    return table(docs.select(F.monotonically_increasing_id().alias("uid"), F.struct("*").alias("row")))
