"""Tables that are computed once and read several times, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import require
from .commits import delete

#: Keys with at least this share of all rows are joined by broadcast; as shares add up to 1, there are no more of them than this.
HOT_KEYS = 1 << 14


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset it is a temporary folder, which only a session in one process can use."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        require(context.master.split("[")[0] == "local", "set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="trendloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def computed_once(df: DataFrame) -> DataFrame:
    """df as a checkpoint: what reads it does not compute it again, and lost executors do not take it with them.

    Spark's cleaner deletes it once nothing refers to it (where spark.cleaner.referenceTracking.cleanCheckpoints is on).
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """df in at least as many partitions as there are cores, for few rows that take long: Spark joins small partitions, or reads a small file in one task, by their bytes alone."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *columns)


@contextmanager
def passing_folder(spark: SparkSession) -> Iterator[str]:
    """A new folder below the shared one, deleted at the end: what is read from it must be computed before."""
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        delete(spark, path)


def sized_join(left: DataFrame, right: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of left with the one row that right has for a key; ``count`` says how many rows of left have it, ``total`` how many there are.

    Keys that hold a sizable share of all rows are joined by broadcast, so that none of those that are shuffled fills a task.
    """
    least = max(2, -(-total // HOT_KEYS))
    hot, cold = right.where(F.col(count) >= least), right.where(F.col(count) < least)
    few = F.broadcast(hot)
    return left.join(few, key).unionByName(left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))
