"""What several operators share: tables in the cluster's shared folder and joins that stand a hot key."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that hold at least this share of all rows count as hot. There can be no more than HOT_KEYS of them.
HOT_KEYS = 1 << 14


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a temporary folder serves a session whose executors are threads of the driver; on a
    cluster it is an error, as executors would not see each other's files.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="trendloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is not None:
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables written below the shared folder.

    A written table cuts the lineage and outlives the executors that wrote it. ``close`` deletes the tables
    of this scratch. What ``kept`` gives is a result: a checkpoint, which Spark's cleaner deletes once nothing refers to it
    (where spark.cleaner.referenceTracking.cleanCheckpoints is on, as for any checkpoint).
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = spark, f"{shared_folder(spark)}/trendloom-{uuid.uuid4().hex}", 0

    def save(self, df: DataFrame, compression: str = "snappy") -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.option("compression", compression).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def kept(self, df: DataFrame) -> DataFrame:
        return df.checkpoint()

    def close(self) -> None:
        _delete(self.spark, self.path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def hot_join(left: DataFrame, right: DataFrame, key: str, count: str, total: int, most: int = HOT_KEYS) -> DataFrame:
    """Inner join of left with right, where right has one row per key and ``count`` says how many left rows have it.

    Keys with at least total / most rows are joined by broadcast: as the counts add up to ``total``
    at most, there are at most ``most`` such keys at any size of the input. All others are shuffled, and
    none of those can fill a task. The columns of right but ``key`` must not be in left.
    """
    least = max(2, -(-total // most))
    hot, cold = right.where(F.col(count) >= least), right.where(F.col(count) < least)
    return (
        left.join(F.broadcast(hot), key)
        .unionByName(left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key).select(*left.columns, *[c for c in right.columns if c != key]))
        .select(*left.columns, *[c for c in right.columns if c != key])
    )


#: Rows of a table that may be broadcast, a few dozen bytes each.
FEW_ROWS = 1 << 18


def maybe_broadcast(table: DataFrame) -> DataFrame:
    """A written table of narrow rows, marked for broadcast if it has few; larger ones are left to a shuffle."""
    return F.broadcast(table) if table.count() <= FEW_ROWS else table


def crc32_of_id(column: str = "doc_id"):
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def content_hash(docs: DataFrame):
    """A hash of all columns of a row, which settles ties between rows of equal id and text."""
    plain = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map" in f.dataType.simpleString() or "variant" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema]
    return F.xxhash64(*plain)


def whole_row(docs: DataFrame):
    """All columns of docs as one, so that columns put beside it cannot clash with theirs; unpacked by ``row.*``."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


#: Bits of a map of hashes for each hash, and at most: 16 MB.
BITS_EACH, MOST_BITS, MAP_BLOCK = 128, 1 << 27, 1 << 15


def bit_map(hashes: DataFrame) -> np.ndarray:
    """A map, as packed bits, that has a bit set for each value of the one column (long) of hashes.

    Values whose bit is not set are surely not in the column, so that the map can thin out what is shuffled for an exact
    join. Its size follows the number of values (about one bit in BITS_EACH is set) up to MOST_BITS; from a million values
    on it thins out less and less, and the join that follows does the rest.
    """
    (column,) = hashes.columns
    size = min(MOST_BITS, max(MAP_BLOCK, 1 << (BITS_EACH * hashes.count() - 1).bit_length()))
    bit = F.col(column).bitwiseAND(F.lit(size - 1))
    bits = hashes.select(bit.alias("bit")).distinct().withColumn("block", F.floor(F.col("bit") / MAP_BLOCK).cast("long"))

    def pack(table: pa.Table) -> pa.Table:
        held = np.zeros(MAP_BLOCK, np.uint8)
        held[table["bit"].to_numpy() % MAP_BLOCK] = 1
        return pa.table({"block": table["block"].slice(0, 1), "bits": [np.packbits(held).tobytes()]})

    out = np.zeros((size // MAP_BLOCK, MAP_BLOCK // 8), np.uint8)
    for row in bits.groupBy("block").applyInArrow(pack, "block long, bits binary").collect():
        out[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def in_map(held: np.ndarray, values: np.ndarray) -> np.ndarray:
    bit = values.astype(np.int64) & np.int64(8 * len(held) - 1)
    return held[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1 == 1
