"""Self-joins of crowded keys in blocks of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import computed_once, sized_join

#: Rows of one key that are joined in one block; more of them are sliced.
SLICE = 1 << 10


def slices(entries: DataFrame, key: str = "key", slice_size: int = SLICE) -> tuple[DataFrame, DataFrame]:
    """entries (key, id, ..) with block columns i and j, once as left and once as right, of keys that two rows or more have.

    A key's rows are dealt to slices by a hash of their id. Slices i <= j meet in the block (i, j): on the left a row stands for i, on the right
    for j. No block has more than about two slices of rows, and every two rows of a key are in one block.
    """
    entries = computed_once(entries)
    sizes = computed_once(entries.groupBy(key).agg(F.count("*").alias("n")).where("n > 1"))
    sized = sized_join(entries, sizes, key, "n", sizes.agg(F.sum("n")).first()[0] or 0)
    number = F.ceil(F.col("n") / slice_size).cast("int")
    own = sized.withColumn("of", number).withColumn("own", F.pmod(F.xxhash64("id"), F.col("of")).cast("int"))
    left = own.select(*entries.columns, F.col("own").alias("i"), F.explode(F.sequence(F.col("own"), F.col("of") - 1)).alias("j"))
    right = own.select(*entries.columns, F.explode(F.sequence(F.lit(0), F.col("own"))).alias("i"), F.col("own").alias("j"))
    return left, right


def pairs_within(entries: DataFrame, key: str = "key", slice_size: int = SLICE) -> DataFrame:
    """key, and all other columns of entries (key, id, ..) as <column>_a and <column>_b, for each two rows of one key with different ids, once."""
    left, right = slices(entries, key, slice_size)
    rest = [c for c in entries.columns if c != key]
    side = lambda df, s: df.select(key, "i", "j", *[F.col(c).alias(f"{c}_{s}") for c in rest])
    met = side(left, "a").join(side(right, "b"), [key, "i", "j"])
    return met.where((F.col("id_a") != F.col("id_b")) & ((F.col("i") < F.col("j")) | (F.col("id_a") < F.col("id_b")))).drop("i", "j")
