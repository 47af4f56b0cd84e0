"""Publication counts: growth multiples, upserts, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def growth(counts: DataFrame, by: list[str], early: tuple[str, str], recent: tuple[str, str], scale: int | None = None) -> DataFrame:
    """avg_early, avg_recent and growth for each group, in one pass; ranges of months are inclusive.

    With a scale the averages are rounded first and a zero makes growth null; without one growth is 0 for a zero base.
    """
    within = lambda r: F.col("period").between(F.lit(r[0]).cast("date"), F.lit(r[1]).cast("date"))
    sides = {"avg_early": early, "avg_recent": recent}
    means = [F.avg(F.when(within(r), F.col("count"))).alias(c) for c, r in sides.items()]
    out = counts.groupBy(*by).agg(*means, F.min("period").alias("first_month"), F.max("period").alias("last_month"), F.count("*").alias("n_months"))
    ratio = F.try_divide(F.col("avg_recent"), F.col("avg_early"))
    if scale is None:
        return out.withColumn("growth", F.when(F.col("avg_early") == 0, 0.0).otherwise(ratio))
    out = out.withColumns({c: F.round(c, scale) for c in sides})
    return out.withColumn("growth", F.when((F.col("avg_early") != 0) & (F.col("avg_recent") != 0), F.round(ratio, 2)))


def ratio_usable(base: Column, least: float = 5.0) -> Column:
    """A multiple of a base below ``least`` a month is not to be quoted."""
    return F.coalesce(base >= least, F.lit(False))


def context_filtered(query: Column) -> Column:
    return F.endswith(query, F.lit(" (skin)"))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], as_of: Column) -> DataFrame:
    """Rows of both, those of incoming where keys meet; periods after as_of's month go, also old ones.

    Keys are unique within a batch; of repeated ones in incoming the largest remaining columns stay.
    """
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    rest = [c for c in existing.columns if c not in keys]
    newest = Window.partitionBy(*keys).orderBy(F.desc("_new"), *[F.desc(c) for c in rest])
    return both.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n", "_new").where(F.col("period") <= F.trunc(as_of, "MM"))


def insert_new(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """existing and the rows of incoming whose key it lacks, one for each key."""
    return existing.unionByName(incoming.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti"))


def coverage(counts: DataFrame) -> DataFrame:
    return counts.groupBy("source").agg(F.countDistinct("query").alias("n_queries"), F.count("*").alias("n_rows"), F.min("period").alias("first_month"), F.max("period").alias("last_month"))
