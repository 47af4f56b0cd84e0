"""Connected components of an edge table by alternating large and small stars, all joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hot_join


def _stars(edges: DataFrame, scratch: Scratch, large: bool) -> DataFrame:
    """edges: a > b. Large: each node points its larger neighbours to the least node around it. Small: its smaller ones, and itself."""
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
    if large:
        ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    least = scratch.save(ends.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("to"), F.count("*").alias("degree")))
    joined = hot_join(ends, least, "node", "degree", edges.count() * (1 + large))
    out = joined.where(F.col("other") > F.col("node") if large else F.col("other") != F.col("to")).select(F.col("other").alias("a"), F.col("to").alias("b"))
    if not large:
        out = out.unionByName(least.select(F.col("node").alias("a"), F.col("to").alias("b")))
    return scratch.save(out.where("a <> b").distinct())


def _downward(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def one_round(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (a > b) with the same components as edges (a, b; long), most of them already stars."""
    return _stars(_stars(scratch.save(_downward(edges)), scratch, True), scratch, False)


def _tangled(edges: DataFrame) -> bool:
    """Whether some node has two parents, or a parent and a child."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select("b", F.lit(0), F.lit(1)).toDF("node", "up", "down"))
    return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (its least node) for every node of edges (a, b; long) that is not itself the least."""
    now = scratch.save(_downward(edges))
    while _tangled(now):
        now = _stars(_stars(now, scratch, True), scratch, False)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
