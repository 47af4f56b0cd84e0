"""Schemas of the tables, and checks of their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PUBLICATIONS = T.StructType([T.StructField("source", T.StringType(), False), T.StructField("query", T.StringType(), False), T.StructField("period", T.DateType(), False), T.StructField("count", T.IntegerType(), False)])
SKU = T.StructType([T.StructField("source", T.StringType(), False), T.StructField("product_key", T.StringType(), False), T.StructField("name", T.StringType()), T.StructField("product_line_id", T.LongType())])
LISTING = T.StructType([T.StructField("source", T.StringType(), False), T.StructField("product_key", T.StringType(), False), T.StructField("name", T.StringType())])
LISTING_VARIANT = T.StructType([T.StructField("source", T.StringType(), False), T.StructField("product_key", T.StringType(), False), T.StructField("position", T.IntegerType(), False), T.StructField("variant", T.StringType(), False)])
LISTING_CONTAINS = T.StructType([T.StructField(c, T.StringType(), False) for c in ("listing_source", "listing_key", "sku_source", "sku_key", "provenance")])
#: Stays empty: no matcher so far is precise enough to hand out line ids that cannot be taken back.
PRODUCT_LINE = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("brand", T.StringType()), T.StructField("name", T.StringType())])
COUNT_FILE = T.StructType([T.StructField("period", T.StringType()), T.StructField("count", T.IntegerType())])

KEYS = {"publications": ["source", "query", "period"], "sku": ["source", "product_key"], "listing": ["source", "product_key"], "listing_variant": ["source", "product_key", "position"]}


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that more than one row has."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Rows of child whose key is not in parent; keys maps child columns to parent columns."""
    return child.join(parent.select(*[F.col(p).alias(c) for c, p in keys.items()]), list(keys), "left_anti")


def require(good: bool, message: str) -> None:
    if not good:
        raise ValueError(message)
