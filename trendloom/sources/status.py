"""Counts and ranges of days of stored tables, taken from the footers of their Parquet files where these hold them."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of columns whose least and largest values Spark takes from footers.
IN_FOOTERS = {"date", "int", "bigint", "smallint", "tinyint", "float", "double", "boolean"}


@contextmanager
def _footers(spark: SparkSession) -> Iterator[None]:
    """Aggregates of whole Parquet tables are answered by the scan; the settings hold for plans made within."""
    settings = {"spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text", "spark.sql.parquet.aggregatePushdown": "true"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def footer_aggregate(spark: SparkSession, path: str, column: str | None) -> DataFrame:
    """n, and lo and hi of the column, of a stored table. Plan and run it within the settings above; see stored_status."""
    table = spark.read.parquet(path)
    ends = [F.min(column).alias("lo"), F.max(column).alias("hi")] if column else []
    return table.agg(F.count("*").alias("n"), *ends)


def stored_status(spark: SparkSession, path: str, column: str | None = None) -> tuple[int, object, object]:
    """Number of rows, and the first and last day of the column (date or timestamp); null where there is no column.

    Rows are counted, and dates compared, by footers alone: no page is read. Footers do not order timestamps, so that of these the one column is read.
    """
    ordered = column is None or spark.read.parquet(path).schema[column].dataType.simpleString() in IN_FOOTERS
    with _footers(spark):
        n, *ends = footer_aggregate(spark, path, column if ordered else None).first()
    if not ordered:
        ends = spark.read.parquet(path).agg(F.to_date(F.min(column)), F.to_date(F.max(column))).first()
    return (n, *(ends or (None, None)))
