"""A stream of count files that keeps a table of publications up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.papers import upsert
from ..schemas import KEYS, PUBLICATIONS


def follow_counts(spark: SparkSession, drops: str, table: str, checkpoint: str, as_of: str) -> StreamingQuery:
    """Upserts every CSV drop (source, query, period, count) into versions of a table; drops that come again change nothing.

    Each batch writes version n + 1 from version n, so that a batch that is run again after a failure writes the same.
    """
    found = spark.readStream.schema(PUBLICATIONS).option("header", True).csv(drops)

    def apply(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        empty = own.createDataFrame([], PUBLICATIONS)
        before = own.read.schema(PUBLICATIONS).parquet(f"{table}/{number - 1}") if number else empty
        newest = batch.groupBy(*KEYS["publications"]).agg(F.max("count").alias("count")).select(*PUBLICATIONS.fieldNames())
        upsert(before, newest, KEYS["publications"], F.lit(as_of).cast("date")).write.mode("overwrite").parquet(f"{table}/{number}")

    return found.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply).trigger(availableNow=True).start()
