"""A table of months whose upserts write anew only the months that they touch.

The table is a folder of versions and a log of commits (see commits). A state says for each month which version's folder holds it; a month
that an upsert does not touch keeps its files, and readers of the state before keep theirs. Upserts that run at once are repeated by all but one.
"""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.papers import upsert
from ..schemas import require
from .commits import Conflict, commit, delete, last, retried, state_of

#: Months of one upsert: one for each month of 8,000 years. They come to the driver.
MOST_MONTHS = 12 * 8000


def _state(spark: SparkSession, target: str, number: int) -> dict:
    return state_of(spark, target, number) if number else {"version": "", "parts": {}}


def _read(spark: SparkSession, target: str, parts: dict[str, str], schema: StructType) -> DataFrame:
    paths = [f"{target}/{folder}/month={month}" for month, folder in sorted(parts.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_periods(spark: SparkSession, target: str, schema: StructType, first: str | None = None, last_month: str | None = None) -> DataFrame:
    """The current rows; with a range of months (yyyy-MM-dd, inclusive) only the folders of these are listed and read."""
    parts = _state(spark, target, last(spark, target))["parts"]
    return _read(spark, target, {m: f for m, f in parts.items() if (first is None or m >= first) and (last_month is None or m <= last_month)}, schema)


def upsert_periods(spark: SparkSession, target: str, incoming: DataFrame, keys: list[str], as_of: date | str, schema: StructType) -> list[str]:
    """Puts incoming (with a column period, the first of a month) into the table by keys, which hold period; gives the months written.

    As papers.upsert: of rows of one key those of incoming stay, months after that of as_of go, old ones too. What is read, shuffled
    and written is the months that incoming has, not the table.
    """
    require("period" in keys, "the keys must hold the period")
    limit = f"{date.fromisoformat(str(as_of)).replace(day=1)}"
    written: list[str] = []

    def attempt() -> int:
        number = last(spark, target)
        parts = {m: f for m, f in _state(spark, target, number)["parts"].items() if m <= limit}
        months = [str(r[0]) for r in incoming.where(F.col("period") <= F.lit(limit).cast("date")).select("period").distinct().limit(MOST_MONTHS + 1).collect()]
        require(len(months) <= MOST_MONTHS, f"{len(months)} months in one upsert")
        version = uuid.uuid4().hex
        if months:
            before = _read(spark, target, {m: parts[m] for m in months if m in parts}, schema)
            merged = upsert(before, incoming, keys, F.lit(limit).cast("date"))
            # a folder for each month; small months come together and large ones are split before they are written
            named = merged.select(*schema.fieldNames(), F.col("period").cast("string").alias("month"))
            named.hint("rebalance", "month").write.partitionBy("month").option("maxRecordsPerFile", 1 << 22).parquet(f"{target}/{version}")
        try:
            number = commit(spark, target, {"version": version, "parts": parts | dict.fromkeys(months, version)}, expected=number)
        except Conflict:
            delete(spark, f"{target}/{version}")
            raise
        written[:] = sorted(months)
        return number

    retried(attempt)
    return written
