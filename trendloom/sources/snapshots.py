"""Snapshots kept by month of capture, with each source's last day in the commit log, so that its last snapshot is one month's folder."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schemas import require
from .commits import Conflict, commit, current, delete, last, retried, state_of

#: Pairs of a source and a month in one batch; they come to the driver, as the log names them.
MOST_PAIRS = 1 << 18


def add_snapshots(spark: SparkSession, target: str, rows: DataFrame) -> list[str]:
    """Adds rows (source, captured_at, ..) to the table below target; gives their months. Folders of other months are not touched.

    A month is held by the folders of all batches that brought rows of it. A batch that is added twice is in the table twice.
    """
    version = uuid.uuid4().hex
    month = F.date_format(F.trunc("captured_at", "MM"), "yyyy-MM-dd")
    kept = rows.where("captured_at is not null and source is not null").withColumn("month", month)
    kept.hint("rebalance", "month").write.partitionBy("month").option("maxRecordsPerFile", 1 << 22).parquet(f"{target}/{version}")
    found = spark.read.schema(kept.schema).parquet(f"{target}/{version}").groupBy("source", F.col("month").cast("string").alias("month")).agg(F.to_date(F.max("captured_at")).alias("day")).limit(MOST_PAIRS + 1).collect()
    require(len(found) <= MOST_PAIRS, "too many sources and months in one batch")
    latest: dict[str, str] = {}
    for r in found:
        latest[r["source"]] = max(str(r["day"]), latest.get(r["source"], ""))
    months = sorted({r["month"] for r in found})

    def attempt() -> int:
        number = last(spark, target)
        state = state_of(spark, target, number) if number else {"batches": {}, "latest": {}}
        batches = state["batches"] | {m: [*state["batches"].get(m, []), version] for m in months}
        days = state["latest"] | {s: max(d, state["latest"].get(s, "")) for s, d in latest.items()}
        folders = {v: v for held in batches.values() for v in held}
        return commit(spark, target, {"version": version, "parts": folders, "batches": batches, "latest": days, "schema": rows.schema.json()}, expected=number)

    try:
        retried(attempt)
    except Conflict:
        delete(spark, f"{target}/{version}")
        raise
    return months


def read_snapshots(spark: SparkSession, target: str, first: str = "", last_month: str = "9999") -> DataFrame:
    """The rows of a range of months (yyyy-MM-dd, inclusive); other months are neither listed nor read."""
    state = current(spark, target)
    schema = StructType.fromJson(json.loads(state["schema"]))
    paths = [f"{target}/{v}/month={m}" for m, held in sorted(state["batches"].items()) if first <= m <= last_month for v in held]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def last_snapshot(spark: SparkSession, target: str, source: str) -> DataFrame:
    """A source's rows of its last day of capture, which the commit log names: one month is read, no maximum is looked for."""
    day = current(spark, target)["latest"].get(source)
    month = f"{day[:7]}-01" if day else "none"
    return read_snapshots(spark, target, month, month).where((F.col("source") == source) & (F.to_date("captured_at") == F.lit(day).cast("date")))
