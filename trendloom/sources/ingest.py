"""All-or-nothing ingest of a snapshot: files are checked, staged and counted, and only then does the pointer move."""

from __future__ import annotations

import uuid

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from ..schemas import require
from .commits import commit, exists
from .csv_blocks import read_csv
from .files import header_of

# The tables of a snapshot, in the order in which they are loaded.
TABLES = ["rank_snapshot", "price_point", "product", "new_product", "review", "review_topic", "review_answer", "review_stats", "review_summary", "run", "run_source", "fetch_log"]
MARKER = "FREEZE.txt"


def ingest(spark: SparkSession, source: str, target: str, tables: list[str] | None = None) -> dict[str, int]:
    """Loads source/<table>.csv into a new version below target; gives the rows of each table.

    A missing file or a count that differs after writing raises an error and leaves the current version as it is. Each file is read by
    as many tasks as it has ranges, and its records are counted as they are written. Several ingests may run at once: each commits a whole version,
    and the last one is current. What a failed one has left goes with commits.clean_up.
    """
    names = tables or TABLES
    missing = [n for n in names if not exists(spark, f"{source}/{n}.csv")]
    require(not missing, f"missing files: {missing}")
    frozen = "".join(r["value"] for r in spark.read.text(f"{source}/{MARKER}").limit(1).collect()).strip() if exists(spark, f"{source}/{MARKER}") else None
    version, counts = uuid.uuid4().hex, {}
    for name in names:
        path, seen = f"{source}/{name}.csv", Observation()
        rows = read_csv(spark, [path], header_of(spark, path)).observe(seen, F.count(F.lit(1)).alias("n"))
        rows.withColumn("frozen_at", F.lit(frozen).cast("string")).write.parquet(f"{target}/{version}/{name}")
        counts[name] = seen.get["n"]
        written = spark.read.parquet(f"{target}/{version}/{name}").count()
        require(written == counts[name], f"{name}: {written} rows written, {counts[name]} in the file")
    commit(spark, target, {"version": version, "frozen_at": frozen, "rows": counts})
    return counts
