"""CSV files with line breaks inside quoted fields, cut at byte ranges so that one file is read by many tasks.

Spark cuts text files at byte ranges, and a line belongs to the range in which it begins. Whether a line begins inside a quoted field depends on
all quotes before it. The first pass counts the quotes of each range, and running sums of these counts give each
range the parity at its beginning. The second pass puts lines together into records, range by range. Lines of a record that goes on in a later range
are fragments, at most two for each range, and are put together by a shuffle. Records are then taken apart by Spark's own CSV functions.

Quotes stand around whole fields and are doubled inside them; a file whose quotes do not come out even is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import require
from .store import computed_once

#: Ranges whose parities are sent to all tasks, some hundred bytes each: 2^18 ranges of 128 MB are 32 TB. More are read file by file.
MOST_RANGES = 1 << 18
WHOLE, HEAD, TAIL = 0, 1, 2
PIECES = "file string, range long, kind int, first boolean, text string"


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, range (its first byte), value: lines in their order within each range."""
    return spark.read.option("lineSep", "\n").text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), "value")


def quote_parities(lines: DataFrame) -> DataFrame:
    """file, range, odd (whether the range begins inside a quoted field), open (whether it ends in one), returns (whether the file's lines end in a carriage return)."""
    quotes = F.char_length("value") - F.char_length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    counted = lines.groupBy("file", "range").agg(F.sum(quotes).alias("quotes"), F.count("*").alias("n"), F.count(F.when(F.endswith("value", F.lit("\r")), 1)).alias("ended"))
    upto = F.sum("quotes").over(Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, 0))
    total = lambda c: F.sum(c).over(Window.partitionBy("file"))
    # the last line need not end
    returns = (total("ended") > 0) & (total("ended") >= total("n") - 1)
    return counted.select("file", "range", ((upto - F.col("quotes")) % 2 == 1).alias("odd"), (upto % 2 == 1).alias("open"), returns.alias("returns"))


def _pieces(table: pa.Table, begins: bool) -> tuple[list[tuple[int, bool, str]], list[str]]:
    """The records that end in the lines of one range, as (kind, first of the range, text), and the lines of one that does not."""
    values = table["value"].to_pylist()
    quotes = pc.count_substring(table["value"], '"').to_numpy()
    odd_before = (np.cumsum(quotes) - quotes + (0 if begins else 1)) % 2 == 1
    starts = np.flatnonzero(~odd_before).tolist()
    out = []
    if not starts:
        return [], values
    if starts[0]:
        out.append((HEAD, False, "\n".join(values[: starts[0]])))
    for low, high in zip(starts, starts[1:], strict=False):
        out.append((WHOLE, low == 0, values[low] if high == low + 1 else "\n".join(values[low:high])))
    return out, values[starts[-1] :]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of lines (file, range, odd, value) to pieces. Lines of a range stand together."""
    schema = pa.schema([("file", pa.string()), ("range", pa.int64()), ("kind", pa.int32()), ("first", pa.bool_()), ("text", pa.string())])

    def made(file: str, start: int, pieces: list) -> pa.RecordBatch:
        kinds, firsts, texts = zip(*pieces, strict=True)
        return pa.record_batch([pa.array([file] * len(pieces)), pa.array([start] * len(pieces)), pa.array(kinds, pa.int32()), pa.array(firsts), pa.array(texts, pa.string())], schema=schema)

    here, rest, inside, head, fresh = None, [], False, False, True

    def flushed() -> Iterator[pa.RecordBatch]:
        # what is left at the end of a range is whole if its quotes are even, else a fragment; lines before any start go on from an earlier range
        if here is None or not rest:
            return
        text = "\n".join(rest)
        kind = HEAD if head else (TAIL if text.count('"') % 2 else WHOLE)
        yield made(*here, [(kind, fresh and not head, text)])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        files, ranges = table["file"].to_pylist(), table["range"].to_numpy()
        cuts = [0, *(k for k in range(1, len(files)) if ranges[k] != ranges[k - 1] or files[k] != files[k - 1]), len(files)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if low == high:
                continue
            if (files[low], int(ranges[low])) != here:
                yield from flushed()
                here, rest, fresh = (files[low], int(ranges[low])), [], True
                head = bool(table["odd"][low].as_py())
            lines = table.slice(low, high - low).select(["value"])
            if rest:
                lines = pa.concat_tables([pa.table({"value": pa.array(rest, pa.string())}), lines])
            pieces, rest = _pieces(lines, not head)
            if pieces:
                pieces = [(k, f and fresh, t) for k, f, t in pieces]
                head, fresh = False, False
                yield made(*here, pieces)
    yield from flushed()


def records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, first (of its file), text: the records of CSV files as text, blank ones left out."""
    lines = _lines(spark, paths)
    parities = computed_once(quote_parities(lines))
    n, uneven = parities.count(), parities.withColumn("last", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("range")))).where("last = 1 and open").limit(1).collect()
    require(not uneven, f"{uneven and uneven[0]['file']} ends inside a quoted field")
    if n > MOST_RANGES and len(paths) > 1:
        half = len(paths) // 2
        return records(spark, paths[:half]).unionByName(records(spark, paths[half:]))
    known = parities.select("file", "range", "odd", "returns")
    value = F.when(F.col("returns"), F.regexp_replace("value", "\r\\z", "")).otherwise(F.col("value")).alias("value")
    pieces = lines.join(F.broadcast(known) if n <= MOST_RANGES else known, ["file", "range"]).select("file", "range", "odd", value).mapInArrow(_joined, PIECES)
    begins = F.sum((F.col("kind") == TAIL).cast("int")).over(Window.partitionBy("file").orderBy("range", "kind"))
    cut = pieces.where(F.col("kind") != WHOLE).withColumn("record", begins)
    order = F.sort_array(F.collect_list(F.struct("range", "kind", "text")))
    mended = cut.groupBy("file", "record").agg(F.max(F.col("first") & (F.col("range") == 0)).alias("first"), F.array_join(F.transform(order, lambda p: p["text"]), "\n").alias("text"))
    whole = pieces.where(F.col("kind") == WHOLE).select("file", (F.col("first") & (F.col("range") == 0)).alias("first"), "text")
    both = whole.unionByName(mended.select("file", "first", "text"))
    return both.withColumn("text", F.regexp_replace("text", "\r\\z", "")).where("text <> ''")


def read_csv(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    """The records of files that begin with a header, as columns of text."""
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    parsed = F.from_csv("text", F.lit(schema), {"quote": '"', "escape": '"', "multiLine": "true"})
    return records(spark, paths).where("not first").select(parsed.alias("r")).select("r.*")
