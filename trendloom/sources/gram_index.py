"""A sidecar for a table of texts: for each file a Bloom filter of the runs of three signs that its texts hold.

A search for a part of a text ('%word%') reads only the files whose filter has all of the word's runs. Filters can be wrong in one way only: a file
may be read in vain. Files that the sidecar does not know are always read.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import escaped_like

#: Bits of a file's filter (128 KB), bits set for each run, and signs of a run.
BITS, HASHES, SIGNS = 1 << 20, 2, 3
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def bits_of(text: str, size: int = BITS) -> np.ndarray:
    """The places of the bits that a text's runs set."""
    signs = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(signs) < SIGNS:
        return np.zeros(0, np.int64)
    h = sum(signs[k : len(signs) - SIGNS + 1 + k] * _MIX[k] for k in range(SIGNS))
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return np.unique(np.concatenate([(h >> np.uint64(32 * k)) % np.uint64(size) for k in range(HASHES)])).astype(np.int64)


def build(spark: SparkSession, table: str, column: str, sidecar: str, size: int = BITS) -> None:
    """Writes file, bits for each file of a Parquet table. A task has one filter in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, np.zeros(size, np.uint8)
        for batch in batches:
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if file != here:
                    if here is not None:
                        yield pa.record_batch([pa.array([here]), pa.array([np.packbits(held).tobytes()])], ["file", "bits"])
                    here, held = file, np.zeros(size, np.uint8)
                held[bits_of(text.as_py() or "", size)] = 1
        if here is not None:
            yield pa.record_batch([pa.array([here]), pa.array([np.packbits(held).tobytes()])], ["file", "bits"])

    def merged(parts: pa.Table) -> pa.Table:
        bits = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in parts["bits"].to_pylist()])
        return pa.table({"file": parts["file"].slice(0, 1), "bits": [bits.tobytes()]})

    texts = spark.read.parquet(table).select(F.col("_metadata.file_path").alias("file"), F.lower(F.col(column)).alias("text"))
    texts.mapInArrow(run, "file string, bits binary").groupBy("file").applyInArrow(merged, "file string, bits binary").write.mode("overwrite").parquet(sidecar)


def files_to_read(spark: SparkSession, table: str, sidecar: str, word: str, size: int = BITS) -> tuple[list[str], int]:
    """The files of the table that may hold the word in any case, and how many are left out."""
    lower = spark.range(1).select(F.lower(F.lit(word))).first()[0]
    known = spark.read.parquet(sidecar)
    held = F.lit(True)
    for at in bits_of(lower, size).tolist():
        byte = F.conv(F.hex(F.substring(F.col("bits"), at // 8 + 1, 1)), 16, 10).cast("int")
        held = held & (byte.bitwiseAND(F.lit(128 >> at % 8)) != 0)
    without = {r["file"] for r in known.where(~held).select("file").collect()}
    # Spark names files by URIs, of which inputFiles and file_path may write the scheme differently
    plain = lambda f: unquote(f.split(":", 1)[-1]).lstrip("/")
    out = {plain(f) for f in without}
    everything = spark.read.parquet(table).inputFiles()
    return [unquote(f) for f in everything if plain(f) not in out], sum(plain(f) in out for f in everything)


def holding(spark: SparkSession, table: str, sidecar: str, column: str, word: str, size: int = BITS) -> DataFrame:
    """The rows of the table whose column holds the word in any case, from the files that may have some."""
    whole = spark.read.parquet(table)
    files, _ = files_to_read(spark, table, sidecar, word, size)
    rows = spark.read.schema(whole.schema).parquet(*files) if files else spark.createDataFrame([], whole.schema)
    return rows.where(F.col(column).ilike(escaped_like(word)))
