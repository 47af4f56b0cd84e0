"""Pairs of rows of one brand and two sources whose vectors are closest: inverted lists for a first answer, blocks for the exact one.

The index deals every vector to the lists of its NEAREST centroids out of LISTS, which are fitted on a bounded sample (SAMPLE rows).
Rows that share a brand and a list are compared; the closest pairs among them are the answer of the index, whose recall can be measured. The least
cosine of that answer is a floor for the exact one: in a second pass slices of each brand are multiplied with each other, a matrix product
in each task, and only pairs at or above the floor leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import computed_once
from .blocks import SLICE, slices

LISTS, NEAREST, SAMPLE, ROUNDS = 64, 4, 1 << 14, 6
PAIR = ["source_a", "key_a", "source_b", "key_b"]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as rows of length 1; those without length stay 0."""
    flat = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) and column.num_chunks else column
    if len(flat) and not flat.null_count and isinstance(flat, pa.Array):
        rows = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    else:
        rows = np.array(column.to_pylist(), np.float64)
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def centroids(vectors: DataFrame, lists: int = LISTS, sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """Directions of the lists, by a few rounds of spherical k-means over at most ``sample`` rows, which come to the driver."""
    one_in = max(1, vectors.count() // sample)
    drawn = vectors.where(F.pmod(F.xxhash64("id"), F.lit(one_in)) == 0).select("vector").limit(sample).toArrow()
    if not drawn.num_rows:
        return np.zeros((0, 0))
    rows = _matrix(drawn["vector"])
    found = rows[np.linspace(0, len(rows) - 1, min(lists, len(rows))).astype(int)]
    for _ in range(rounds):
        nearest = (rows @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, nearest, rows)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        found = np.where(length > 0, sums / np.where(length > 0, length, 1.0), found)
    return found


def listed(vectors: DataFrame, at: np.ndarray, nearest: int = NEAREST) -> DataFrame:
    """id, brand, source, product_key, vector and list: every vector (id, brand, source, product_key, vector) once for each of its lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = _matrix(batch.column(4))
                near = np.argsort(-(rows @ at.T), axis=1, kind="stable")[:, :nearest]
                taken = batch.take(pa.array(np.repeat(np.arange(len(rows)), near.shape[1])))
                yield pa.record_batch([*taken.columns, pa.array(near.ravel(), pa.int32())], [*batch.schema.names, "list"])

    rows = vectors.select("id", "brand", "source", "product_key", F.col("vector").cast("array<double>").alias("vector"))
    return rows.mapInArrow(run, "id long, brand string, source string, product_key string, vector array<double>, list int")


def _oriented(pairs: DataFrame) -> DataFrame:
    first = F.col("source_a") < F.col("source_b")
    ends = [F.when(first, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")).alias(f"{n}_a") for c, n in (("source", "source"), ("product_key", "key"))]
    ends += [F.when(first, F.col(f"{c}_b")).otherwise(F.col(f"{c}_a")).alias(f"{n}_b") for c, n in (("source", "source"), ("product_key", "key"))]
    return pairs.where(F.col("source_a") != F.col("source_b")).select(*ends, "cosine")


def _best(pairs: DataFrame, budget: int) -> DataFrame:
    return pairs.orderBy(F.desc("cosine"), *PAIR).limit(budget)


def _multiplied(entries: DataFrame, floor: float, budget: int | None = None, slice_size: int = SLICE) -> DataFrame:
    """Pairs of entries (key, id, source, product_key, vector) of one key and two sources with a cosine of at least floor: slices of each key are multiplied
    in tasks. With a budget, no more leave a task than its best ones and their ties."""
    left, right = slices(entries, "key", slice_size)
    both = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))

    def compare(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        a, b = (table.filter(pa.array(side == s)) for s in (0, 1))
        if not (a.num_rows and b.num_rows):
            return pa.table({c: [] for c in ("source_a", "product_key_a", "source_b", "product_key_b", "cosine")}, schema=OUT)
        cosine = _matrix(a["vector"]) @ _matrix(b["vector"]).T
        sources = pa.concat_arrays([*a["source"].chunks, *b["source"].chunks]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        x, y = sources[: a.num_rows, None], sources[None, a.num_rows :]
        keep = (cosine >= floor) & (x != y) & (x >= 0) & (y >= 0)
        if a["i"][0].as_py() == a["j"][0].as_py():  # a slice with itself
            keep &= a["id"].to_numpy()[:, None] < b["id"].to_numpy()[None, :]
        if budget is not None and np.count_nonzero(keep) > budget:
            keep &= cosine >= np.partition(cosine[keep], -budget)[-budget]
        one, other = np.nonzero(keep)
        x, y = a.take(pa.array(one)), b.take(pa.array(other))
        return pa.table([x["source"], x["product_key"], y["source"], y["product_key"], pa.array(cosine[one, other])], schema=OUT)

    return _oriented(both.groupBy("key", "i", "j").applyInArrow(compare, "source_a string, product_key_a string, source_b string, product_key_b string, cosine double"))


def index_pairs(vectors: DataFrame, budget: int, lists: int = LISTS, nearest: int = NEAREST) -> DataFrame:
    """The ``budget`` closest pairs among rows that share a list: source_a, key_a, source_b, key_b, cosine. The budget is the feature.

    These are among the ``budget`` best of each block, so that no more have to leave it."""
    entries = listed(vectors, centroids(vectors, lists), nearest).select(F.struct("brand", "list").alias("key"), "id", "source", "product_key", "vector")
    # a pair that shares several lists is met in as many blocks, where its cosine may differ in the last digits
    best = _multiplied(entries, -2.0, budget).groupBy(*PAIR).agg(F.max("cosine").alias("cosine"))
    return _best(best, budget)


def exact_pairs(vectors: DataFrame, floor: float, slice_size: int = SLICE) -> DataFrame:
    """All pairs of one brand and two sources with a cosine of at least floor. Pairs below it do not leave the task that compares them."""
    entries = vectors.select(F.col("brand").alias("key"), "id", "source", "product_key", F.col("vector").cast("array<double>").alias("vector"))
    return _multiplied(entries, floor, None, slice_size)


OUT = pa.schema([("source_a", pa.string()), ("product_key_a", pa.string()), ("source_b", pa.string()), ("product_key_b", pa.string()), ("cosine", pa.float64())])


def closest_pairs(vectors: DataFrame, budget: int) -> DataFrame:
    """The ``budget`` closest pairs, exactly: the index gives the floor. Where it finds fewer pairs than that, all pairs count."""
    floor, n = index_pairs(vectors, budget).agg(F.min("cosine"), F.count("*")).first()
    # sums in another order differ in their last digits
    return _best(exact_pairs(vectors, floor - 1e-9 if n == budget else -2.0), budget)


def recall(vectors: DataFrame, budget: int, lists: int = LISTS, nearest: int = NEAREST) -> DataFrame:
    """One row: budget, n_exact, n_found: how many of the closest pairs the index alone finds."""
    exact = computed_once(closest_pairs(vectors, budget))
    found = exact.join(index_pairs(vectors, budget, lists, nearest).select(*PAIR), PAIR, "left_semi").agg(F.count("*").alias("n_found"))
    one = F.lit(1).alias("one")
    return exact.agg(F.count("*").alias("n_exact")).select("*", one).join(found.select("*", one), "one").select(F.lit(budget).alias("budget"), "n_exact", "n_found")
