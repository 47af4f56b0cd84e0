"""Blocks of the vector index: no task gives out more than the budget and its ties."""

import numpy as np
from pyspark.sql import functions as F

from trendloom.operators import vector_index
from trendloom.sources.store import computed_once


def test_a_block_gives_its_best_pairs_only(spark):
    rng = np.random.default_rng(4)
    rows = [(k, "b", f"s{k % 3}", str(k), rng.normal(size=8).tolist()) for k in range(120)]
    table = computed_once(spark.createDataFrame(rows, "id long, brand string, source string, product_key string, vector array<double>"))
    entries = table.select(F.col("brand").alias("key"), "id", "source", "product_key", "vector")
    assert vector_index._multiplied(entries, -2.0).count() == 3 * 40 * 40
    best = vector_index._multiplied(entries, -2.0, 7)
    assert best.count() == 7
    want = vector_index.exact_pairs(table, -2.0).orderBy(F.desc("cosine")).limit(7)
    keys = lambda df: sorted(tuple(r)[:4] for r in df.collect())
    assert keys(best) == keys(want) == keys(vector_index.index_pairs(table, 7, lists=1, nearest=1))
