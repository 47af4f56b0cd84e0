"""Precision of a matcher from answered pairs. Recall can't be had from them: pairs it never proposed are not in the sample."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import label_answer, stripped
from .tools import QueryResult

#: Bands are closed on the left (fixed values).
EDGES = (0.45, 0.60, 0.80, 1.00, 1.20, 2.00)
CAVEAT = "Recall is not measured: the sample holds only pairs that the matcher proposed."


def labelled(sample: DataFrame) -> DataFrame:
    return sample.withColumn("correct", label_answer(F.col("is_same_product"))).where("correct is not null")


def answer_counts(sample: DataFrame) -> DataFrame:
    """One row: n_rows, n_blank, n_unknown (an answer that is neither yes nor no), n_labelled."""
    given = stripped(F.col("is_same_product"))
    return sample.agg(F.count("*").alias("n_rows"), F.count(F.when(given == "", 1)).alias("n_blank"), F.count(F.when((given != "") & label_answer(F.col("is_same_product")).isNull(), 1)).alias("n_unknown"), F.count(label_answer(F.col("is_same_product"))).alias("n_labelled"))


def _precision(n_pairs: str | None = None) -> list[Column]:
    """n_pairs: the column that says for how many pairs a row stands, or none."""
    right = F.count(F.when(F.col("correct"), 1))
    n = F.count("correct")
    if n_pairs:
        right, n = (F.coalesce(F.sum(F.when(which, F.col(n_pairs))), F.lit(0)) for which in (F.col("correct"), F.col("correct").isNotNull()))
    return [n.alias("n"), right.alias("n_correct"), F.try_divide(right.cast("double"), n).alias("precision")]


def by_band(answered: DataFrame) -> DataFrame:
    """low, high, n, n_correct, precision (null for an empty band)."""
    bands = answered.sparkSession.createDataFrame(list(zip(EDGES, EDGES[1:], strict=False)), "low double, high double")
    low = reduce(lambda chain, e: chain.when(F.col("score") >= e, e), reversed(EDGES[:-1]), F.when(F.col("score") >= EDGES[-1], None))
    in_band = answered.withColumn("low", low).where("low is not null").groupBy("low").agg(*_precision())
    return bands.join(in_band, "low", "left").select("low", "high", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_correct", F.lit(0)).alias("n_correct"), "precision")


def cumulative(answered: DataFrame, extra: list[str] | None = None, n_pairs: str | None = None) -> DataFrame:
    """threshold, n, n_correct, precision of all pairs at or above each edge but the last; empty ones are left out."""
    reached = F.filter(F.array(*map(F.lit, EDGES[:-1])), lambda e: F.col("score") >= e)
    return answered.withColumn("threshold", F.explode(reached)).groupBy(*(extra or []), "threshold").agg(*_precision(n_pairs))


def wilson(right: Column, n: Column, z: float = 1.96) -> list[Column]:
    """low and high of Wilson's interval, null where there is nothing to count."""
    total = F.when(n > 0, n.cast("double"))
    p = right / total
    size = 1 + F.lit(z * z) / total
    centre = (p + F.lit(z * z) / (2 * total)) / size
    spread = F.lit(z) * F.sqrt(p * (1 - p) / total + F.lit(z * z) / (4 * total * total)) / size
    some = total.isNotNull()
    return [F.when(some, F.greatest(F.lit(0.0), centre - spread)).alias("low"), F.when(some, F.least(F.lit(1.0), centre + spread)).alias("high")]


def suggested_threshold(table: DataFrame, target: float) -> DataFrame:
    """The row with the lowest threshold whose precision reaches the target, or none."""
    return table.where(F.col("precision") >= target).orderBy("threshold").limit(1)


def report(sample: DataFrame, target: float | None = None) -> QueryResult:
    """threshold, n, n_correct, precision, its interval low and high, suggested, recall, of an answered sample.

    recall is null in every row, and the caveat says why: it cannot be had from such a sample. suggested marks the lowest threshold whose precision
    reaches the target.
    """
    table = cumulative(labelled(sample))
    rows = table.select("*", *wilson(F.col("n_correct"), F.col("n")))
    reaching = F.min(F.when(F.col("precision") >= F.lit(target), F.col("threshold"))).over(Window.partitionBy(F.lit(0)))
    marked = rows.withColumns({"suggested": F.coalesce(F.col("threshold") == reaching, F.lit(False)), "recall": F.lit(None).cast("double")})
    return QueryResult(marked.orderBy("threshold"), "label_sample", CAVEAT)
