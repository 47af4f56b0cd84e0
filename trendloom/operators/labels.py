"""Monthly demand labels: sales, visitors, year-over-year growth and the growth that lies ahead."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import month_of_serial, season


def unpivoted(sheets: dict[str, DataFrame]) -> DataFrame:
    """month, segment, category, value from sheets by segment, whose first column is a day number; what is no number goes."""
    parts = []
    for segment, sheet in sheets.items():
        first, *rest = sheet.columns
        cast = sheet.where(F.col(first).isNotNull()).select(month_of_serial(F.col(first)).alias("month"), *[F.col(c).try_cast("double").alias(c) for c in rest])
        parts.append(cast.unpivot(["month"], rest, "category", "value").withColumn("segment", F.lit(segment)))
    return reduce(DataFrame.unionByName, parts).where("value is not null").select("month", "segment", "category", "value")


def monthly_sales(sales: DataFrame, categories: list[str]) -> DataFrame:
    return sales.where(F.col("category").isin(categories)).groupBy("month").agg(F.sum("value").alias("sales"))


def months_away(value: Column, n: int) -> Column:
    """value of the row n calendar months later (earlier where n is negative); null where that month has no row.

    One row a month: at most some hundreds of rows come together, however many rows they were summed from.
    """
    number = F.year("month") * 12 + F.month("month")
    return F.first(value).over(Window.partitionBy(F.lit(0)).orderBy(number).rangeBetween(n, n))


def change(value: Column, n: int) -> Column:
    """Growth against the month n months before."""
    return F.try_divide(value, months_away(value, -n)) - 1


def missing_months(labels: DataFrame) -> int:
    """Months without a row between the first and the last."""
    low, high, n = labels.agg(F.min("month"), F.max("month"), F.count("*")).first()
    return 0 if low is None else (high.year - low.year) * 12 + high.month - low.month + 1 - n


def monthly_demand(sales: DataFrame, visitors: DataFrame, categories: list[str]) -> DataFrame:
    """month, sales, visitors_k, per_visitor, yoy. A month without visitors has null for them."""
    heads = visitors.groupBy("month").agg(F.sum("visitors").alias("visitors_k"))
    joined = monthly_sales(sales, categories).join(heads, "month", "left")
    grown = joined.withColumns({"per_visitor": F.try_divide("sales", "visitors_k"), "yoy": change(F.col("sales"), 12)})
    return grown.select("month", "sales", "visitors_k", "per_visitor", "yoy")


def with_target(monthly: DataFrame, horizon: int) -> DataFrame:
    """monthly with target_yoy_fwd, the growth that lies horizon months ahead."""
    return monthly.withColumn("target_yoy_fwd", months_away(F.col("yoy"), horizon))


def demand_labels(sales: DataFrame, visitors: DataFrame, categories: list[str], horizon: int = 3) -> DataFrame:
    """month, sales, visitors_k, per_visitor, yoy, target_yoy_fwd."""
    return with_target(monthly_demand(sales, visitors, categories), horizon)


#: Rows that a table of months may have: one for each month of 8,000 years.
MOST_MONTHS = 12 * 8000


def settled(monthly: DataFrame) -> DataFrame:
    """A table of one row a month, computed once, so that what is fitted on it does not read its sources again.

    Its rows come to the driver: their number follows the calendar and not the input, and a table of more than MOST_MONTHS
    rows is refused."""
    rows = monthly.limit(MOST_MONTHS + 1).toArrow()
    if rows.num_rows > MOST_MONTHS:
        raise ValueError("more rows than months: one row a month is expected")
    return monthly.sparkSession.createDataFrame(rows, monthly.schema)


FEATURES = ["yoy", "yoy_lag1", "yoy_lag3", "visitors_yoy", "per_visitor", "month_sin", "month_cos"]


def design_matrix(labels: DataFrame, papers: DataFrame | None = None) -> DataFrame:
    """month, FEATURES (and papers_yoy, where papers gives it by month), target_yoy_fwd; months with a gap go."""
    out = labels.withColumns({"yoy_lag1": months_away(F.col("yoy"), -1), "yoy_lag3": months_away(F.col("yoy"), -3), "visitors_yoy": change(F.col("visitors_k"), 12)})
    sine, cosine = season(F.col("month"))
    out = out.withColumns({"month_sin": sine, "month_cos": cosine})
    features = list(FEATURES)
    if papers is not None:
        out = out.join(papers.select("month", "papers_yoy"), "month", "left")
        features.append("papers_yoy")
    return out.select("month", *features, "target_yoy_fwd").na.drop()


def papers_yoy(counts: DataFrame) -> DataFrame:
    """month, papers_yoy from month, count."""
    return counts.select("month", change(F.col("count"), 12).alias("papers_yoy"))


def purged_split(design: DataFrame, horizon: int, holdout: int) -> DataFrame:
    """design with part: the last holdout months are 'test', the horizon months before are 'purged', the rest is 'train'."""
    back = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("month")))
    return design.withColumn("part", F.when(back <= holdout, "test").when(back <= holdout + horizon, "purged").otherwise("train"))
