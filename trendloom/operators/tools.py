"""Fixed, parameterised queries. Each gives its rows with their provenance and what must be known to read them."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import since
from ..functions.text import escaped_like
from ..sources.store import computed_once
from . import papers

#: Rows of an answer, months of a trend (within that), and days back, at most.
MAX_ROWS, MAX_DAYS = 40, 90


@dataclass
class QueryResult:
    df: DataFrame
    table: str
    caveat: str
    extra: dict = field(default_factory=dict)

    def envelope(self) -> str:
        """The answer as JSON; it holds MAX_ROWS rows at most."""
        rows = [r.asDict(recursive=True) for r in self.df.limit(MAX_ROWS).collect()]
        return json.dumps({"rows": rows, "provenance": {"table": self.table, "returned": len(rows), "caveat": self.caveat} | self.extra}, ensure_ascii=False, default=str)


def _day(as_of: date | str) -> Column:
    return F.lit(str(as_of)).cast("timestamp")


def paper_trend(counts: DataFrame, query: str, source: str, months: int = 24) -> QueryResult:
    latest = counts.where((F.col("source") == source) & (F.col("query") == query)).orderBy(F.desc("period")).limit(min(months, MAX_ROWS))
    return QueryResult(latest.select("period", "count").orderBy("period"), "publications", "Sources count different things and must not be compared or added. The last months are indexed late, and January is inflated.")


def paper_growth(counts: DataFrame, source: str, early: tuple[str, str], recent: tuple[str, str]) -> QueryResult:
    out = papers.growth(counts.where(F.col("source") == source), ["query"], early, recent, scale=1)
    return QueryResult(out.select("query", "avg_early", "avg_recent", "growth").orderBy(F.desc_nulls_last("avg_recent"), "query").limit(MAX_ROWS), "publications", "Multiples compare within one source only.")


def latest_snapshot(ranks: DataFrame, source: str) -> DataFrame:
    """Rows of a source's last snapshot, computed once. Of a table kept by month (sources.snapshots) only the last month is read: see last_snapshot there."""
    own = ranks.where(F.col("source") == source)
    return computed_once(own.where(F.col("captured_at") == F.lit(own.agg(F.max("captured_at")).first()[0])))


def boards(last: DataFrame) -> QueryResult:
    """The boards of a last snapshot."""
    out = last.groupBy("board").agg(F.countDistinct("product_key").alias("n_products"), F.max("rank").alias("deepest"), F.count("*").alias("n_rows"))
    return QueryResult(out.orderBy(F.desc("n_rows"), "board").limit(MAX_ROWS), "rank_snapshot", "Boards are observed to different depths.")


def snapshot_depth(last: DataFrame, board: str = "") -> DataFrame:
    """One row: deepest rank and number of boards of a last snapshot."""
    return (last.where(F.col("board") == board) if board else last).agg(F.max("rank").alias("deepest"), F.countDistinct("board").alias("n_boards"))


def top_products(ranks: DataFrame, source: str, board: str = "", limit: int = 15) -> QueryResult:
    return top_of_snapshot(latest_snapshot(ranks, source), board, limit)


def top_of_snapshot(last: DataFrame, board: str = "", limit: int = 15) -> QueryResult:
    """The products of the best ranks of a last snapshot, or its boards for the board '?'."""
    if board == "?":
        return boards(last)
    want = min(limit, MAX_ROWS)
    rows = last.where(F.col("board") == board) if board else last
    newest = Window.partitionBy("rank", "product_key").orderBy(F.desc("captured_at"), "board")
    out = rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n").orderBy("rank", "product_key").limit(want)
    depth = snapshot_depth(last, board).first()
    note = f"Ranks are those of listings; the lowest rank seen is {depth['deepest']}."
    if not board and depth["n_boards"] > 1:
        note += f" {depth['n_boards']} boards are mixed: these are no overall ranks."
    if (depth["deepest"] or 0) < want:
        note += f" Ranks down to {want} were not observed, so that a missing product has not dropped out."
    return QueryResult(out, "rank_snapshot", note)


def price_history(prices: DataFrame, products: DataFrame, name_contains: str, as_of: date | str, days: int = 30) -> QueryResult:
    named = products.where(F.col("name").ilike(escaped_like(name_contains))).select("source", "product_key", "name")
    recent = prices.where(since(F.col("captured_at").cast("timestamp"), _day(as_of), days, MAX_DAYS))
    out = recent.join(named, ["source", "product_key"]).select("name", "captured_at", "price", "discount_rate", "product_key")
    return QueryResult(out.orderBy(F.desc("captured_at"), "product_key", "price", "discount_rate").limit(MAX_ROWS), "price_point join product", "There are no prices from before collection began.")


def new_products(found: DataFrame, as_of: date | str, days: int = 14, source: str = "") -> QueryResult:
    out = found.where(since(F.col("captured_at").cast("timestamp"), _day(as_of), days, MAX_DAYS))
    out = out.where(F.col("source") == source) if source else out
    return QueryResult(out.orderBy(F.desc("captured_at"), "source", "product_key").limit(MAX_ROWS), "new_product", "Some sources do not report new products: none found is not none there.")


def review_topics(topics: DataFrame, products: DataFrame, name_contains: str) -> QueryResult:
    named = products.where(F.col("name").ilike(escaped_like(name_contains))).select("source", "product_key", "name")
    out = topics.join(named, ["source", "product_key"]).select("name", "topic_name", "is_positive", "share_pct", "review_count", "product_key")
    return QueryResult(out.orderBy(F.desc_nulls_last("share_pct"), "product_key", "topic_name").limit(MAX_ROWS), "review_topic join product", "Reviews are collected for well-ranked products.")


def search_reviews(reviews: DataFrame, products: DataFrame, keyword: str, limit: int = 12) -> QueryResult:
    found = reviews.where(F.col("body").ilike(escaped_like(keyword))).join(products.select("source", "product_key", "name"), ["source", "product_key"])
    out = found.select("name", "rating", "written_at", F.substring("body", 1, 300).alias("body"), "product_key")
    return QueryResult(out.orderBy(F.desc_nulls_last("written_at"), "product_key").limit(min(limit, MAX_ROWS)), "review join product", "The first 300 signs of a text.")


Status = tuple[int, date | None, date | None]


def data_status(tables: dict[str, tuple[DataFrame, str | None, str | None] | Status | DataFrame]) -> QueryResult:
    """t, n, lo, hi for each table: number of rows and range of days; tables without days have none.

    A table is given as its rows and the columns of days, as what is known of it (sources.status.stored_status), or as rows of t, n, lo, hi
    that one pass has counted for several tables.
    """
    day = lambda f, c: f(F.to_date(c)) if c else F.lit(None).cast("date")
    parts, known = [], []
    for name, given in tables.items():
        if isinstance(given, DataFrame):
            parts.append(given.select("t", "n", "lo", "hi"))
        elif isinstance(given[0], DataFrame):
            df, lo, hi = given
            parts.append(df.agg(F.count("*").alias("n"), day(F.min, lo).alias("lo"), day(F.max, hi).alias("hi")).select(F.lit(name).alias("t"), "n", "lo", "hi"))
        else:
            known.append((name, *given))
    if known:
        parts.append(SparkSession.active().createDataFrame(known, "t string, n long, lo date, hi date"))
    return QueryResult(reduce(DataFrame.unionByName, parts), "all tables", "A table without rows may never have been collected. product_line is empty on purpose.")


def rank_momentum(ranks: DataFrame, months: int = 1) -> DataFrame:
    """source, board, product_key, captured_at, rank, earlier_rank, gain against the same board ``months`` calendar months before.

    A join by calendar, not a shift by rows: a product that was not observed then has no gain.
    """
    before = ranks.select("source", "board", "product_key", F.add_months("captured_at", months).alias("captured_at"), F.col("rank").alias("earlier_rank"))
    return ranks.select("source", "board", "product_key", "captured_at", "rank").join(before, ["source", "board", "product_key", "captured_at"]).withColumn("gain", F.col("earlier_rank") - F.col("rank"))


def discount_transitions(prices: DataFrame) -> DataFrame:
    """source, product_key, n_points, n_starts: how often a product's discount began, as events and not as rows."""
    order = Window.partitionBy("source", "product_key").orderBy("captured_at", "price", "discount_rate")
    marked = prices.withColumn("was", F.lag("discount_rate").over(order))
    return marked.groupBy("source", "product_key").agg(F.count("*").alias("n_points"), F.count(F.when((F.col("discount_rate") > 0) & (F.col("was") == 0), 1)).alias("n_starts"))


TOOLS: dict[str, Callable[..., QueryResult]] = {
    "paper_trend": paper_trend, "paper_growth": paper_growth, "top_products": top_products, "price_history": price_history,
    "new_products": new_products, "review_topics": review_topics, "search_reviews": search_reviews, "data_status": data_status,
}
