"""The driver's fixture tables in the shape of retail snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import month_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, query, period, count: orders by status, priority and month."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_orderstatus").alias("source"), F.col("o_orderpriority").alias("query"), month_of(F.col("o_orderdate")).alias("period")).agg(F.count("*").cast("int").alias("count"))


def category_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """month, segment, category, value."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderdate", "o_totalprice")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(month_of(F.col("o_orderdate")).alias("month"), F.col("o_orderstatus").alias("segment"), F.col("c_mktsegment").alias("category")).agg(F.sum("o_totalprice").alias("value"))


def category_sheet(spark: SparkSession, sf_dir: str, segment: str) -> DataFrame:
    """A workbook-like sheet of a segment: a day number, then a column for each category."""
    sales = category_sales(spark, sf_dir).where(F.col("segment") == segment)
    wide = sales.groupBy("month").pivot("category", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]).agg(F.sum("value"))
    return wide.withColumn("month", F.datediff("month", F.lit("1899-12-30").cast("date")).cast("double"))


def visitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """month, segment, visitors: customers that ordered."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(month_of(F.col("o_orderdate")).alias("month"), F.col("o_orderstatus").alias("segment")).agg(F.countDistinct("o_custkey").alias("visitors"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, product_key, name, brand, volume."""
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    name = F.concat(
        F.lit("["), "p_type", F.lit("] "), "p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit("ml"),
        F.when(k % 7 == 0, " (a/b/c)").otherwise(""), F.when(k % 11 == 0, " 3 colors").otherwise(""),
    )
    return part.select(F.concat(F.lit("s"), (k % 4).cast("string")).alias("source"), k.cast("string").alias("product_key"), name.alias("name"), F.col("p_brand").alias("brand"), F.lit(None).cast("string").alias("volume"))


def rank_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, board, captured_at (month), product_key, rank by sales of the month, price, discount_rate."""
    lines = table(spark, sf_dir, "lineitem")
    sums = lines.groupBy(F.col("l_linestatus").alias("source"), F.col("l_returnflag").alias("board"), month_of(F.col("l_shipdate")).alias("captured_at"), F.col("l_partkey").alias("product_key")).agg(
        F.sum("l_extendedprice").alias("sales"), F.max("l_discount").alias("discount_rate"), F.max("l_extendedprice").alias("price")
    )
    order = Window.partitionBy("source", "board", "captured_at").orderBy(F.desc(F.round("sales", 2)), "product_key")
    return sums.select("source", "board", "captured_at", "product_key", F.row_number().over(order).alias("rank"), "price", "discount_rate")


def price_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, product_key, captured_at, price, discount_rate."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(
        F.concat(F.lit("s"), (F.col("l_partkey") % 4).cast("string")).alias("source"), F.col("l_partkey").cast("string").alias("product_key"),
        F.to_date("l_shipdate").alias("captured_at"), F.round(F.col("l_extendedprice") / F.col("l_quantity"), 2).alias("price"), F.col("l_discount").alias("discount_rate"),
    )


def new_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, product_key, name, brand, captured_at: first shipment."""
    first = price_points(spark, sf_dir).groupBy("source", "product_key").agg(F.min("captured_at").alias("captured_at"))
    return first.join(products(spark, sf_dir).select("source", "product_key", "name", "brand"), ["source", "product_key"]).select("source", "product_key", "name", "brand", "captured_at")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, product_key, rating, written_at, body."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))
    rated = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("rating"))
    written = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.to_date("ts").alias("written_at"))
    joined = docs.join(rated, "doc_id", "left").join(written, "doc_id", "left")
    return joined.select(F.concat(F.lit("s"), (F.col("doc_id") % 4).cast("string")).alias("source"), F.col("doc_id").cast("string").alias("product_key"), "rating", "written_at", "body")


def review_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, product_key, topic_name, is_positive, review_count, share_pct: events by type, of users dealt to all products."""
    n = max(1, table(spark, sf_dir, "part").count())
    events = table(spark, sf_dir, "events").withColumn("group", F.col("user_id") % n)
    counted = events.groupBy("group", "event_type").agg(F.count("*").alias("review_count"))
    whole = counted.groupBy("group").agg(F.sum("review_count").alias("total"))
    share = F.when(F.col("event_type") != "error", F.round(100 * F.col("review_count") / F.col("total"), 2))
    return counted.join(whole, "group").select(F.concat(F.lit("s"), (F.col("group") % 4).cast("string")).alias("source"), F.col("group").cast("string").alias("product_key"), F.col("event_type").alias("topic_name"), (F.col("event_type") != "error").alias("is_positive"), "review_count", share.alias("share_pct"))


def labelled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, is_same_product (text), score: quality labels as answers, blank where there is none."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    answer = F.when(F.col("quality") == 1, "y").when(F.col("quality") == 0, " N ").otherwise(F.when(F.col("doc_id") % 17 == 0, "?"))
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left").select(F.col("doc_id").alias("pair_id"), answer.alias("is_same_product"), (F.lit(0.45) + (F.col("doc_id") % 155) / F.lit(100.0)).alias("score"))
