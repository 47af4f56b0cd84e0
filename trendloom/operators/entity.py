"""Products told apart into single items and listings of several variants."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import row_kind, variants
from ..schemas import LISTING_CONTAINS, PRODUCT_LINE, require
from ..sources.commits import commit

# Fixed value: where the answers come from.
PROVENANCE = "exp005-line-label-model-generated"


def skus(products: DataFrame) -> DataFrame:
    return products.where(row_kind(F.col("name")) == "sku").select("source", "product_key", "name", F.lit(None).cast("long").alias("product_line_id"))


def listings(products: DataFrame) -> DataFrame:
    return products.where(row_kind(F.col("name")) == "listing").select("source", "product_key", "name")


def listing_variants(products: DataFrame) -> DataFrame:
    """source, product_key, position (from 0), variant of listings that enumerate them."""
    return listings(products).select("source", "product_key", F.posexplode(variants(F.col("name"))).alias("position", "variant"))


def product_lines(spark) -> DataFrame:
    """Empty on purpose."""
    return spark.createDataFrame([], PRODUCT_LINE)


def containment(pairs: DataFrame) -> DataFrame:
    """Edges from a listing to an item that it contains, from pairs answered 'y' of which one side is a listing.

    Containment is not identity and is not transitive: these edges must not be closed.
    """
    return contained(pairs.where("is_same_product = 'y'").withColumns({"kind_a": row_kind(F.col("name_a")), "kind_b": row_kind(F.col("name_b"))}))


def contained(pairs: DataFrame) -> DataFrame:
    """The edges of pairs answered 'y' (source_a, key_a, kind_a, source_b, key_b, kind_b)."""
    a, b = F.col("kind_a"), F.col("kind_b")
    sides = F.when((a == "listing") & (b == "sku"), F.array("source_a", "key_a", "source_b", "key_b")).when((a == "sku") & (b == "listing"), F.array("source_b", "key_b", "source_a", "key_a"))
    names = [f.name for f in LISTING_CONTAINS.fields[:-1]]
    edges = pairs.select(sides.alias("e")).where("e is not null").select(*[F.col("e")[k].alias(c) for k, c in enumerate(names)])
    return edges.dropDuplicates().where("listing_source <> sku_source or listing_key <> sku_key").withColumn("provenance", F.lit(PROVENANCE))


def kind_shares(products: DataFrame) -> DataFrame:
    """source, n_rows, n_sku, n_listing, listing_share, avg_variants (of those that enumerate)."""
    named = products.select("source", row_kind(F.col("name")).alias("kind"), F.size(variants(F.col("name"))).alias("n"))
    listing = F.count(F.when(F.col("kind") == "listing", 1))
    return named.groupBy("source").agg(F.count("*").alias("n_rows"), F.count(F.when(F.col("kind") == "sku", 1)).alias("n_sku"), listing.alias("n_listing"), (listing / F.count("*")).alias("listing_share"), F.avg(F.when(F.col("n") > 0, F.col("n"))).alias("avg_variants"))


def split_invariants(products: DataFrame) -> DataFrame:
    """One row: n_products, n_sku, n_listing, n_both, n_lines; the split is sound if the counts add up and the last two are 0."""
    sku, listing = skus(products), listings(products)
    both = sku.join(listing, ["source", "product_key"], "left_semi")
    parts = [products.select(F.lit("p").alias("part")), sku.select(F.lit("s").alias("part")), listing.select(F.lit("l").alias("part")), both.select(F.lit("b").alias("part")), sku.where("product_line_id is not null").select(F.lit("n").alias("part"))]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionAll(p)
    names = {"p": "n_products", "s": "n_sku", "l": "n_listing", "b": "n_both", "n": "n_lines"}
    return union.agg(*[F.count(F.when(F.col("part") == k, 1)).alias(n) for k, n in names.items()])


def check_split(products: DataFrame) -> None:
    r = split_invariants(products).first()
    require(r["n_sku"] + r["n_listing"] == r["n_products"], "items and listings do not add up to the products")
    require(r["n_both"] == 0 and r["n_lines"] == 0, "a product is in both parts, or an item has a line")


def _entities(products: DataFrame) -> dict[str, DataFrame]:
    return {"sku": skus(products), "listing": listings(products), "listing_variant": listing_variants(products), "product_line": product_lines(products.sparkSession)}


def rebuild_entities(products: DataFrame, path: str) -> None:
    """Writes the tables sku, listing, listing_variant and product_line into a new version below path, which becomes the current one
    (commits.read_current) when all are whole; nothing is written if the split is not sound."""
    check_split(products)
    version = uuid.uuid4().hex
    for name, df in _entities(products).items():
        df.write.parquet(f"{path}/{version}/{name}")
    commit(products.sparkSession, path, {"version": version})
