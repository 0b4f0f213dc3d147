"""Results to files: tables, one-document catalogues, sitemaps, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.functions.text import slug_ascii


def to_targets(df: DataFrame, paths: list[str], form: str = "parquet") -> None:
    """The same rows to several places; the rows are computed once and copied from the first."""
    first, *others = paths
    df.write.mode("overwrite").format(form).save(first)
    for p in others:
        df.sparkSession.read.format(form).load(first).write.mode("overwrite").format(form).save(p)


def snapshot(df: DataFrame, path: str, site: str = "site", run: str = "run_ts") -> None:
    """Raw rows by site and run; a run that is written again replaces its own partition only."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(site, run).parquet(path)


def documents(offers: DataFrame) -> DataFrame:
    """One JSON document per product with its prices, cheapest first."""
    price = F.struct(F.col("current_price").alias("current"), F.col("listing_id"), F.col("store_name").alias("retailer"), F.col("original_price").alias("original"), F.col("stock_status").alias("stock"), F.col("product_url").alias("url"))
    grouped = offers.groupBy("product_id", "product_slug", "product_name", "product_brand", "category_slug").agg(F.array_sort(F.collect_list(price)).alias("prices"))
    return grouped.select("product_id", F.to_json(F.struct(*grouped.columns)).alias("document"))


def sitemap_lines(products: DataFrame, base_url: str, order: Column, limit: int = 200) -> DataFrame:
    """The url elements of the first products in order; blank slugs are left out.  The limit is the feature."""
    s = slug_ascii(F.col("name"))
    top = products.withColumn("slug", s).where("slug <> ''").orderBy(order, "slug").limit(limit)
    return top.select(F.concat(F.lit(f"<url><loc>{base_url}/product/"), F.col("slug"), F.lit("</loc></url>")).alias("value"))
