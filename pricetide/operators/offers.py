"""The flat price table and the views over it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricetide.functions import price

#: Which of several snapshots of a listing is the current one: the latest, then the one received last, then the higher values.
SNAPSHOT_ORDER = ("price_updated_at", "received_at", "current_price", "original_price", "stock_status", "shipping")


def latest_offers(price_views: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """One row per listing: its current snapshot, with all columns or those named.

    The maximum of a struct is found with partial aggregation before the shuffle,
    so repeated snapshots of a hot listing never meet in one task.  Only the
    order and the named columns are read and shuffled.
    """
    wanted = [c for c in price_views.columns if columns is None or c in set(columns)]
    rest = [c for c in wanted if c not in SNAPSHOT_ORDER and c != "listing_id"]
    best = price_views.where("listing_id is not null").groupBy("listing_id").agg(F.max(F.struct(*SNAPSHOT_ORDER, *rest)).alias("o"))
    return best.select("listing_id", *(f"o.{c}" for c in price_views.columns if c != "listing_id" and (c in rest or (c in SNAPSHOT_ORDER and c in wanted))))


def product_prices(listings: DataFrame, products: DataFrame, sources: DataFrame, categories: DataFrame) -> DataFrame:
    """Listings with their product, shop and category.

    Products are joined by key; sources and categories are small dimensions and
    the optimizer broadcasts them where their measured size allows it.
    """
    p = products.select("product_id", F.col("canonical_name").alias("product_name"), F.col("brand").alias("product_brand"), "category")
    s = sources.select("source_id", F.col("name").alias("source_name"))
    c = categories.where("kind = 'category'").select(F.col("value").alias("category"), F.col("alt_value").alias("category_name_fr"))
    joined = listings.where("product_id is not null").join(p, "product_id").join(s, "source_name").join(c, "category", "left")
    return joined.select(
        "listing_id", "product_id", "product_name", "product_brand", F.col("category").alias("category_slug"), "category_name_fr",
        F.col("source_id").alias("store_id"), F.col("source_name").alias("store_name"), F.col("price").alias("current_price"), "condition", "url",
    )


def top_n_per(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key; a rank limit below the shuffle keeps hot keys small."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order, by partial aggregation."""
    rest = [c for c in df.columns if c not in (*keys, *order)]
    first = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("r"))
    return first.select(*keys, "r.*").select(*df.columns)


def price_stats(offers: DataFrame, key: str = "product_id", value: str = "current_price", store: str = "store_id") -> DataFrame:
    """Best, worst and average price and the counts of listings and stores per product."""
    return offers.where(F.col(value).isNotNull()).groupBy(key).agg(
        F.min(value).alias("best_price"), F.max(value).alias("worst_price"), price.half_up(F.avg(value)).alias("average_price"),
        F.count("*").alias("listing_count"), F.countDistinct(store).alias("store_count"),
    )


def without_outliers(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows within 1.5 interquartile ranges of the quartiles of their key; keys of fewer than three rows whole.

    Quartiles are the values at index floor(n/4) and floor(3n/4).  Ranks come
    from a count per distinct value, so equal prices of a hot key are merged
    before the window over the key's distinct values.
    """
    values = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("m"))
    w = Window.partitionBy(key)
    upto = values.withColumns({"n": F.sum("m").over(w), "hi": F.sum("m").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))})

    def at(share: float) -> Column:
        index = F.floor(F.col("n") * share)
        return F.min(F.when(F.col("hi") > index, F.col(value)))

    bounds = upto.groupBy(key).agg(F.first("n").alias("n"), at(0.25).alias("q1"), at(0.75).alias("q3"))
    low, high = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    return df.join(bounds, key).where((F.col("n") < 3) | F.col(value).between(low, high)).select(*df.columns)


def facets(df: DataFrame, *, category: str | None = None, store: str | None = None, brand: str | None = None, in_stock: bool = False, on_sale: bool = False,
           low: float | None = None, high: float | None = None, text: str | None = None) -> DataFrame:
    """Rows that pass every given facet; a null price counts as 0 below and as unbounded above."""
    if category and category != "all":
        df = df.where(F.col("category_slug") == category)
    if store:
        df = df.where(F.col("store_name") == store)
    if brand:
        df = df.where(F.col("product_brand") == brand)
    if in_stock:
        df = df.where(F.col("stock_status") == "En stock")
    if on_sale:
        df = df.where(F.col("original_price") > F.col("current_price"))
    if low is not None:
        df = df.where(F.coalesce("current_price", F.lit(0)) >= low)
    if high is not None:
        df = df.where(F.col("current_price") <= high)
    if text:
        t = text.lower()
        df = df.where(F.lower("product_name").contains(t) | F.lower("product_brand").contains(t) | F.lower("category_slug").contains(t))
    return df
