"""Named queries of this subpackage; each runs over the whole tables of a data folder.

None of them can be stated in SQL, so they have no oracle there; ``tests/llm``
holds them against brute force, an exact round trip or built cases.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.llm import batch_dedup, bpe, leaks, lookalikes, personal, same_item, survivors, value_mapping
from pricetide.session import read


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return batch_dedup.repeats(read(spark, d, "product_listings"), read(spark, d, "ref_values"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.same_looking_pairs(read(spark, d, "scrape_results"))


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every reading with the class of those that look like it and its number of links; no pair is spelled out."""
    return lookalikes.look_classes(read(spark, d, "scrape_results"))


def p2_consistent(spark: SparkSession, d: str) -> DataFrame:
    """Every reading with its title and price in their consistent form."""
    rows = lookalikes.unified(read(spark, d, "scrape_results").select("result_id", "title", "price"), ["title", "price"])
    return rows.select("result_id", F.col("title_plain").alias("title"), F.col("price_plain").alias("price"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return value_mapping.mapped_catalogue(read(spark, d, "clean_products"), read(spark, d, "product_listings"), read(spark, d, "ref_values"))


def p3_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """How many values of each field could not be mapped."""
    return p3_found(spark, d).groupBy("field_name").agg(F.count("*").alias("n_values"), F.count_if(F.col("ref_id") == 0).alias("n_unmatched"))


def _same_items(spark: SparkSession, d: str) -> DataFrame:
    return same_item.same_items(read(spark, d, "clean_products"), read(spark, d, "scrape_results"), read(spark, d, "ref_values"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return same_item.pairs_across_sellers(_same_items(spark, d))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every entry with the item it describes; null where the wording doesn't tell."""
    return _same_items(spark, d).select("entry_id", "item")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.survivors(read(spark, d, "merge_candidates"), read(spark, d, "sources"), read(spark, d, "ref_values"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encoded(read(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(read(spark, d, "documents"), read(spark, d, "eval_items"))


def _places(spark: SparkSession, d: str) -> DataFrame:
    return personal.place_names([(read(spark, d, "product_listings"), "location"), (read(spark, d, "scrape_results"), "location")])


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.found(read(spark, d, "documents"), _places(spark, d))


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every document with typed placeholders in place of personal data."""
    return personal.redacted(read(spark, d, "documents"), _places(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (p1_found, p2_found, p2_classes, p2_consistent, p3_found, p3_unmatched, p4_found, p4_groups, p6_found, p7_ids, p8_found, p9_found, p9_redacted)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {}
