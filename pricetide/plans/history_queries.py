"""Queries over the history of listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pricetide.operators.history import LISTING_VERSIONS_SQL, listing_versions
from pricetide.session import read


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return listing_versions(read(spark, d, "product_listings"), read(spark, d, "price_views"))


QUERIES = {"p5_found": p5_found}
ORACLE_SQL = {"p5_found": LISTING_VERSIONS_SQL}
