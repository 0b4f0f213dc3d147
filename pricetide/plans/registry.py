"""Named queries: each is a function of (spark, data folder), with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """The queries of one module in order of definition."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f
        return add


#: The current snapshot of each listing, as a common table expression.
OFFERS_SQL = """offers AS (
  SELECT * EXCLUDE (k) FROM (
    SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY price_updated_at DESC NULLS LAST, received_at DESC NULLS LAST, current_price DESC NULLS LAST,
      original_price DESC NULLS LAST, stock_status DESC NULLS LAST, shipping DESC NULLS LAST) AS k
    FROM price_views WHERE listing_id IS NOT NULL) WHERE k = 1)"""
