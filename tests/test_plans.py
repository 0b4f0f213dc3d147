"""What the optimizer makes of the queries: no cross products, narrow scans, pushed filters, partial aggregation."""

from __future__ import annotations

import re

import __spark_entry__ as entry
import pytest

CORE = [name for module in entry._MODULES for name in module.QUERIES]


def plan(spark, data, name):
    return entry.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CORE)
def test_no_cross_product(spark, data, name):
    assert "CartesianProduct" not in plan(spark, data, name)


@pytest.mark.parametrize("name, columns", [("f2_fresh_listings", {"listing_id", "product_id", "url", "price", "expires_at"}), ("a20_distinct_sources", {"source_name", "price"}), ("f16_with_url", {"listing_id", "url"}), ("a6_price_stats_lineitem", {"l_partkey", "l_suppkey", "l_extendedprice", "l_discount"})])
def test_scans_read_what_is_needed(spark, data, name, columns):
    schema = re.search(r"ReadSchema: struct<(.*?)>", plan(spark, data, name))[1]
    assert {c.split(":")[0] for c in schema.split(",")} == columns


@pytest.mark.parametrize("name, pushed", [("f2_fresh_listings", "GreaterThanOrEqual(expires_at"), ("j4_top5_listings", "IsNotNull(price)"), ("f1_product_by_id", "EqualTo(product_id,10)"), ("v3_stores", "EqualTo(is_active,true)")])
def test_filters_reach_the_scan(spark, data, name, pushed):
    text = plan(spark, data, name)
    assert pushed in text[text.index("PushedFilters: ["):text.index("ReadSchema")]


def test_rank_limit_before_the_shuffle(spark, data):
    assert plan(spark, data, "j4_top5_listings").count("WindowGroupLimit") == 2


def test_history_shuffles_each_observation_once(spark, data):
    text = plan(spark, data, "p5_found")
    assert text.count("REPARTITION_BY_COL") == 1 and "Window" not in text


def test_current_offers_read_the_order_and_what_is_asked(spark, data):
    from pricetide.operators.offers import SNAPSHOT_ORDER
    schema = re.search(r"ReadSchema: struct<(.*?)>", plan(spark, data, "v2_category_stats"))[1]
    assert {c.split(":")[0] for c in schema.split(",")} == {"listing_id", "category_slug", "category_name_fr", *SNAPSHOT_ORDER}
