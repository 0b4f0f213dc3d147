"""Lookups, filters, joins and orderings over products, listings and the flat price table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricetide.functions import price, text
from pricetide.operators import clusters, offers
from pricetide.plans.registry import OFFERS_SQL, Registry
from pricetide.session import read

query = Registry()
AS_OF = "2026-02-01 00:00:00"


def current(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The current snapshots; only the named columns where some are."""
    return offers.latest_offers(read(spark, d, "price_views"), columns or None)


def as_of():
    return F.lit(AS_OF).cast("timestamp")


# ---- views -------------------------------------------------------------------------------------------------------

@query("""SELECT l.listing_id, l.product_id, p.canonical_name AS product_name, p.brand AS product_brand, p.category AS category_slug, c.alt_value AS category_name_fr, s.source_id AS store_id, s.name AS store_name,
  l.price AS current_price, l.condition, l.url
FROM product_listings l JOIN clean_products p ON p.product_id = l.product_id JOIN sources s ON s.name = l.source_name LEFT JOIN ref_values c ON c.kind = 'category' AND c.value = p.category""")
def v1_product_prices(spark, d):
    return offers.product_prices(read(spark, d, "product_listings"), read(spark, d, "clean_products"), read(spark, d, "sources"), read(spark, d, "ref_values"))


@query(f"WITH {OFFERS_SQL} SELECT category_slug, category_name_fr, count(*) AS n_offers FROM offers GROUP BY 1, 2")
def v2_category_stats(spark, d):
    return current(spark, d, "category_slug", "category_name_fr").groupBy("category_slug", "category_name_fr").agg(F.count("*").alias("n_offers")).orderBy(F.desc("n_offers"), "category_slug")


@query("SELECT source_id, name, base_url, trust_level, size(category_focus) AS n_categories FROM (SELECT *, len(category_focus) AS size_ FROM sources) WHERE is_active".replace("size(category_focus)", "size_"))
def v3_stores(spark, d):
    return read(spark, d, "sources").where("is_active").select("source_id", "name", "base_url", "trust_level", F.size("category_focus").cast("long").alias("n_categories")).orderBy("name")


# ---- lookups and filters -----------------------------------------------------------------------------------------

@query("SELECT product_id, canonical_name, brand, category, best_price FROM clean_products WHERE product_id = 10")
def f1_product_by_id(spark, d):
    return read(spark, d, "clean_products").where("product_id = 10").select("product_id", "canonical_name", "brand", "category", "best_price")


@query(f"SELECT listing_id, product_id, price, url FROM product_listings WHERE product_id IS NOT NULL AND price IS NOT NULL AND expires_at >= TIMESTAMP '{AS_OF}'")
def f2_fresh_listings(spark, d):
    return read(spark, d, "product_listings").where(F.col("product_id").isNotNull() & F.col("price").isNotNull() & (F.col("expires_at") >= as_of())).select("listing_id", "product_id", "price", "url")


@query("SELECT product_id, canonical_name FROM clean_products WHERE canonical_name ILIKE '%granix%'")
def f3_name_ilike(spark, d):
    return read(spark, d, "clean_products").where(F.col("canonical_name").ilike("%granix%")).select("product_id", "canonical_name")


@query("SELECT product_id, canonical_name, brand FROM clean_products WHERE canonical_name ILIKE '%ssd%' OR brand ILIKE '%velm%'")
def f4_name_or_brand(spark, d):
    return read(spark, d, "clean_products").where(F.col("canonical_name").ilike("%ssd%") | F.col("brand").ilike("%velm%")).select("product_id", "canonical_name", "brand")


@query(f"WITH {OFFERS_SQL} SELECT listing_id, product_name FROM offers WHERE contains(lower(product_name), 'nebulo') OR contains(lower(product_brand), 'nebulo') OR contains(lower(category_slug), 'nebulo')")
def f5_three_columns(spark, d):
    return offers.facets(current(spark, d), text="nebulo").select("listing_id", "product_name")


@query("SELECT product_id FROM clean_products WHERE contains(lower(canonical_name), '16gb') OR contains(lower(category), '16gb') OR len(list_filter(map_values(specs), lambda v: contains(lower(v), '16gb'))) > 0")
def f6_specs_search(spark, d):
    p = read(spark, d, "clean_products")
    hit = lambda c: F.lower(c).contains("16gb")
    return p.where(hit(F.col("canonical_name")) | hit(F.col("category")) | F.exists(F.map_values("specs"), hit)).select("product_id")


@query(f"WITH {OFFERS_SQL}, me AS (SELECT category_slug, product_id FROM offers ORDER BY listing_id LIMIT 1) SELECT o.listing_id, o.product_id, o.current_price FROM offers o, me WHERE o.category_slug = me.category_slug AND o.product_id <> me.product_id AND o.current_price IS NOT NULL ORDER BY o.current_price, o.listing_id LIMIT 6")
def f7_related_products(spark, d):
    o = current(spark, d, "listing_id", "product_id", "category_slug", "current_price")
    me = o.orderBy("listing_id").limit(1).select(F.col("category_slug").alias("c"), F.col("product_id").alias("p"))
    related = o.join(F.broadcast(me), (F.col("category_slug") == F.col("c")) & (F.col("product_id") != F.col("p"))).where("current_price is not null")
    return related.orderBy("current_price", "listing_id").limit(6).select("listing_id", "product_id", "current_price")


@query(f"WITH {OFFERS_SQL} SELECT listing_id, original_price - current_price AS savings FROM offers WHERE original_price > current_price")
def f8_positive_savings(spark, d):
    return current(spark, d, "listing_id", "current_price", "original_price").select("listing_id", price.savings(F.col("current_price"), F.col("original_price")).alias("savings")).where("savings > 0")


@query(f"WITH {OFFERS_SQL} SELECT listing_id, product_name, current_price FROM offers WHERE category_slug = 'memory' AND stock_status = 'En stock' AND original_price > current_price AND coalesce(current_price, 0) >= 5000 AND current_price <= 20000")
def f9_facets(spark, d):
    return offers.facets(current(spark, d), category="memory", in_stock=True, on_sale=True, low=5000, high=20000).select("listing_id", "product_name", "current_price")


@query("SELECT listing_id, canonical_name, price FROM product_listings WHERE length(trim(canonical_name)) >= 3 AND price > 0")
def f14_valid_listings(spark, d):
    return read(spark, d, "product_listings").where((F.length(F.trim("canonical_name")) >= 3) & (F.col("price") > 0)).select("listing_id", "canonical_name", "price")


@query("""SELECT p.product_id FROM clean_products p WHERE EXISTS (SELECT 1 FROM product_listings l WHERE l.product_id = p.product_id AND lower(trim(l.source_name)) IN ('zebrak pc', 'ourel micro'))""")
def f17_any_listing_of_sources(spark, d):
    wanted = read(spark, d, "product_listings").where(F.lower(F.trim("source_name")).isin("zebrak pc", "ourel micro")).select("product_id")
    return read(spark, d, "clean_products").join(wanted, "product_id", "left_semi").select("product_id")


@query("SELECT listing_id, coalesce(nullif(trim(source_name), ''), 'Unknown') AS source_name FROM product_listings")
def f19_default_source(spark, d):
    name = F.trim("source_name")
    return read(spark, d, "product_listings").select("listing_id", F.coalesce(F.when(name != "", name), F.lit("Unknown")).alias("source_name"))


@query("SELECT product_id, CASE WHEN brand IS NOT NULL AND brand <> '' AND contains(canonical_name, brand) THEN trim(substr(canonical_name, strpos(canonical_name, brand) + length(brand))) END AS model FROM clean_products")
def f22_model_after_brand(spark, d):
    name, b = F.col("canonical_name"), F.col("brand")
    after = F.trim(F.substr(name, F.instr(name, b) + F.length(b)))
    return read(spark, d, "clean_products").select("product_id", F.when(b.isNotNull() & (b != "") & name.contains(b), after).alias("model"))


@query(f"WITH {OFFERS_SQL} SELECT listing_id, coalesce(original_price > current_price, false) AS has_discount, CAST(CASE WHEN original_price > 0 AND original_price > current_price THEN floor((original_price - current_price) * 100.0 / original_price + 0.5) ELSE 0 END AS BIGINT) AS savings_percent FROM offers")
def f23_discount_flags(spark, d):
    c, o = F.col("current_price"), F.col("original_price")
    percent = F.when((o > 0) & (o > c), price.half_up((o - c) * 100.0 / o)).otherwise(F.lit(0).cast("long"))
    return current(spark, d, "listing_id", "current_price", "original_price").select("listing_id", F.coalesce(o > c, F.lit(False)).alias("has_discount"), percent.alias("savings_percent"))


# ---- joins -------------------------------------------------------------------------------------------------------

@query("SELECT l.listing_id, l.price, s.source_id, s.trust_level FROM product_listings l LEFT JOIN sources s ON s.name = l.source_name WHERE l.price IS NOT NULL")
def j1_listings_with_sources(spark, d):
    s = read(spark, d, "sources").select(F.col("name").alias("source_name"), "source_id", "trust_level")
    return read(spark, d, "product_listings").where("price is not null").join(s, "source_name", "left").select("listing_id", "price", "source_id", "trust_level")


@query("""SELECT listing_id, price_updated_at, current_price, name AS store FROM (
  SELECT v.*, s.name, row_number() OVER (PARTITION BY listing_id ORDER BY price_updated_at DESC, received_at DESC, current_price DESC NULLS LAST, stock_status DESC NULLS LAST) AS k
  FROM price_views v LEFT JOIN sources s ON s.source_id = v.store_id) WHERE k <= 30""")
def j2_price_history(spark, d):
    v = read(spark, d, "price_views").select("listing_id", "store_id", "price_updated_at", "received_at", "current_price", "stock_status")
    order = [F.desc("price_updated_at"), F.desc("received_at"), F.desc_nulls_last("current_price"), F.desc_nulls_last("stock_status")]
    top = offers.top_n_per(v, ["listing_id"], order, 30)
    s = read(spark, d, "sources").select(F.col("source_id").alias("store_id"), F.col("name").alias("store"))
    return top.join(s, "store_id", "left").select("listing_id", "price_updated_at", "current_price", "store")


@query("SELECT o.o_orderkey, o.o_totalprice, c.c_name FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey WHERE o.o_orderstatus = 'O' ORDER BY o.o_orderdate DESC, o.o_orderkey LIMIT 20 OFFSET 40")
def j3_seller_page(spark, d):
    c = read(spark, d, "customer").select("c_custkey", "c_name")
    o = read(spark, d, "orders").where("o_orderstatus = 'O'")
    page = o.orderBy(F.desc("o_orderdate"), "o_orderkey").offset(40).limit(20)
    return page.join(c, page.o_custkey == c.c_custkey, "left").select("o_orderkey", "o_totalprice", "c_name")


@query("""SELECT product_id, listing_id, price, CAST(rn AS BIGINT) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY price, listing_id) AS rn FROM product_listings WHERE product_id IS NOT NULL AND price IS NOT NULL) WHERE rn <= 5""")
def j4_top5_listings(spark, d):
    rows = read(spark, d, "product_listings").where("product_id is not null and price is not null").select("product_id", "listing_id", "price")
    return offers.top_n_per(rows, ["product_id"], [F.asc("price"), F.asc("listing_id")], 5).withColumn("rn", F.col("rn").cast("long"))


@query("""SELECT p.product_id, p.canonical_name, count(*) AS n_listings, min(l.price) AS best, string_agg(CAST(l.price AS VARCHAR), ',' ORDER BY l.price, l.listing_id) AS prices
FROM clean_products p JOIN product_listings l ON l.product_id = p.product_id WHERE l.price IS NOT NULL GROUP BY 1, 2""")
def j5_products_with_listings(spark, d):
    l = read(spark, d, "product_listings").where("product_id is not null and price is not null").groupBy("product_id").agg(
        F.count("*").alias("n_listings"), F.min("price").alias("best"), F.array_sort(F.collect_list(F.struct("price", "listing_id"))).alias("s"))
    p = read(spark, d, "clean_products").select("product_id", "canonical_name")
    return p.join(l, "product_id").select("product_id", "canonical_name", "n_listings", "best", F.array_join(F.transform("s", lambda x: x["price"].cast("string")), ",").alias("prices"))


@query("SELECT p.product_id, coalesce(r.alt_value, p.category) AS category_name FROM clean_products p LEFT JOIN ref_values r ON r.kind = 'category' AND r.value = p.category")
def j7_category_names(spark, d):
    r = read(spark, d, "ref_values").where("kind = 'category'").select(F.col("value").alias("category"), "alt_value")
    return read(spark, d, "clean_products").join(r, "category", "left").select("product_id", F.coalesce("alt_value", "category").alias("category_name"))


@query("""WITH incoming AS (SELECT lower(canonical_name) AS k, min(listing_id) AS listing_id FROM product_listings WHERE canonical_name IS NOT NULL GROUP BY 1)
SELECT 'product' AS side, product_id AS id FROM clean_products UNION ALL
SELECT 'listing', listing_id FROM incoming WHERE k NOT IN (SELECT lower(canonical_name) FROM clean_products WHERE canonical_name IS NOT NULL)""")
def j17_anti_merge(spark, d):
    base = read(spark, d, "clean_products").select(F.lit("product").alias("side"), F.col("product_id").alias("id"), "canonical_name")
    new = read(spark, d, "product_listings").where("canonical_name is not null").select(F.lit("listing").alias("side"), F.col("listing_id").alias("id"), "canonical_name")
    return clusters.anti_merge(base, new, F.lower("canonical_name"), "id").select("side", "id")


@query("""SELECT listing_id, source_name, price FROM product_listings WHERE batch_no < 5 AND coalesce(lower(trim(source_name)) <> 'zebrak pc', true) UNION ALL
SELECT listing_id, source_name, price FROM product_listings WHERE batch_no = 5 AND lower(trim(source_name)) = 'zebrak pc'""")
def j18_replace_source(spark, d):
    rows = read(spark, d, "product_listings").select("listing_id", "source_name", "price", "batch_no")
    mine = F.lower(F.trim("source_name")) == "zebrak pc"
    return clusters.replace_source(rows.where("batch_no < 5"), rows.where("batch_no = 5").where(mine), mine).select("listing_id", "source_name", "price")


@query(f"""WITH {OFFERS_SQL}, watch(item_id, q, cat) AS (VALUES (1, 'granix', NULL), (2, 'nvme', 'storage'), (3, 'qwerty', 'keyboard'))
SELECT w.item_id, count(*) AS n_matches, min(o.current_price) AS cheapest FROM watch w JOIN offers o ON contains(lower(o.product_name), w.q) AND (w.cat IS NULL OR o.category_slug = w.cat) GROUP BY 1""")
def j20_watchlist(spark, d):
    items = spark.createDataFrame([(1, "granix", None), (2, "nvme", "storage"), (3, "qwerty", "keyboard")], "item_id int, q string, cat string")
    o = current(spark, d, "product_name", "category_slug", "current_price").select(F.lower("product_name").alias("n"), "category_slug", "current_price")
    hit = F.col("n").contains(F.col("q")) & (F.col("cat").isNull() | (F.col("category_slug") == F.col("cat")))
    # the watchlist is a parameter of a few rows
    return o.join(F.broadcast(items), hit).groupBy("item_id").agg(F.count("*").alias("n_matches"), F.min("current_price").alias("cheapest"))


# ---- orderings, limits, pages -------------------------------------------------------------------------------------

@query(f"WITH {OFFERS_SQL} SELECT listing_id, product_id, store_name, original_price - current_price AS savings FROM offers WHERE original_price > current_price ORDER BY savings DESC, listing_id LIMIT 10")
def o3_top_deals(spark, d):
    o = current(spark, d, "listing_id", "product_id", "store_name", "current_price", "original_price").withColumn("savings", price.savings(F.col("current_price"), F.col("original_price"))).where("savings > 0")
    return o.orderBy(F.desc("savings"), "listing_id").limit(10).select("listing_id", "product_id", "store_name", "savings")


@query(f"""WITH {OFFERS_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY product_name ORDER BY current_price, listing_id) AS r, count(*) OVER (PARTITION BY product_name) AS n FROM offers WHERE current_price IS NOT NULL)
SELECT product_name, listing_id, round((original_price - current_price) / original_price, 4) AS ratio FROM ranked WHERE r = 1 AND n >= 2 AND original_price > current_price ORDER BY ratio DESC, product_name LIMIT 10""")
def o4_deal_ratio(spark, d):
    first = current(spark, d, "listing_id", "product_name", "current_price", "original_price").where("current_price is not null").groupBy("product_name").agg(F.count("*").alias("n"), F.min(F.struct("current_price", "listing_id", "original_price")).alias("f"))
    c, o = F.col("f.current_price"), F.col("f.original_price")
    deals = first.where((F.col("n") >= 2) & (o > c)).select("product_name", F.col("f.listing_id").alias("listing_id"), F.round((o - c) / o, 4).alias("ratio"))
    return deals.orderBy(F.desc("ratio"), "product_name").limit(10)


@query(f"WITH {OFFERS_SQL} SELECT product_id, max(product_review_count) AS reviews FROM offers WHERE product_id IS NOT NULL GROUP BY 1 ORDER BY reviews DESC NULLS LAST, product_id LIMIT 10")
def o5_trending_products(spark, d):
    return current(spark, d, "product_id", "product_review_count").where("product_id is not null").groupBy("product_id").agg(F.max("product_review_count").alias("reviews")).orderBy(F.desc_nulls_last("reviews"), "product_id").limit(10)


@query(f"WITH {OFFERS_SQL} SELECT listing_id, category_slug, current_price FROM offers ORDER BY category_slug NULLS LAST, current_price NULLS LAST, listing_id LIMIT 100")
def o11_by_category_then_price(spark, d):
    return current(spark, d, "listing_id", "category_slug", "current_price").orderBy(F.asc_nulls_last("category_slug"), F.asc_nulls_last("current_price"), "listing_id").limit(100).select("listing_id", "category_slug", "current_price")


@query("SELECT product_id, canonical_name, listing_count FROM clean_products ORDER BY listing_count DESC NULLS LAST, product_id LIMIT 60")
def o13_cumulative_page(spark, d):
    page = 3
    return read(spark, d, "clean_products").orderBy(F.desc_nulls_last("listing_count"), "product_id").limit(page * 20).select("product_id", "canonical_name", "listing_count")


# ---- windows ------------------------------------------------------------------------------------------------------

@query(f"""WITH {OFFERS_SQL}, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category_slug, product_id ORDER BY listing_id) AS f FROM offers WHERE product_id IS NOT NULL) WHERE f = 1)
SELECT category_slug, product_id, CAST(rn AS BIGINT) AS rn FROM (SELECT category_slug, product_id, row_number() OVER (PARTITION BY category_slug ORDER BY coalesce(product_rating, 0) * 10 + coalesce(product_review_count, 0) DESC, product_id) AS rn FROM one) WHERE rn <= 3""")
def w1_top3_per_category(spark, d):
    one = offers.keep_first(current(spark, d, "category_slug", "product_id", "listing_id", "product_rating", "product_review_count").where("product_id is not null").select("category_slug", "product_id", "listing_id", "product_rating", "product_review_count"), ["category_slug", "product_id"], ["listing_id"])
    score = F.coalesce("product_rating", F.lit(0.0)) * 10 + F.coalesce("product_review_count", F.lit(0))
    return offers.top_n_per(one, ["category_slug"], [score.desc(), F.asc("product_id")], 3).select("category_slug", "product_id", F.col("rn").cast("long").alias("rn"))


@query("SELECT lower(canonical_name) AS name, min(listing_id) AS listing_id FROM product_listings WHERE canonical_name IS NOT NULL GROUP BY 1")
def w3_keep_first(spark, d):
    rows = read(spark, d, "product_listings").where("canonical_name is not null").select(F.lower("canonical_name").alias("name"), "listing_id")
    return offers.keep_first(rows, ["name"], ["listing_id"])


@query(f"""WITH {OFFERS_SQL} SELECT product_id, min(listing_id) AS pos, arg_min(listing_id, (current_price, listing_id)) AS cheapest FROM offers WHERE product_id IS NOT NULL AND current_price IS NOT NULL GROUP BY 1""".replace("arg_min(listing_id, (current_price, listing_id))", "min(listing_id) FILTER (WHERE r = 1)").replace("FROM offers WHERE product_id IS NOT NULL AND current_price IS NOT NULL", "FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY current_price, listing_id) AS r FROM offers WHERE product_id IS NOT NULL AND current_price IS NOT NULL)"))
def w4_first_seen_cheapest(spark, d):
    o = current(spark, d, "listing_id", "product_id", "current_price").where("product_id is not null and current_price is not null")
    return o.groupBy("product_id").agg(F.min("listing_id").alias("pos"), F.min(F.struct("current_price", "listing_id")).alias("c")).select("product_id", "pos", F.col("c.listing_id").alias("cheapest"))


@query("""WITH v AS (SELECT DISTINCT listing_id, price_updated_at, max(current_price) AS p FROM price_views WHERE current_price IS NOT NULL GROUP BY 1, 2)
SELECT listing_id, price_updated_at, old_price, p AS new_price FROM (SELECT *, lag(p) OVER (PARTITION BY listing_id ORDER BY price_updated_at) AS old_price FROM v) WHERE old_price IS NOT NULL AND old_price <> p""")
def w5_price_changes(spark, d):
    v = read(spark, d, "price_views").where("current_price is not null").groupBy("listing_id", "price_updated_at").agg(F.max("current_price").alias("new_price"))
    w = Window.partitionBy("listing_id").orderBy("price_updated_at")
    return v.withColumn("old_price", F.lag("new_price").over(w)).where("old_price <> new_price").select("listing_id", "price_updated_at", "old_price", "new_price")


@query(f"WITH {OFFERS_SQL} SELECT listing_id FROM offers ORDER BY md5(concat('2026-06-01 00:05', '-', CAST(listing_id AS VARCHAR))) LIMIT 20")
def w6_seeded_rotation(spark, d):
    seed = "2026-06-01 00:05"
    return current(spark, d, "listing_id").select("listing_id").orderBy(F.md5(F.concat(F.lit(seed), F.lit("-"), F.col("listing_id").cast("string")))).limit(20)


# ---- set operations ------------------------------------------------------------------------------------------------

@query("SELECT 'product' AS side, canonical_name AS name FROM clean_products UNION ALL SELECT 'listing', canonical_name FROM product_listings UNION ALL SELECT 'result', title FROM scrape_results")
def u1_union_all(spark, d):
    p = read(spark, d, "clean_products").select(F.lit("product").alias("side"), F.col("canonical_name").alias("name"))
    l = read(spark, d, "product_listings").select(F.lit("listing").alias("side"), F.col("canonical_name").alias("name"))
    r = read(spark, d, "scrape_results").select(F.lit("result").alias("side"), F.col("title").alias("name"))
    return p.unionByName(l).unionByName(r)


@query("SELECT brand FROM clean_products WHERE brand IS NOT NULL EXCEPT SELECT value FROM ref_values WHERE kind = 'brand'")
def u5_unknown_brands(spark, d):
    known = read(spark, d, "ref_values").where("kind = 'brand'").select(F.col("value").alias("brand"))
    return read(spark, d, "clean_products").where("brand is not null").select("brand").distinct().join(known, "brand", "left_anti")


@query("""SELECT a.product_id, len(list_intersect(a.w, string_split('ssd nvme 500gb 1tb', ' '))) AS shared FROM (SELECT product_id, list_distinct(string_split(lower(canonical_name), ' ')) AS w FROM clean_products WHERE canonical_name IS NOT NULL) a WHERE len(list_intersect(a.w, string_split('ssd nvme 500gb 1tb', ' '))) > 0""")
def u3_shared_words(spark, d):
    words = F.array(*map(F.lit, "ssd nvme 500gb 1tb".split()))
    rows = read(spark, d, "clean_products").where("canonical_name is not null").select("product_id", F.size(F.array_intersect(F.split(F.lower("canonical_name"), " "), words)).cast("long").alias("shared"))
    return rows.where("shared > 0")


QUERIES, ORACLE_SQL = query.queries, query.sql
