"""End-user queries and remaining operators: product, search, seller and status pages, filters, sorts, arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricetide.functions import catalog, kinds, price, text
from pricetide.operators import clusters, lifecycle, offers, search, taxonomy
from pricetide.plans import rule_sql
from pricetide.plans.catalog_queries import current
from pricetide.plans.registry import OFFERS_SQL, Registry
from pricetide.session import read

query = Registry()


# ---- filters ------------------------------------------------------------------------------------------------------

@query(f"WITH {OFFERS_SQL} SELECT listing_id, current_price FROM offers WHERE current_price >= 5000 AND current_price <= 20000")
def f10_price_range(spark, d):
    _, low, high = search.price_bounds("5000-20000")
    return current(spark, d).where(F.col("current_price").between(low, high)).select("listing_id", "current_price")


@query(f"WITH {OFFERS_SQL} SELECT listing_id, category_slug FROM offers WHERE {rule_sql.fits('product_name', 'category_slug')}")
def f11_fitting_offers(spark, d):
    """Current offers whose title can stand under their category."""
    return current(spark, d, "listing_id", "product_name", "category_slug").where(kinds.fits_slug(F.col("product_name"), F.col("category_slug"))).select("listing_id", "category_slug")


@query(f"SELECT result_id, title FROM scrape_results WHERE {rule_sql.portable_on_page('title')}")
def f12_portables_on_page(spark, d):
    """Scraped titles that the browse page takes for a portable computer."""
    return read(spark, d, "scrape_results").where(kinds.is_portable_on_page(F.col("title"))).select("result_id", "title")


@query(f"SELECT result_id, title FROM scrape_results WHERE {rule_sql.portable('title')}")
def f13_portables(spark, d):
    """Scraped titles that describe a portable computer."""
    return read(spark, d, "scrape_results").where(kinds.is_portable(F.col("title"))).select("result_id", "title")


@query("SELECT listing_id, url FROM product_listings WHERE length(url) > 5")
def f16_with_url(spark, d):
    return read(spark, d, "product_listings").where(F.length("url") > 5).select("listing_id", "url")


@query("SELECT l.listing_id, l.price, l.condition, s.name AS source, s.trust_level FROM product_listings l JOIN sources s ON s.name = l.source_name")
def f20_two_tables_as_structs(spark, d):
    l, s = read(spark, d, "product_listings"), read(spark, d, "sources")
    both = l.join(s, l.source_name == s.name).select(F.struct(l.listing_id, l.price, l.condition).alias("listing"), F.struct(s.name, s.trust_level).alias("source"))
    return both.select("listing.listing_id", "listing.price", "listing.condition", F.col("source.name").alias("source"), "source.trust_level")


@query("SELECT product_id, CAST(row_number() OVER (PARTITION BY product_id ORDER BY price, listing_id) - 1 AS BIGINT) AS pos, price FROM product_listings WHERE product_id IS NOT NULL AND price IS NOT NULL")
def f21_flattened_prices(spark, d):
    nested = read(spark, d, "product_listings").where("product_id is not null and price is not null").groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("price", "listing_id"))).alias("prices"))
    flat = nested.select("product_id", F.posexplode("prices").alias("pos", "p"))
    return flat.select("product_id", F.col("pos").cast("long").alias("pos"), F.col("p.price").alias("price"))


# ---- joins --------------------------------------------------------------------------------------------------------

@query("""WITH t AS (SELECT DISTINCT product_id, unnest(string_split(trim(regexp_replace(regexp_replace(strip_accents(lower(product_name)), '[^A-Za-z0-9_\\s.]', ' ', 'g'), '\\s+', ' ', 'g')), ' ')) AS token FROM price_views WHERE product_name IS NOT NULL AND product_id IS NOT NULL)
SELECT DISTINCT product_id FROM t WHERE token IN ('granix', 'nvme', 'qwerty')""")
def j9_token_candidates(spark, d):
    p = read(spark, d, "price_views").where("product_name is not null and product_id is not null").select("product_id", "product_name").distinct()
    postings = p.select("product_id", F.explode(text.words(text.normalize(F.col("product_name")))).alias("token"))
    asked = spark.createDataFrame([(t,) for t in search.tokens("granix nvme qwerty")], "token string")
    return postings.join(F.broadcast(asked), "token", "left_semi").select("product_id").distinct()


def j14_best_match(spark, d):
    """For each scraped title the product with the highest match score from 10 on; the tables give neither categories nor identifiers in common.

    Products are compared where they share a word of four letters or more with
    the number behind it, not all with all.
    """
    p = read(spark, d, "clean_products").where("canonical_name is not null").select(F.col("product_id").alias("right_id"), F.col("canonical_name").alias("b_name"), F.lower("brand").alias("b_brand"))
    r = read(spark, d, "scrape_results").where("title is not null").select(F.col("result_id").alias("left_id"), F.col("title").alias("a_name"))
    key = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([a-z]{4,}\s+\d{4})"), F.lit(1))))
    a, b = r.withColumn("block", key(F.col("a_name"))), p.withColumn("block", key(F.col("b_name")))
    none = F.array().cast("array<string>")
    score = kinds.match_score(F.col("a_name"), F.col("b_name"), none, none, F.lit(""), F.col("b_brand"), F.lit(True))
    return clusters.best_match(a, b, ["block"], score, "left_id", "right_id", 10)


@query("SELECT DISTINCT l.source_name, s.source_id FROM product_listings l JOIN sources s ON s.name = l.source_name")
def j19_ids_by_name(spark, d):
    s = read(spark, d, "sources").select(F.col("name").alias("source_name"), "source_id")
    return read(spark, d, "product_listings").select("source_name").distinct().join(s, "source_name")


@query("""WITH RECURSIVE node(id, parent_id, name) AS (SELECT * FROM (SELECT 1000 + r_regionkey, -1, r_name FROM region UNION ALL SELECT n_nationkey, 1000 + n_regionkey, n_name FROM nation) AS both_),
walk(id, path) AS (SELECT id, name FROM node WHERE parent_id = -1 UNION ALL SELECT n.id, w.path || ' > ' || n.name FROM node n JOIN walk w ON n.parent_id = w.id) SELECT CAST(id AS BIGINT) AS id, path FROM walk""")
def j22_tree_paths(spark, d):
    top = read(spark, d, "region").select((F.col("r_regionkey") + 1000).cast("long").alias("id"), F.lit(0).cast("long").alias("parent_id"), F.col("r_name").alias("name"))
    leaf = read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), (F.col("n_regionkey") + 1000).cast("long").alias("parent_id"), F.col("n_name").alias("name"))
    return taxonomy.with_paths(top.unionByName(leaf)).select("id", F.array_join("path", " > ").alias("path"))


def j15_taxonomy_matches(spark, d):
    """For each document title the part name it contains; parts as taxonomy."""
    parts = read(spark, d, "clean_products").where("canonical_name is not null").select(F.col("product_id").alias("id"), F.regexp_extract(F.lower("canonical_name"), r"([a-z]{4,} \d{4})", 1).alias("name"), F.lit("").alias("model"), F.lower("brand").alias("brand")).where("name <> ''")
    parts = parts.groupBy("name").agg(F.min("id").alias("id"), F.first("model").alias("model"), F.min("brand").alias("brand"))
    titles = read(spark, d, "scrape_results").select(F.col("result_id").alias("title_id"), "title")
    return taxonomy.title_matches(titles, parts)


# ---- aggregates -----------------------------------------------------------------------------------------------------

@query(f"WITH {OFFERS_SQL} SELECT count(DISTINCT store_id) AS n_stores, count(DISTINCT product_id) AS n_products FROM offers")
def a7_distinct_stores(spark, d):
    return current(spark, d, "product_id", "store_id").agg(F.countDistinct("store_id").alias("n_stores"), F.countDistinct("product_id").alias("n_products"))


@query("SELECT category, lower(replace(canonical_name, ' ', '-')) AS model_key, count(*) AS n, min(product_id) AS first_id FROM clean_products WHERE category IS NOT NULL GROUP BY 1, 2")
def a10_by_model_key(spark, d):
    return read(spark, d, "clean_products").where("category is not null").groupBy("category", F.lower(F.replace(F.col("canonical_name"), F.lit(" "), F.lit("-"))).alias("model_key")).agg(F.count("*").alias("n"), F.min("product_id").alias("first_id"))


@query("SELECT source_type, condition, count(*) AS n, CAST(floor(sum(price) / count(price)) AS BIGINT) AS mean, min(price) AS low, max(price) AS high FROM product_listings WHERE price IS NOT NULL GROUP BY GROUPING SETS ((source_type), (condition), ())")
def a18_run_summary(spark, d):
    l = read(spark, d, "product_listings").where("price is not null")
    sets = [[F.col("source_type")], [F.col("condition")], []]
    return l.groupingSets(sets, F.col("source_type"), F.col("condition")).agg(F.count("*").alias("n"), F.expr("sum(price) div count(price)").alias("mean"), F.min("price").alias("low"), F.max("price").alias("high"))


@query(f"WITH {OFFERS_SQL} SELECT category_slug, round(avg(CASE WHEN original_price > current_price THEN (original_price - current_price) * 1.0 / original_price ELSE 0.0 END), 6) AS savings_rate FROM offers GROUP BY 1")
def a24_savings_rate(spark, d):
    c, o = F.col("current_price"), F.col("original_price")
    return current(spark, d, "category_slug", "current_price", "original_price").groupBy("category_slug").agg(F.round(F.avg(F.when(o > c, (o - c) * 1.0 / o).otherwise(0.0)), 6).alias("savings_rate"))


@query(f"""WITH {OFFERS_SQL} SELECT 'granix' AS q, count(*) AS n, min(current_price) AS cheapest, arg_min(listing_id, current_price * 10000000000 + listing_id) AS listing_id FROM offers WHERE contains(lower(product_name), 'granix') AND current_price IS NOT NULL""")
def a23_watch_cheapest(spark, d):
    o = current(spark, d, "listing_id", "product_name", "current_price").where(F.lower("product_name").contains("granix")).where("current_price is not null")
    return o.agg(F.count("*").alias("n"), F.min(F.struct("current_price", "listing_id")).alias("c")).select(F.lit("granix").alias("q"), "n", F.col("c.current_price").alias("cheapest"), F.col("c.listing_id").alias("listing_id"))


# ---- sorts and pages ------------------------------------------------------------------------------------------------

@query("SELECT source_id, name FROM sources ORDER BY name LIMIT 10")
def o2_by_name(spark, d):
    return read(spark, d, "sources").orderBy("name").limit(10).select("source_id", "name")


@query(f"WITH {OFFERS_SQL} SELECT listing_id, coalesce(current_price, 0) AS p FROM offers ORDER BY coalesce(current_price, 0), listing_id LIMIT 20")
def o7_price_ascending(spark, d):
    p = F.coalesce("current_price", F.lit(0))
    return current(spark, d, "listing_id", "current_price").orderBy(p, "listing_id").limit(20).select("listing_id", p.alias("p"))


@query(f"WITH {OFFERS_SQL} SELECT listing_id, CAST(CASE WHEN original_price > current_price THEN floor((original_price - current_price) * 100.0 / original_price + 0.5) ELSE 0 END AS BIGINT) AS discount FROM offers ORDER BY discount DESC, listing_id LIMIT 20")
def o8_by_discount(spark, d):
    c, o = F.col("current_price"), F.col("original_price")
    discount = F.when(o > c, price.half_up((o - c) * 100.0 / o)).otherwise(F.lit(0).cast("long"))
    return current(spark, d, "listing_id", "current_price", "original_price").select("listing_id", discount.alias("discount")).orderBy(F.desc("discount"), "listing_id").limit(20)


@query("SELECT listing_id, price FROM product_listings WHERE price IS NOT NULL ORDER BY price DESC, listing_id LIMIT 20 OFFSET 20")
def o12_second_page(spark, d):
    return read(spark, d, "product_listings").where("price is not null").orderBy(F.desc("price"), "listing_id").offset(20).limit(20).select("listing_id", "price")


@query("SELECT slug FROM (SELECT trim(regexp_replace(regexp_replace(lower(canonical_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')) AS slug, best_price, product_id FROM clean_products WHERE best_price IS NOT NULL AND canonical_name IS NOT NULL) WHERE slug <> '' ORDER BY best_price DESC, product_id LIMIT 200")
def o16_sitemap_slugs(spark, d):
    p = read(spark, d, "clean_products").where("best_price is not null and canonical_name is not null").withColumn("slug", text.slug(F.col("canonical_name"), 1000))
    return p.where("slug <> ''").orderBy(F.desc("best_price"), "product_id").limit(200).select("slug")


# ---- arrays, maps, sets, dates ----------------------------------------------------------------------------------------

@query("SELECT product_id, e.key AS k, e.value AS v FROM (SELECT product_id, unnest(map_entries(specs)) AS e FROM clean_products WHERE specs IS NOT NULL)")
def r1_exploded_specs(spark, d):
    return read(spark, d, "clean_products").where("specs is not null").select("product_id", F.explode("specs").alias("k", "v"))


@query("SELECT source_id, len(category_focus) AS n, list_contains(category_focus, 'memory') AS has_memory, array_to_string(list_sort(category_focus), ',') AS joined FROM sources")
def r2_array_functions(spark, d):
    a = F.col("category_focus")
    return read(spark, d, "sources").select("source_id", F.size(a).cast("long").alias("n"), F.array_contains(a, "memory").alias("has_memory"), F.array_join(F.array_sort(a), ",").alias("joined"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def r4_json_fields(spark, d):
    return read(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT DISTINCT source_id FROM (SELECT source_id, unnest(category_focus) AS c FROM sources) WHERE c IN ('memory', 'laptop')")
def u2_union_of_postings(spark, d):
    return read(spark, d, "sources").where(F.arrays_overlap("category_focus", F.array(F.lit("memory"), F.lit("laptop")))).select("source_id")


@query("SELECT DISTINCT brand FROM merge_candidates WHERE brand IS NOT NULL")
def u4_distinct(spark, d):
    return read(spark, d, "merge_candidates").where("brand is not null").select("brand").distinct()


@query("SELECT listing_id, scraped_at + INTERVAL 24 HOUR AS expires, date_trunc('day', scraped_at) AS day, CAST(scraped_at AS DATE) AS date FROM product_listings")
def d1_dates(spark, d):
    t = F.col("scraped_at")
    return read(spark, d, "product_listings").select("listing_id", (t + F.expr("INTERVAL 24 HOURS")).alias("expires"), F.date_trunc("day", t).alias("day"), F.to_date(t).alias("date"))


# ---- scalar functions ---------------------------------------------------------------------------------------------------

@query("""SELECT result_id, CASE WHEN euro <> '' THEN CAST(replace(euro, '.', '') AS BIGINT) WHEN spaced <> '' THEN CAST(regexp_replace(spaced, '\\s', '', 'g') AS BIGINT) WHEN plain <> '' THEN CAST(plain AS BIGINT) END AS price FROM (
  SELECT result_id, regexp_extract(t, '([0-9]{1,3}(?:\\.[0-9]{3})+)', 1) AS euro, regexp_extract(t, '([0-9]{1,3}(?:\\s+[0-9]{3})+)', 1) AS spaced, regexp_extract(t, '([0-9]{3,})', 1) AS plain FROM (
    SELECT result_id, trim(regexp_replace(replace(regexp_replace(regexp_replace(price, 'د\\.ج|DZD|Dinar|Prix', '', 'gi'), 'DA\\b', '', 'gi'), ',', ''), '[\\s\\x{00a0}\\x{202f}]+', ' ', 'g')) AS t FROM scrape_results))""")
def x_scraped_price(spark, d):
    return read(spark, d, "scrape_results").select("result_id", price.scraped_price(F.col("price")).alias("price"))


@query("SELECT listing_id, CASE WHEN o = c THEN 80 WHEN abs(c - o) * 2.0 / (c + o) <= 0.1 THEN 50 WHEN abs(c - o) * 2.0 / (c + o) <= 0.25 THEN 25 ELSE 0 END AS band FROM (SELECT listing_id, current_price AS c, original_price AS o, price_updated_at FROM price_views WHERE current_price IS NOT NULL AND original_price IS NOT NULL)")
def x_distance_bands(spark, d):
    v = read(spark, d, "price_views").where("current_price is not null and original_price is not null")
    return v.select("listing_id", price.spec_distance_score(F.col("current_price"), F.col("original_price")).alias("band"))


@query("SELECT result_id, CAST(round(v / 2.0) AS BIGINT) AS up FROM (SELECT result_id, result_id % 1000 AS v FROM scrape_results)")
def x_half_up(spark, d):
    return read(spark, d, "scrape_results").select("result_id", price.half_up((F.col("result_id") % 1000) / 2.0).alias("up"))


@query("""SELECT product_id, lower(regexp_replace(coalesce(source_name, 'unknown'), '\\s+', '', 'g')) || '-' || substr(regexp_replace(lower(canonical_name), '[^A-Za-z0-9_]', '', 'g'), 1, 30) AS offer_id FROM clean_products""")
def x_offer_id(spark, d):
    return read(spark, d, "clean_products").select("product_id", text.offer_id(F.col("canonical_name"), F.col("source_name")).alias("offer_id"))


@query(f"SELECT result_id, {rule_sql.cascade('title')} AS cascade, {rule_sql.slug_of('title')} AS slug, {rule_sql.engine_category('title', 'url')} AS engine FROM scrape_results")
def x_title_categories(spark, d):
    """The category of every scraped title under the cascade, the converter and the engine."""
    t = F.col("title")
    return read(spark, d, "scrape_results").select("result_id", kinds.cascade(t).alias("cascade"), kinds.slug_of(t).alias("slug"), kinds.engine_category(t, F.col("url")).alias("engine"))


def x_title_kinds(spark, d):
    """Search tokens, phonetic keys and identifiers of every scraped title."""
    t = F.col("title")
    r = read(spark, d, "scrape_results").select("result_id", "title")
    return r.select("result_id", text.tokenize(t).alias("tokens"), text.phonetic_key(t).alias("sound"), catalog.model_identifiers(t).alias("ids"), text.hash31(t).alias("hash"))


# ---- end-user pages -----------------------------------------------------------------------------------------------------

@query("""SELECT l.listing_id, coalesce(l.price IS NOT NULL AND l.expires_at >= TIMESTAMP '2026-01-15 00:00:00', false) AS available, l.url FROM (SELECT 106 AS id) q LEFT JOIN product_listings l ON l.listing_id = q.id""")
def e3_verify_link(spark, d):
    asked = spark.createDataFrame([(106,)], "id long")
    l = read(spark, d, "product_listings").where("listing_id = 106")
    j = F.broadcast(asked).join(l, F.col("id") == F.col("listing_id"), "left")
    return j.select("listing_id", F.coalesce(F.col("price").isNotNull() & (F.col("expires_at") >= F.lit("2026-01-15 00:00:00").cast("timestamp")), F.lit(False)).alias("available"), "url")


@query("""WITH page AS (SELECT product_id, canonical_name FROM clean_products WHERE category = 'memory' ORDER BY canonical_name, product_id LIMIT 20),
top AS (SELECT * FROM (SELECT l.*, row_number() OVER (PARTITION BY product_id ORDER BY price, listing_id) AS r FROM product_listings l WHERE price IS NOT NULL) WHERE r <= 5)
SELECT p.product_id, p.canonical_name, count(t.listing_id) AS n_listings, min(t.price) AS best FROM page p LEFT JOIN top t USING (product_id) GROUP BY 1, 2""")
def e4_products_by_category(spark, d):
    page = read(spark, d, "clean_products").where("category = 'memory'").orderBy("canonical_name", "product_id").limit(20).select("product_id", "canonical_name")
    l = read(spark, d, "product_listings").where("price is not null").select("product_id", "listing_id", "price")
    mine = l.join(F.broadcast(page.select("product_id")), "product_id", "left_semi")  # a page of twenty
    top = offers.top_n_per(mine, ["product_id"], [F.asc("price"), F.asc("listing_id")], 5)
    return page.join(top, "product_id", "left").groupBy("product_id", "canonical_name").agg(F.count("listing_id").alias("n_listings"), F.min("price").alias("best"))


@query("""SELECT p.product_id, p.canonical_name, l.n, l.best FROM clean_products p JOIN (SELECT product_id, count(*) AS n, min(price) AS best FROM product_listings WHERE price IS NOT NULL GROUP BY 1) l USING (product_id) WHERE p.canonical_name ILIKE '%granix%' ORDER BY l.best, p.product_id LIMIT 20""")
def e5_search_with_listings(spark, d):
    p = read(spark, d, "clean_products").where(F.col("canonical_name").ilike("%granix%")).select("product_id", "canonical_name")
    l = read(spark, d, "product_listings").where("price is not null").groupBy("product_id").agg(F.count("*").alias("n"), F.min("price").alias("best"))
    return p.join(l, "product_id").orderBy("best", "product_id").limit(20)


@query("""SELECT s.name, s.last_scraped_at, count(l.listing_id) AS n FROM sources s LEFT JOIN product_listings l ON l.source_name = s.name GROUP BY 1, 2""")
def e7_source_status(spark, d):
    l = read(spark, d, "product_listings").groupBy(F.col("source_name").alias("name")).agg(F.count("*").alias("m"))
    return read(spark, d, "sources").join(l, "name", "left").select("name", "last_scraped_at", F.coalesce("m", F.lit(0).cast("long")).alias("n"))


@query(f"""WITH {OFFERS_SQL}, deals AS (SELECT product_id, listing_id, original_price - current_price AS saved FROM offers WHERE original_price > current_price), one AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY saved DESC, listing_id) AS r FROM deals)
SELECT product_id, listing_id, saved FROM one WHERE r = 1 ORDER BY saved DESC, listing_id LIMIT 10""")
def e14_live_deals(spark, d):
    o = current(spark, d, "listing_id", "product_id", "current_price", "original_price").where("original_price > current_price").withColumn("saved", F.col("original_price") - F.col("current_price"))
    one = o.groupBy("product_id").agg(F.max(F.struct("saved", (-F.col("listing_id")).alias("n"))).alias("b")).select("product_id", (-F.col("b.n")).alias("listing_id"), F.col("b.saved").alias("saved"))
    return one.orderBy(F.desc("saved"), "listing_id").limit(10)


@query(f"""WITH {OFFERS_SQL} SELECT event_type AS query_normalized, n > 1900 AS cache_hit, CASE WHEN n > 1900 THEN n + 1 ELSE 1 END AS hit_count FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)""")
def m1_search_cache(spark, d):
    logged = read(spark, d, "events").groupBy(F.col("event_type").alias("query_normalized")).agg(F.count("*").alias("hit_count"))
    at = F.lit("2026-01-01").cast("timestamp")
    cache = logged.where("hit_count > 1900").withColumn("expires_at", F.lit("2026-01-02").cast("timestamp"))
    return lifecycle.cached_or_new(cache, logged.select("query_normalized"), at)


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN o_orderdate + INTERVAL 7 DAY END AS expires_at, o_orderstatus = 'O' AS is_active FROM orders")
def m3_renewed_listings(spark, d):
    active = F.col("o_orderstatus") == "O"
    return read(spark, d, "orders").select("o_orderkey", F.when(active, F.col("o_orderdate") + F.expr("INTERVAL 7 DAYS")).alias("expires_at"), active.alias("is_active"))


@query("SELECT listing_id, price_updated_at, current_price FROM price_views WHERE price_updated_at >= TIMESTAMP '2026-03-01 00:00:00' - INTERVAL 30 DAY AND price_updated_at < TIMESTAMP '2026-03-01 00:00:00'")
def m7_retained_history(spark, d):
    at = F.lit("2026-03-01 00:00:00").cast("timestamp")
    kept = lifecycle.retained(read(spark, d, "price_views"), "price_updated_at", at, F.expr("INTERVAL 30 DAYS"))
    return kept.where(F.col("price_updated_at") < at).select("listing_id", "price_updated_at", "current_price")


@query("SELECT o.o_orderkey, coalesce(c.c_mktsegment, '?') AS filled FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey")
def m10_filled_from_details(spark, d):
    from pricetide.sources.readers import enriched
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.lit(None).cast("string").alias("c_mktsegment"))
    return enriched(o, read(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment").select("o_orderkey", F.coalesce("c_mktsegment", F.lit("?")).alias("filled"))


@query("""WITH p AS (SELECT product_id, canonical_name, brand FROM clean_products WHERE product_id = 35), l AS (SELECT l.*, s.source_id FROM product_listings l LEFT JOIN sources s ON s.name = l.source_name WHERE l.product_id = 35 AND l.price IS NOT NULL)
SELECT p.product_id, p.canonical_name, p.brand, l.listing_id, l.price, l.source_id FROM p LEFT JOIN l ON l.product_id = p.product_id""")
def e1_product_page(spark, d):
    p = read(spark, d, "clean_products").where("product_id = 35").select("product_id", "canonical_name", "brand")
    s = read(spark, d, "sources").select(F.col("name").alias("source_name"), "source_id")
    l = read(spark, d, "product_listings").where("product_id = 35 and price is not null").join(s, "source_name", "left").select("product_id", "listing_id", "price", "source_id")
    return p.join(l, "product_id", "left")


@query("SELECT product_id, canonical_name FROM clean_products WHERE canonical_name ILIKE '%basalte%' ORDER BY product_id LIMIT 1")
def e2_product_by_name(spark, d):
    return read(spark, d, "clean_products").where(F.col("canonical_name").ilike("%basalte%")).orderBy("product_id").limit(1).select("product_id", "canonical_name")


@query(f"WITH {OFFERS_SQL} SELECT listing_id, product_name, product_brand FROM offers WHERE category_slug = 'storage' AND (product_name ILIKE '%nvme%' OR product_brand ILIKE '%nvme%') ORDER BY listing_id LIMIT 20")
def e10_products(spark, d):
    o = current(spark, d, "listing_id", "product_name", "product_brand", "category_slug").where("category_slug = 'storage'").where(F.col("product_name").ilike("%nvme%") | F.col("product_brand").ilike("%nvme%"))
    return o.orderBy("listing_id").limit(20).select("listing_id", "product_name", "product_brand")


@query(f"""WITH {OFFERS_SQL}, pool AS (SELECT * FROM offers WHERE category_slug = 'keyboard' AND contains(lower(product_name), 'qwerty')), one AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY listing_id) AS r FROM pool)
SELECT product_id, listing_id, current_price FROM one WHERE r = 1 ORDER BY coalesce(current_price, 0), listing_id LIMIT 40""")
def e12_browse_page(spark, d):
    pool = current(spark, d, "listing_id", "product_id", "product_name", "category_slug", "current_price").where("category_slug = 'keyboard'").where(F.lower("product_name").contains("qwerty")).select("product_id", "listing_id", "current_price")
    one = pool.groupBy("product_id").agg(F.min(F.struct("listing_id", "current_price")).alias("f")).select("product_id", "f.listing_id", "f.current_price")
    return one.orderBy(F.coalesce("current_price", F.lit(0)), "listing_id").limit(40)


@query(f"SELECT coalesce(category, '?') AS old, {rule_sql.engine_category('title', 'url')} AS new, count(*) AS n FROM scrape_results GROUP BY 1, 2")
def m9_recategorized(spark, d):
    """How many titles change their category under the engine's rules."""
    t = read(spark, d, "scrape_results").select(F.coalesce("category", F.lit("?")).alias("old"), kinds.engine_category(F.col("title"), F.col("url")).alias("new"))
    return t.groupBy("old", "new").agg(F.count("*").alias("n"))


def x_title_specs(spark, d):
    """Cleaned titles with every specification that they state."""
    r = read(spark, d, "scrape_results").where("title is not null").select("result_id", text.without_fluff(F.col("title")).alias("title"))
    return r.select("result_id", "title", kinds.title_specs(F.col("title")).alias("specs"))


for f in (x_title_specs, j14_best_match, j15_taxonomy_matches, x_title_kinds):
    query()(f)

QUERIES, ORACLE_SQL = query.queries, query.sql
