"""Aggregates, statistics and comparisons; scalar functions over whole columns; state changes as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricetide.functions import catalog, price, text
from pricetide.operators import clusters, lifecycle, offers, search
from pricetide.plans.catalog_queries import current
from pricetide.plans.registry import OFFERS_SQL, Registry
from pricetide.session import read

query = Registry()

# ---- aggregates -----------------------------------------------------------------------------------------------------


@query("SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 7 DAY FROM events) GROUP BY 1 ORDER BY n DESC, event_type LIMIT 10")
def a1_trending_queries(spark, d):
    e = read(spark, d, "events")
    since = e.agg(F.max("ts").alias("last")).select((F.col("last") - F.expr("INTERVAL 7 DAYS")).alias("since"))
    # one row: the end of the log
    recent = e.join(F.broadcast(since), F.col("ts") >= F.col("since"))
    return recent.groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(10)


@query("SELECT count(*) AS n_searches, CAST(coalesce(sum(CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_hits FROM events WHERE ts >= (SELECT date_trunc('day', max(ts)) FROM events)")
def a2_status_today(spark, d):
    e = read(spark, d, "events")
    today = e.agg(F.date_trunc("day", F.max("ts")).alias("today"))
    return e.join(F.broadcast(today), F.col("ts") >= F.col("today")).agg(F.count("*").alias("n_searches"), F.coalesce(F.sum(F.col("event_type").isin("view", "click").cast("long")), F.lit(0).cast("long")).alias("n_hits"))


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(avg(CASE WHEN event_type IN ('view', 'click') THEN 1.0 ELSE 0.0 END) * 100, 1) AS hit_percent, round(avg(value), 0) AS mean_value FROM events GROUP BY 1")
def a3_daily_stats(spark, d):
    hit = F.when(F.col("event_type").isin("view", "click"), 1.0).otherwise(0.0)
    return read(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.avg(hit) * 100, 1).alias("hit_percent"), F.round(F.avg("value"), 0).alias("mean_value"))


@query("SELECT category, count(*) AS n FROM clean_products GROUP BY 1 ORDER BY n DESC, category NULLS LAST LIMIT 6")
def a4_category_counts(spark, d):
    return read(spark, d, "clean_products").groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("category")).limit(6)


@query("SELECT (SELECT count(*) FROM clean_products) AS n_products, (SELECT count(*) FROM sources) AS n_stores")
def a5_table_counts(spark, d):
    p = read(spark, d, "clean_products").select(F.lit("n_products").alias("k"))
    s = read(spark, d, "sources").select(F.lit("n_stores").alias("k"))
    return p.unionByName(s).agg(F.count_if(F.col("k") == "n_products").alias("n_products"), F.count_if(F.col("k") == "n_stores").alias("n_stores"))


@query(f"WITH {OFFERS_SQL} SELECT product_id, min(current_price) AS best_price, max(current_price) AS worst_price, CAST(floor(avg(current_price) + 0.5) AS BIGINT) AS average_price, count(*) AS listing_count, count(DISTINCT store_id) AS store_count FROM offers WHERE current_price IS NOT NULL GROUP BY 1")
def a6_price_stats(spark, d):
    return offers.price_stats(current(spark, d, "product_id", "store_id", "current_price"))


@query("SELECT l_partkey, min(floor(l_extendedprice * (1 - l_discount))) AS best_price, max(floor(l_extendedprice * (1 - l_discount))) AS worst_price, count(*) AS listing_count, count(DISTINCT l_suppkey) AS store_count FROM lineitem GROUP BY 1")
def a6_price_stats_lineitem(spark, d):
    l = read(spark, d, "lineitem").select("l_partkey", "l_suppkey", F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("double").alias("p"))
    return l.groupBy("l_partkey").agg(F.min("p").alias("best_price"), F.max("p").alias("worst_price"), F.count("*").alias("listing_count"), F.countDistinct("l_suppkey").alias("store_count"))


@query(f"WITH {OFFERS_SQL} SELECT product_id, listing_id, store_name FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY current_price, listing_id) AS r FROM offers WHERE current_price IS NOT NULL AND product_id IS NOT NULL) WHERE r = 1")
def a8_cheapest_listing(spark, d):
    o = current(spark, d, "listing_id", "product_id", "store_name", "current_price").where("current_price is not null and product_id is not null")
    return o.groupBy("product_id").agg(F.min(F.struct("current_price", "listing_id", "store_name")).alias("c")).select("product_id", "c.listing_id", "c.store_name")


@query("SELECT product_id, string_agg(coalesce(source_name, '?') || ':' || CAST(price AS VARCHAR), '; ' ORDER BY price, listing_id) AS listings FROM product_listings WHERE product_id IS NOT NULL AND price IS NOT NULL GROUP BY 1")
def a9_nested_listings(spark, d):
    l = read(spark, d, "product_listings").where("product_id is not null and price is not null")
    s = l.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("price", "listing_id", F.coalesce("source_name", F.lit("?")).alias("s")))).alias("x"))
    return s.select("product_id", F.array_join(F.transform("x", lambda x: F.concat(x["s"], F.lit(":"), x["price"].cast("string"))), "; ").alias("listings"))


@query("SELECT group_id, e.key AS spec_key, arg_min(e.value, candidate_id) AS spec_value FROM (SELECT group_id, candidate_id, unnest(map_entries(specs)) AS e FROM merge_candidates WHERE specs IS NOT NULL) WHERE e.value IS NOT NULL AND e.value <> '' GROUP BY 1, 2")
def a11_merged_specs(spark, d):
    return clusters.merged_specs(read(spark, d, "merge_candidates"), "group_id", "specs", "candidate_id")


@query("SELECT group_id, candidate_id, canonical_name FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY length(canonical_name) + CASE WHEN brand IS NULL OR brand = '' THEN 10 ELSE 0 END, candidate_id) AS r FROM merge_candidates WHERE canonical_name IS NOT NULL) WHERE r = 1")
def a12_shortest_representative(spark, d):
    m = read(spark, d, "merge_candidates").where("canonical_name is not null").select("group_id", "candidate_id", "canonical_name", "brand")
    score = F.length("canonical_name") + F.when(F.col("brand").isNull() | (F.col("brand") == ""), 10).otherwise(0)
    return clusters.representative(m, "group_id", score, ["candidate_id"], largest=False).select("group_id", "candidate_id", "canonical_name")


@query("SELECT group_id, candidate_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY coalesce(length(canonical_name), 0) + 10 * coalesce(len(map_keys(specs)), 0) DESC, candidate_id) AS r FROM merge_candidates) WHERE r = 1")
def a13_fullest_representative(spark, d):
    m = read(spark, d, "merge_candidates").select("group_id", "candidate_id", F.coalesce(F.length("canonical_name"), F.lit(0)).alias("l"), F.coalesce(F.size(F.map_keys("specs")), F.lit(0)).alias("s"))
    size = F.when(F.col("s") < 0, 0).otherwise(F.col("s"))
    return clusters.representative(m, "group_id", F.col("l") + 10 * size, ["candidate_id"]).select("group_id", "candidate_id")


@query("SELECT group_id, arg_min(image_url, candidate_id) AS image_url FROM merge_candidates WHERE image_url LIKE 'http%' GROUP BY 1")
def a14_first_image(spark, d):
    return read(spark, d, "merge_candidates").where(F.col("image_url").startswith("http")).groupBy("group_id").agg(F.min_by("image_url", "candidate_id").alias("image_url"))


@query("""WITH p AS (SELECT o_custkey, o_orderkey, o_totalprice AS price FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY price) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM p),
b AS (SELECT o_custkey, max(n) AS n, max(CASE WHEN i = floor(n * 0.25) THEN price END) AS q1, max(CASE WHEN i = floor(n * 0.75) THEN price END) AS q3 FROM r GROUP BY 1)
SELECT p.o_custkey, p.o_orderkey, p.price FROM p JOIN b USING (o_custkey) WHERE b.n < 3 OR p.price BETWEEN b.q1 - 1.5 * (b.q3 - b.q1) AND b.q3 + 1.5 * (b.q3 - b.q1)""")
def a15_without_outliers(spark, d):
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("price"))
    return offers.without_outliers(o, "o_custkey", "price")


@query(f"""WITH {OFFERS_SQL}, g AS (SELECT lower(product_name) AS model_key, * FROM offers WHERE current_price IS NOT NULL)
SELECT model_key, count(*) AS n_offers, min(current_price) AS low, max(current_price) AS high, max(current_price) - min(current_price) AS savings, arg_min(store_name, current_price * 10000000000 + listing_id) AS cheapest_store FROM g GROUP BY 1 HAVING count(*) >= 2""")
def a16_comparison_table(spark, d):
    g = current(spark, d, "listing_id", "product_name", "store_name", "current_price").where("current_price is not null").groupBy(F.lower("product_name").alias("model_key")).agg(
        F.count("*").alias("n_offers"), F.min("current_price").alias("low"), F.max("current_price").alias("high"), F.min(F.struct("current_price", "listing_id", "store_name")).alias("c"))
    return g.where("n_offers >= 2").select("model_key", "n_offers", "low", "high", (F.col("high") - F.col("low")).alias("savings"), F.col("c.store_name").alias("cheapest_store"))


@query(f"""WITH {OFFERS_SQL} SELECT category_slug, store_name, count(*) AS n, count(current_price) AS n_priced, min(current_price) AS low, max(current_price) AS high, CAST(floor(avg(current_price) + 0.5) AS BIGINT) AS mean,
  CAST(coalesce(sum(CASE WHEN original_price > current_price THEN original_price - current_price END), 0) AS BIGINT) AS savings FROM offers GROUP BY GROUPING SETS ((), (category_slug), (store_name))""")
def a17_catalog_stats(spark, d):
    o = current(spark, d, "category_slug", "store_name", "current_price", "original_price").withColumn("saved", F.when(F.col("original_price") > F.col("current_price"), F.col("original_price") - F.col("current_price")))
    keys = [[], [F.col("category_slug")], [F.col("store_name")]]
    return o.groupingSets(keys, F.col("category_slug"), F.col("store_name")).agg(
        F.count("*").alias("n"), F.count("current_price").alias("n_priced"), F.min("current_price").alias("low"), F.max("current_price").alias("high"),
        price.half_up(F.avg("current_price")).alias("mean"), F.coalesce(F.sum("saved"), F.lit(0)).cast("long").alias("savings"))


@query("SELECT source, count(*) AS n, count(DISTINCT url) AS n_pages, round(1.0 - count(DISTINCT url) * 1.0 / count(*), 4) AS reduction FROM scrape_results GROUP BY 1")
def a19_reduction(spark, d):
    g = read(spark, d, "scrape_results").groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("url").alias("n_pages"))
    return g.withColumn("reduction", F.round(1.0 - F.col("n_pages") * 1.0 / F.col("n"), 4))


@query("SELECT DISTINCT source_name FROM product_listings WHERE source_name IS NOT NULL AND price IS NOT NULL")
def a20_distinct_sources(spark, d):
    return read(spark, d, "product_listings").where("source_name is not null and price is not null").select("source_name").distinct()


@query("""SELECT token, count(DISTINCT product_id) AS n FROM (SELECT product_id, unnest(string_split(trim(regexp_replace(regexp_replace(lower(product_name), '[^A-Za-z0-9_\\s.]', ' ', 'g'), '\\s+', ' ', 'g')), ' ')) AS token FROM price_views WHERE product_name IS NOT NULL AND product_id IS NOT NULL) WHERE token <> '' GROUP BY 1""")
def a22_inverted_index(spark, d):
    p = read(spark, d, "price_views").where("product_name is not null and product_id is not null").select("product_id", "product_name").distinct()
    return p.select("product_id", F.explode(text.words(text.normalize(F.col("product_name")))).alias("token")).distinct().groupBy("token").agg(F.count("*").alias("n"))


@query("SELECT source, count(*) AS n, CAST(count(CASE WHEN image_url IS NOT NULL AND image_url <> '' THEN 1 END) AS BIGINT) AS n_images FROM scrape_results GROUP BY 1")
def a25_with_image(spark, d):
    return read(spark, d, "scrape_results").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("image_url").isNotNull() & (F.col("image_url") != "")).alias("n_images"))


# ---- scalar functions over whole columns ---------------------------------------------------------------------------

@query("""SELECT result_id, CASE WHEN v > 0 AND v < 5000000 THEN v END AS price FROM (SELECT result_id, TRY_CAST(CASE WHEN regexp_matches(t2, '^[0-9]+\\.000$') THEN replace(t2, '.', '') WHEN regexp_matches(t2, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$') THEN t2 END AS DOUBLE) AS v FROM (
  SELECT result_id, CASE WHEN regexp_matches(t, ',[0-9]{1,2}$') THEN replace(t, ',', '.') ELSE replace(t, ',', '') END AS t2 FROM (
    SELECT result_id, regexp_replace(regexp_replace(price, '[\\s  \x0b]', '', 'g'), 'DA|DZD|\\$|€|£|din', '', 'gi') AS t FROM scrape_results)))""")
def x_clean_price(spark, d):
    return read(spark, d, "scrape_results").select("result_id", price.clean_price(F.col("price")).alias("price"))


@query("SELECT product_id, trim(regexp_replace(regexp_replace(strip_accents(lower(canonical_name)), '[^A-Za-z0-9_\\s.]', ' ', 'g'), '\\s+', ' ', 'g')) AS name FROM clean_products")
def x_normalize(spark, d):
    return read(spark, d, "clean_products").select("product_id", text.normalize(F.col("canonical_name")).alias("name"))


@query("SELECT product_id, substr(regexp_replace(regexp_replace(lower(canonical_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 60) AS slug FROM clean_products")
def x_slug(spark, d):
    return read(spark, d, "clean_products").select("product_id", text.slug(F.col("canonical_name")).alias("slug"))


@query("""SELECT product_id, CASE WHEN regexp_matches(lower(canonical_name), 'used|occasion|reconditionné|reconditionne|second hand') THEN 'Used' WHEN regexp_matches(lower(canonical_name), 'tray|oem|bulk|mpk|boite non incluse') THEN 'Tray/OEM' ELSE 'New' END AS condition FROM clean_products""")
def x_condition(spark, d):
    return read(spark, d, "clean_products").select("product_id", catalog.condition(F.col("canonical_name")).alias("condition"))


@query("SELECT listing_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)', 1)), '^www\\.', '') AS host FROM product_listings")
def x_host(spark, d):
    return read(spark, d, "product_listings").select("listing_id", catalog.host(F.col("url")).alias("host"))


@query("SELECT listing_id, CASE WHEN price IS NULL THEN '' ELSE format('{:,}', price) || ' DA' END AS label FROM product_listings")
def x_price_label(spark, d):
    return read(spark, d, "product_listings").select("listing_id", price.format_price(F.col("price")).alias("label"))


@query("SELECT listing_id, NOT regexp_matches(coalesce(stock_status, ''), '(?i)out of stock|rupture|épuisé|indisponible|non disponible') AS in_stock, count(*) AS n FROM price_views GROUP BY 1, 2")
def x_in_stock(spark, d):
    return read(spark, d, "price_views").groupBy("listing_id", catalog.in_stock(F.col("stock_status")).alias("in_stock")).agg(F.count("*").alias("n"))


@query("""SELECT product_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(canonical_name), '[^A-Za-z0-9_\\s]', ' ', 'g'), '\\b(ecran pc|processeur|carte graphique|carte mere|disque dur|boitier|alimentation|clavier|souris|casque|ecran|pc)\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS name FROM clean_products""")
def x_for_matching(spark, d):
    return read(spark, d, "clean_products").select("product_id", text.for_matching(F.col("canonical_name")).alias("name"))


@query("SELECT l.listing_id, levenshtein(regexp_replace(l.canonical_name, '[^ -~]', '', 'g'), regexp_replace(p.canonical_name, '[^ -~]', '', 'g')) AS distance FROM product_listings l JOIN clean_products p ON p.product_id = l.product_id WHERE l.canonical_name IS NOT NULL AND p.canonical_name IS NOT NULL")
def x_levenshtein(spark, d):
    p = read(spark, d, "clean_products").where("canonical_name is not null").select("product_id", F.col("canonical_name").alias("product_name"))
    l = read(spark, d, "product_listings").where("canonical_name is not null").select("listing_id", "product_id", "canonical_name")
    ascii_ = lambda c: F.regexp_replace(c, "[^ -~]", "")  # noqa: E731 - the engines count other letters differently
    return l.join(p, "product_id").select("listing_id", F.levenshtein(ascii_("canonical_name"), ascii_("product_name")).cast("long").alias("distance"))


def x_catalog_record(spark, d):
    """Category, brand, condition, specifications and model key of every scraped title."""
    r = read(spark, d, "scrape_results").where("title is not null").select("result_id", F.col("title").alias("name"), "url", F.lit("Unknown").alias("availability"))
    return catalog.clean_records(r).drop("name", "url", "availability")


# ---- state changes --------------------------------------------------------------------------------------------------

@query("""SELECT listing_id, price, batch_no FROM (SELECT *, row_number() OVER (PARTITION BY url, source_name ORDER BY scraped_at DESC NULLS LAST, listing_id DESC) AS r FROM product_listings WHERE url IS NOT NULL AND source_name IS NOT NULL) WHERE r = 1""")
def m4_upsert_listings(spark, d):
    rows = read(spark, d, "product_listings").where("url is not null and source_name is not null").select("url", "source_name", "scraped_at", "listing_id", "price", "batch_no")
    state, changes = rows.where("batch_no = 0"), rows.where("batch_no > 0")
    return lifecycle.upsert(state, changes, ["url", "source_name"], ["scraped_at", "listing_id"]).select("listing_id", "price", "batch_no")


@query("""WITH o AS (SELECT url, max(price) AS old_price FROM product_listings WHERE batch_no = 0 GROUP BY 1), n AS (SELECT url, max(price) AS new_price FROM product_listings WHERE batch_no > 0 GROUP BY 1)
SELECT n.url, o.old_price, n.new_price FROM n LEFT JOIN o USING (url) WHERE n.new_price IS NOT NULL AND n.new_price IS DISTINCT FROM o.old_price""")
def m5_price_log(spark, d):
    rows = read(spark, d, "product_listings")
    side = lambda c: rows.where(c).groupBy("url").agg(F.max("price").alias("price"))
    return lifecycle.price_log(side("batch_no = 0"), side("batch_no > 0"), ["url"], "price")


@query("""WITH k AS (SELECT lower(trim(name)) AS k, min(CAST(source_id AS VARCHAR)) AS id FROM sources GROUP BY 1), n AS (SELECT lower(trim(source_name)) AS k, min(trim(source_name)) AS source_name FROM product_listings WHERE source_name IS NOT NULL GROUP BY 1)
SELECT n.source_name, coalesce(k.id, md5(n.k)) AS id, k.id IS NULL AS is_new FROM n LEFT JOIN k USING (k)""")
def m6_get_or_create(spark, d):
    known = read(spark, d, "sources").select(F.col("name").alias("source_name"), "source_id")
    return lifecycle.get_or_create(known, read(spark, d, "product_listings").select("source_name"), "source_name", "source_id")


@query("""SELECT listing_id, CASE WHEN expires_at < TIMESTAMP '2026-02-01 00:00:00' THEN 'expired' WHEN scraped_at < TIMESTAMP '2026-02-01 00:00:00' - INTERVAL 6 HOUR THEN 'stale' ELSE 'fresh' END AS state FROM product_listings""")
def m7_states_by_age(spark, d):
    at = F.lit("2026-02-01 00:00:00").cast("timestamp")
    return lifecycle.aged(read(spark, d, "product_listings"), at, F.expr("INTERVAL 6 HOURS")).select("listing_id", "state")


@query("SELECT date_trunc('hour', ts) + INTERVAL (5 * floor(minute(ts) / 5)) MINUTE AS block, count(*) AS n FROM events GROUP BY 1".replace("INTERVAL (5 * floor(minute(ts) / 5)) MINUTE", "to_minutes(CAST(5 * floor(minute(ts) / 5) AS BIGINT))"))
def d4_five_minute_blocks(spark, d):
    return read(spark, d, "events").groupBy(F.window("ts", "5 minutes").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("block"), "n")


# ---- composite operators, checked in the tests ------------------------------------------------------------------------

def search_ranked(spark, d):
    """Every offer that answers a typed query, in order, with its score."""
    rows = current(spark, d, "listing_id", "product_name", "product_brand", "category_slug", "category_name_fr", "store_name", "current_price", "product_review_count")
    found = search.search(search.index(rows), "clavier qwerty switch rouge")
    return search.ranked(found).select("listing_id", F.round("score", 4).alias("score"))


def search_corrections(spark, d):
    vocab = search.vocabulary(current(spark, d, "product_name", "product_brand"))
    return search.corrections(vocab, "grannix nebullo")


def search_suggestions(spark, d):
    return search.suggestions(current(spark, d, "product_name").select(F.col("product_name").alias("name")), "gran")


def search_highlights(spark, d):
    rows = current(spark, d, "product_name").select("listing_id", F.explode(search.highlighted(F.col("product_name"), "granix 16gb")).alias("h"))
    return rows.groupBy("h.match").agg(F.count("*").alias("n"))


def j13_greedy_clusters(spark, d):
    """Products of like names under one brand and category, or of one gpu or cpu, grouped as a greedy pass over them would."""
    chips = [F.try_element_at("specs", F.lit(c)).alias(c) for c in ("gpu", "cpu")]
    p = read(spark, d, "clean_products").select(F.col("product_id").alias("pos"), F.lower("canonical_name").alias("title"), "brand", "category", *chips).where("title is not null")
    return clusters.greedy_clusters(p, clusters.title_edges(p).unionByName(clusters.chip_edges(p)))


for f in (x_catalog_record, search_ranked, search_corrections, search_suggestions, search_highlights, j13_greedy_clusters):
    query()(f)

QUERIES, ORACLE_SQL = query.queries, query.sql
