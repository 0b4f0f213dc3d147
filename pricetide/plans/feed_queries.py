"""Feeds, sinks and streams as queries: rows of the test tables are landed as files, and read, written or streamed back.

The files go to the shared scratch folder, one document for each few hundred
neighbouring ids, so no document grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.operators import taxonomy
from pricetide.plans.catalog_queries import current
from pricetide.plans.registry import OFFERS_SQL, Registry
from pricetide.session import read, scratch_path
from pricetide.sources import readers, sinks
from pricetide.streaming import changes

query = Registry()

#: Ids that share a landed document.
PER_DOCUMENT = 500


def landed(rows: DataFrame, id_column: str, document: Column, label: str) -> str:
    """The path of one file for each range of ids, made by an aggregate over its rows."""
    path = scratch_path(rows.sparkSession, label)
    texts = rows.groupBy(F.floor(F.col(id_column) / PER_DOCUMENT).alias("doc")).agg(document.alias("value"))
    texts.write.partitionBy("doc").text(path)
    return path


def as_json(**fields: Column | str) -> Column:
    return F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(k) for k, c in fields.items()])


def escaped(c: str) -> Column:
    out = F.coalesce(F.col(c).cast("string"), F.lit(""))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


# ---- feeds --------------------------------------------------------------------------------------------------------

@query("""SELECT trim(title) AS name, nullif(trim(price), '') AS price, nullif(trim(url), '') AS url, nullif(trim(image_url), '') AS image, coalesce(nullif(trim(source), ''), 'unknown') AS site, nullif(trim(category), '') AS category,
  nullif(trim(location), '') AS location, nullif(trim(condition), '') AS condition FROM scrape_results WHERE nullif(trim(title), '') IS NOT NULL""")
def s1_raw_records(spark, d):
    record = as_json(title="title", price="price", url="url", imageUrl="image_url", source="source", category="category", location="location", condition="condition")
    path = landed(read(spark, d, "scrape_results"), "result_id", F.to_json(F.struct(F.collect_list(record).alias("products"))), "raw")
    return readers.raw_products(spark, path).select("name", "price", "url", "image", "site", "category", "location", "condition")


@query("SELECT product_id AS id, canonical_name AS name, best_price AS \"bestPrice\" FROM clean_products WHERE length(canonical_name) > 3 AND length(canonical_name) < 200 AND best_price > 1000")
def s2_catalog_products(spark, d):
    record = as_json(id="product_id", name="canonical_name", bestPrice="best_price")
    path = landed(read(spark, d, "clean_products"), "product_id", F.to_json(F.struct(F.collect_list(record).alias("products"))), "catalog")
    there = readers.first_existing(spark, [path + "-missing", path])
    return readers.usable(readers.catalog(spark, there, "struct<id:bigint,name:string,bestPrice:bigint>")).select("id", "name", "bestPrice")


@query("SELECT CAST(n_nationkey + 100 AS BIGINT) AS id, CAST(n_regionkey + 1 AS BIGINT) AS parent_id, n_name AS name, 'a, b' AS notes FROM nation")
def s4_taxonomy_file(spark, d):
    given = {"ID": F.col("n_nationkey") + 100, "Parent_ID": F.col("n_regionkey") + 1, "Name": F.col("n_name"), "Notes": F.lit("a, b")}
    path = scratch_path(spark, "taxonomy")
    read(spark, d, "nation").select(*[given.get(c, F.lit("")).cast("string").alias(c) for c in readers.TAXONOMY_COLUMNS]).write.csv(path, header=True)
    return readers.taxonomy(spark, path).select("id", "parent_id", "name", "notes")


@query("""SELECT nullif(trim(regexp_replace(title, '\\s+', ' ', 'g')), '') AS name, nullif(trim(regexp_replace(price, '\\s+', ' ', 'g')), '') AS price, count(*) AS n FROM scrape_results GROUP BY 1, 2""")
def s5_product_cards(spark, d):
    card = F.concat(F.lit('<div class="card"><h2>'), escaped("title"), F.lit('</h2><span class="p">'), escaped("price"), F.lit("</span></div>"))
    path = landed(read(spark, d, "scrape_results"), "result_id", F.array_join(F.collect_list(card), ""), "pages")
    cards = readers.cards(readers.pages(spark, path), '<div class="card">(.*?)</div>', {"name": ["<h3>(.*?)</h3>", "<h2>(.*?)</h2>"], "price": ['<span class="p">(.*?)</span>']})
    return cards.groupBy("name", "price").agg(F.count("*").alias("n"))


@query("SELECT canonical_name AS name, CAST(price AS DOUBLE) AS price, url, count(*) AS n FROM product_listings GROUP BY 1, 2, 3")
def s10_linked_data(spark, d):
    record = F.struct(F.lit("Product").alias("@type"), F.col("canonical_name").alias("name"), F.col("url"), F.struct(F.col("price").cast("string").alias("price")).alias("offers"))
    block = F.concat(F.lit('<script type="application/ld+json">'), F.to_json(record), F.lit("</script>"))
    path = landed(read(spark, d, "product_listings"), "listing_id", F.array_join(F.collect_list(block), ""), "linked")
    return readers.linked_data(readers.pages(spark, path)).groupBy("name", "price", "url").agg(F.count("*").alias("n"))


@query("SELECT canonical_name AS name, CAST(price AS DOUBLE) AS price, count(*) AS n FROM product_listings WHERE canonical_name <> '' AND price IS NOT NULL GROUP BY 1, 2")
def s10_embedded_products(spark, d):
    record = F.struct(F.struct(F.col("canonical_name").alias("name"), F.col("price")).alias("item"))
    block = F.concat(F.lit('<script type="application/json">{"state": '), F.to_json(F.collect_list(record)), F.lit("}</script>"))
    path = landed(read(spark, d, "product_listings"), "listing_id", block, "embedded")
    return readers.embedded_products(readers.pages(spark, path)).groupBy("name", "price").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT url FROM product_listings WHERE contains(url, '/product/')")
def s7_sitemap_urls(spark, d):
    locs = F.array_join(F.collect_list(F.concat(F.lit("<url><loc> "), F.col("url"), F.lit("\n</loc></url>"))), "")
    path = landed(read(spark, d, "product_listings"), "listing_id", F.concat(F.lit("<urlset>"), locs, F.lit("</urlset>")), "sitemap")
    return readers.sitemap(spark, path)


@query("SELECT substr(trim(regexp_replace(canonical_name, '\\s+', ' ', 'g')), 1, 120) AS name, price, url, count(*) AS n FROM product_listings WHERE price > 1000 GROUP BY 1, 2, 3")
def s9_store_api(spark, d):
    record = as_json(name=F.concat(F.lit("<b>"), escaped("canonical_name"), F.lit("</b>")), prices=F.struct(F.col("price").cast("string").alias("price")), permalink="url")
    path = landed(read(spark, d, "product_listings").where("canonical_name is not null"), "listing_id", F.to_json(F.collect_list(record)), "api")
    return readers.store_api(spark, path).groupBy("name", "price", "url").agg(F.count("*").alias("n"))


@query("""SELECT trim(title) AS name, price, 'https://feed.example/' || slug || '-d' || CAST(result_id AS VARCHAR) AS url, 'In Stock' AS availability FROM
  (SELECT *, 'item-' || CAST(result_id AS VARCHAR) AS slug FROM (SELECT result_id, title, '1500 DA' AS price FROM scrape_results)) AS r
WHERE length(trim(title)) >= 3 AND NOT regexp_matches(lower(title), 'recherche|cherche|achat|échange|location|service')""")
def s8_announcements(spark, d):
    item = as_json(id=F.col("result_id").cast("string"), title="title", slug=F.concat(F.lit("item-"), F.col("result_id")), price=F.lit(1500), status=F.lit("published"))
    nested = F.struct(F.struct(F.struct(F.struct(F.collect_list(item).alias("data")).alias("announcements")).alias("search")).alias("data"))
    path = landed(read(spark, d, "scrape_results"), "result_id", F.to_json(nested), "announcements")
    return readers.announcements(spark, path, "https://feed.example").select("name", "price", "url", "availability")


@query("""SELECT CAST(floor(listing_id / 500) AS BIGINT) AS doc, k AS category, arg_min(url, listing_id) AS url FROM product_listings, (VALUES ('nvme'), ('qwerty')) AS w(k)
WHERE url IS NOT NULL AND contains(lower(url || ' ' || coalesce(canonical_name, '')), k) GROUP BY 1, 2""")
def s12_category_links(spark, d):
    link = F.concat(F.lit('<a href="'), F.col("url"), F.lit('">'), escaped("canonical_name"), F.lit("</a>"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("listing_id", link.alias("html")))), lambda x: x["html"])
    path = landed(read(spark, d, "product_listings").where("url is not null"), "listing_id", F.array_join(in_order, ""), "links")
    found = readers.categories_of(readers.pages(spark, path), {"nvme": ["nvme"], "qwerty": ["qwerty"]})
    return found.select(F.regexp_extract("file", r"doc=(\d+)", 1).cast("long").alias("doc"), "category", "url")


@query("SELECT url, min(trim(regexp_replace(canonical_name, '\\s+', ' ', 'g'))) AS name FROM product_listings WHERE url IS NOT NULL AND canonical_name IS NOT NULL GROUP BY 1")
def s13_shop_cards(spark, d):
    card = F.concat(F.lit('<li class="product"><a href="'), F.col("url"), F.lit('"><h2>'), escaped("canonical_name"), F.lit("</h2></a></li>"))
    path = landed(read(spark, d, "product_listings").where("url is not null and canonical_name is not null"), "listing_id", F.array_join(F.collect_list(card), ""), "shop")
    cards = readers.cards(readers.pages(spark, path), '<li class="product">(.*?)</li>', {"name": ["<h2>(.*?)</h2>"], "url": ['<a href="([^"]+)"']})
    return cards.groupBy("url").agg(F.min("name").alias("name"))


@query("SELECT 'clean' AS site, canonical_name AS name FROM clean_products UNION ALL SELECT 'scraped', title FROM scrape_results")
def s14_fan_in(spark, d):
    def gone():
        raise OSError("the feed is gone")

    rows, _ = readers.fan_in({
        "clean": lambda: read(spark, d, "clean_products").select(F.col("canonical_name").alias("name")), "gone": gone, "scraped": lambda: read(spark, d, "scrape_results").select(F.col("title").alias("name")),
        "unwanted": lambda: read(spark, d, "nation"),
    }, ["clean", "gone", "scraped"])
    return rows.select("site", "name")


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY result_id) AS k FROM scrape_results), b AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY result_id) AS j FROM a WHERE k = 1)
SELECT result_id AS pos, title AS name, url FROM b WHERE j = 1""")
def s16_unseen(spark, d):
    return readers.unseen(read(spark, d, "scrape_results").select(F.col("result_id").alias("pos"), F.col("title").alias("name"), "url"))


@query("SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation")
def s17_with_fallback(spark, d):
    return readers.with_fallback(read(spark, d, "region").select(F.col("r_name").alias("name")), 20, lambda: read(spark, d, "nation").select(F.col("n_name").alias("name")))


@query("""SELECT result_id, title FROM (SELECT *, row_number() OVER (PARTITION BY lower(title) ORDER BY result_id) AS k FROM scrape_results WHERE title IS NOT NULL AND NOT contains(title, '<img') AND NOT contains(title, '<div')) WHERE k = 1 ORDER BY result_id LIMIT 150""")
def s25_seed(spark, d):
    return readers.seed(read(spark, d, "scrape_results").select("result_id", "title"), "result_id")


# ---- sinks --------------------------------------------------------------------------------------------------------

@query("SELECT source_id, name, trust_level FROM sources")
def s20_two_targets(spark, d):
    paths = [scratch_path(spark, f"target-{i}") for i in (1, 2)]
    sinks.to_targets(read(spark, d, "sources").select("source_id", "name", "trust_level"), paths, "json")
    return spark.read.schema("source_id long, name string, trust_level int").json(paths[1])


@query(f"WITH {OFFERS_SQL} SELECT product_id, count(*) AS n_prices, min(current_price) AS lowest FROM offers GROUP BY product_id, product_slug, product_name, product_brand, category_slug")
def s21_catalog_documents(spark, d):
    prices = F.from_json(F.get_json_object("document", "$.prices"), "array<struct<current:bigint>>")
    return sinks.documents(current(spark, d)).select("product_id", F.size(prices).cast("long").alias("n_prices"), F.array_min(F.transform(prices, lambda p: p["current"])).alias("lowest"))


@query("SELECT source AS site, strftime(scraped_at, '%Y-%m') AS run_month, count(*) AS n FROM scrape_results WHERE source IS NOT NULL AND scraped_at IS NOT NULL GROUP BY 1, 2")
def s23_snapshots(spark, d):
    path = scratch_path(spark, "snapshot")
    rows = read(spark, d, "scrape_results").where("source is not null and scraped_at is not null").select(F.col("source").alias("site"), F.date_format("scraped_at", "yyyy-MM").alias("run_month"), "result_id")
    for _ in range(2):  # a run that is written again replaces itself
        sinks.snapshot(rows.repartition("site", "run_month"), path, "site", "run_month")
    kept = spark.read.schema("result_id long, site string, run_month string").parquet(path)
    return kept.groupBy("site", "run_month").agg(F.count("*").alias("n"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, r_name || ' > ' || n_name AS path, lower(n_name) AS first_key FROM nation JOIN region ON r_regionkey = n_regionkey")
def s26_taxonomy_cache(spark, d):
    top = read(spark, d, "region").select((F.col("r_regionkey") + 1000).cast("long").alias("id"), F.lit(0).cast("long").alias("parent_id"), F.col("r_name").alias("name"))
    leaf = read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), (F.col("n_regionkey") + 1000).cast("long").alias("parent_id"), F.col("n_name").alias("name"))
    keyed = taxonomy.search_keys(taxonomy.with_paths(top.unionByName(leaf)).withColumns({"model": F.lit(""), "brand": F.lit("")}))
    path = scratch_path(spark, "taxonomy-cache")
    keyed.write.parquet(path)
    return spark.read.parquet(path).where("id < 1000").select("id", F.array_join("path", " > ").alias("path"), F.get("keys", F.lit(0)).alias("first_key"))


@query("""SELECT listing_id, CASE WHEN length(image_url) < 10 THEN NULL WHEN image_url IS NULL THEN NULL ELSE 'https://images.weserv.nl/?url=' || url_encode(image_url) || '&w=300&q=85&output=webp&n=-1&we' END AS image FROM product_listings""")
def x50_proxied_images(spark, d):
    return read(spark, d, "product_listings").select("listing_id", readers.proxied_image(F.col("image_url")).alias("image"))


# ---- streams --------------------------------------------------------------------------------------------------------

def _feed(spark: SparkSession, d: str) -> DataFrame:
    """The snapshots as a stream of change files."""
    path = scratch_path(spark, "changes")
    read(spark, d, "price_views").select(*changes.CHANGES.fieldNames()).write.parquet(path)
    return changes.change_stream(spark, path)


def _streamed(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives until its feed is read, as a table."""
    spark = stream.sparkSession
    path = scratch_path(spark, "streamed")

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/n={n}")

    changed = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", path + "-checkpoint").trigger(availableNow=True).start()
    changed.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query(f"WITH {OFFERS_SQL} SELECT listing_id, original_price - current_price AS saving FROM offers WHERE original_price > current_price ORDER BY 2 DESC, 1 LIMIT 25")
def t1_deals_after_changes(spark, d):
    path = scratch_path(spark, "deals")
    done = changes.keep_deals(_feed(spark, d), path + "/state", path + "/checkpoint", 25, lambda top, n: top.write.mode("overwrite").parquet(f"{path}/top"))
    done.awaitTermination()
    return spark.read.parquet(f"{path}/top").select("listing_id", "saving")


@query("SELECT listing_id, store_id, current_price, count(*) AS n FROM price_views WHERE product_id = 10 GROUP BY 1, 2, 3")
def t2_product_feed(spark, d):
    return _streamed(changes.product_feed(_feed(spark, d), 10).select("listing_id", "store_id", "current_price")).groupBy("listing_id", "store_id", "current_price").agg(F.count("*").alias("n"))


@query("""SELECT date_trunc('hour', price_updated_at) + to_minutes(CAST(5 * floor(minute(price_updated_at) / 5) AS BIGINT)) AS block, count(*) AS n_changes, max(greatest(original_price - current_price, 0)) AS best_saving
FROM price_views WHERE price_updated_at IS NOT NULL GROUP BY 1""")
def t3_rotation(spark, d):
    windows = changes.rotation(_feed(spark, d)).select(F.col("window.start").alias("block"), "n_changes", "best_saving")
    return _streamed(windows, "complete")


_CHANGES_SQL = """WITH m AS (SELECT listing_id, price_updated_at AS moment, max(current_price) AS p FROM price_views WHERE listing_id IS NOT NULL AND current_price IS NOT NULL AND price_updated_at IS NOT NULL GROUP BY 1, 2),
c AS (SELECT *, lag(p) OVER (PARTITION BY listing_id ORDER BY moment) AS before FROM m) SELECT listing_id, before AS old_price, p AS new_price, CAST(epoch(moment) AS BIGINT) AS changed_s FROM c WHERE p IS DISTINCT FROM before"""


def _in_seconds(rows: DataFrame) -> DataFrame:
    return rows.select("listing_id", "old_price", "new_price", F.unix_seconds("changed_at").alias("changed_s"))


@query(_CHANGES_SQL)
def t4_price_changes(spark, d):
    path = scratch_path(spark, "price-log")
    changes.price_changes(_feed(spark, d), path + "/checkpoint", path + "/log").awaitTermination()
    return _in_seconds(spark.read.schema("listing_id long, old_price long, new_price long, changed_at timestamp").option("recursiveFileLookup", "true").parquet(path + "/log"))


@query(_CHANGES_SQL)
def t4_stateful_changes(spark, d):
    moments = read(spark, d, "price_views").where("listing_id is not null and current_price is not null and price_updated_at is not null").groupBy("listing_id", "price_updated_at").agg(F.max("current_price").alias("current_price"))
    path = scratch_path(spark, "moments")
    moments.select(*[F.col(f.name) if f.name in moments.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in changes.CHANGES]).write.parquet(path)
    return _in_seconds(_streamed(changes.stateful_changes(changes.change_stream(spark, path))))


# ---- pages ----------------------------------------------------------------------------------------------------------

@query(f"""WITH {OFFERS_SQL}, one AS (SELECT * FROM offers WHERE product_slug = (SELECT min(product_slug) FROM price_views)),
rel AS (SELECT DISTINCT o.product_id FROM offers o WHERE o.category_slug = (SELECT min(category_slug) FROM one) AND o.product_id NOT IN (SELECT product_id FROM one WHERE product_id IS NOT NULL) ORDER BY 1 LIMIT 6)
SELECT 'entry' AS part, product_id, listing_id, current_price FROM one UNION ALL SELECT 'related', product_id, NULL, NULL FROM rel""")
def e11_product_page(spark, d):
    """The offers of a product by its slug, and up to six products of its category."""
    views = read(spark, d, "price_views")
    o = current(spark, d, "listing_id", "product_id", "product_slug", "category_slug", "current_price")
    slug = views.agg(F.min("product_slug").alias("product_slug"))
    one = o.join(F.broadcast(slug), "product_slug").select("product_id", "listing_id", "current_price", "category_slug")
    category = one.agg(F.min("category_slug").alias("category_slug"))
    mine = one.select("product_id").where("product_id is not null").distinct()
    related = o.join(F.broadcast(category), "category_slug").where("product_id is not null").join(mine, "product_id", "left_anti").select("product_id").distinct().orderBy("product_id").limit(6)
    entries = one.select(F.lit("entry").alias("part"), "product_id", "listing_id", "current_price")
    return entries.unionByName(related.select(F.lit("related").alias("part"), "product_id", F.lit(None).cast("long").alias("listing_id"), F.lit(None).cast("long").alias("current_price")))


@query(f"""WITH {OFFERS_SQL}, pop AS (SELECT product_id, max(product_review_count) AS n FROM offers WHERE category_slug = 'keyboard' AND product_id IS NOT NULL GROUP BY 1 ORDER BY 2 DESC NULLS LAST, 1 LIMIT 5),
cats AS (SELECT category_slug, count(*) AS n FROM offers WHERE category_slug IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6)
SELECT 'product' AS part, CAST(product_id AS VARCHAR) AS name, n FROM pop UNION ALL SELECT 'category', category_slug, n FROM cats""")
def e13_no_result_suggestions(spark, d):
    """Popular products of what a query without results is about, and the largest categories."""
    from pricetide.operators.search import SearchPlan
    slug = SearchPlan.of("clavier introuvable").intents[0]
    o = current(spark, d, "product_id", "category_slug", "product_review_count")
    popular = o.where((F.col("category_slug") == slug) & F.col("product_id").isNotNull()).groupBy("product_id").agg(F.max("product_review_count").alias("n")).orderBy(F.desc_nulls_last("n"), "product_id").limit(5)
    largest = o.where("category_slug is not null").groupBy("category_slug").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category_slug").limit(6)
    return popular.select(F.lit("product").alias("part"), F.col("product_id").cast("string").alias("name"), "n").unionByName(largest.select(F.lit("category").alias("part"), F.col("category_slug").alias("name"), "n"))


@query("SELECT product_id, count(*) AS n_prices FROM price_views WHERE product_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 2 ORDER BY 2 DESC, 1 LIMIT 10")
def o5_most_offered(spark, d):
    return read(spark, d, "price_views").where("product_id is not null").groupBy("product_id").agg(F.count("*").alias("n_prices")).where("n_prices >= 2").orderBy(F.desc("n_prices"), "product_id").limit(10)


@query(f"WITH {OFFERS_SQL} SELECT listing_id, store_name, original_price - current_price AS savings FROM offers WHERE original_price > current_price ORDER BY store_name DESC NULLS LAST, 3 DESC, 1 LIMIT 30")
def o9_deals_by_store(spark, d):
    o = current(spark, d, "listing_id", "store_name", "current_price", "original_price").where("original_price > current_price")
    return o.select("listing_id", "store_name", (F.col("original_price") - F.col("current_price")).alias("savings")).orderBy(F.desc_nulls_last("store_name"), F.desc("savings"), "listing_id").limit(30)


QUERIES, ORACLE_SQL = query.queries, query.sql
