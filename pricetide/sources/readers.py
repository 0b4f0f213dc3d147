"""Landed feeds to rows: JSON documents, CSV, HTML pages, sitemaps.

A feed is a folder of files that a crawler has put down; reading it is one
distributed scan.  Fetching pages is not part of this library.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetide.functions.text import slug, unescape

RAW = T.StructType([T.StructField(c, T.StringType()) for c in (
    "name", "title", "price", "old_price", "availability", "url", "image", "imageUrl", "site", "source", "retailer_name", "sku", "product_id", "category", "location", "condition", "scraped_at")])


def raw_products(spark: SparkSession, path: str) -> DataFrame:
    """Raw records of files that hold {"products": [...]} or a bare array; both dialects under one set of names."""
    array = T.ArrayType(RAW)
    text = spark.read.text(path, wholetext=True).select("value")
    wrapped = F.from_json("value", T.StructType([T.StructField("products", array)]))["products"]
    rows = text.select(F.explode(F.coalesce(wrapped, F.from_json("value", array))).alias("r")).select("r.*")
    return one_dialect(rows)


def one_dialect(rows: DataFrame) -> DataFrame:
    pick = lambda *c: F.coalesce(*[F.when(F.trim(x) != "", F.trim(x)) for x in c])
    return rows.select(
        pick("name", "title").alias("name"), pick("price").alias("price"), pick("old_price").alias("old_price"), F.coalesce("availability", F.lit("Unknown")).alias("availability"), pick("url").alias("url"),
        pick("image", "imageUrl").alias("image"), F.coalesce(pick("site", "source"), F.lit("unknown")).alias("site"), pick("sku", "product_id").alias("sku"), pick("category").alias("category"),
        pick("location").alias("location"), pick("condition").alias("condition"), F.col("scraped_at").try_cast("timestamp").alias("scraped_at"),
    ).where("name is not null")


def catalog(spark: SparkSession, path: str, product: str | None = None) -> DataFrame:
    """Products of catalogue documents {"products": [{..., "prices": [...]}]}; without the type of ``product`` it is inferred over all files."""
    reader = spark.read.schema(f"products array<{product}>") if product else spark.read
    return reader.json(path, multiLine=True).select(F.explode("products").alias("p")).select("p.*")


def usable(products: DataFrame, name: str = "name", price: str = "bestPrice", least: int = 1000) -> DataFrame:
    """Catalogue products with a name of 4 to 199 characters and a price above the least."""
    return products.where((F.length(name) > 3) & (F.length(name) < 200) & (F.col(price) > least))


def seed(rows: DataFrame, order: str, limit: int = 150, title: str = "title") -> DataFrame:
    """The first rows in order to fill an empty catalogue with: one per title without case, none with mark-up in it.  The limit is the feature."""
    clean = rows.where(F.col(title).isNotNull() & ~F.col(title).contains("<img") & ~F.col(title).contains("<div"))
    rest = [c for c in rows.columns if c != order]
    first = clean.groupBy(F.lower(title).alias("_t")).agg(F.min(F.struct(order, *rest)).alias("r"))
    return first.select("r.*").orderBy(order).limit(limit).select(*rows.columns)


def proxied_image(url: Column, width: int = 300, proxy: str = "https://images.weserv.nl/") -> Column:
    """The address of an image behind a resizing proxy; data and already proxied addresses stay, what is too short for one gives null."""
    plain = F.url_encode(url)
    for code, sign in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        plain = F.replace(plain, F.lit(code), F.lit(sign))
    stays = url.contains("weserv.nl") | url.contains("wsrv.nl") | url.startswith("data:")
    return F.when(F.length(url) < 10, F.lit(None)).when(stays, url).otherwise(F.concat(F.lit(f"{proxy}?url="), plain, F.lit(f"&w={width}&q=85&output=webp&n=-1&we")))


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first path that exists."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for p in paths:
        path = hadoop.Path(p)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return p
    return None


TAXONOMY_COLUMNS = ("ID", "Parent_ID", "Node_Type", "Name", "Category", "Brand", "Model", "Key_Specs", "Interface_Socket", "Release_Year", "Price_USD", "Condition", "Notes")


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """The nodes of a taxonomy file; ids that are no numbers become 0, rows without a name are left out."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in TAXONOMY_COLUMNS])
    rows = spark.read.csv(path, header=True, schema=schema, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    ids = {c.lower(): F.coalesce(F.col(c).try_cast("long"), F.lit(0).cast("long")) for c in ("ID", "Parent_ID")}
    return rows.select(*[v.alias(k) for k, v in ids.items()], *[F.coalesce(F.col(c), F.lit("")).alias(c.lower()) for c in TAXONOMY_COLUMNS[2:]]).where("name <> ''")


def pages(spark: SparkSession, path: str) -> DataFrame:
    """file, html of landed pages, one row per file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("html"))


def cards(pages_: DataFrame, card: str, fields: dict[str, list[str]], html: str = "html") -> DataFrame:
    """One row per product card of a page.

    ``card`` is a pattern whose first group is a card; each field has patterns
    from specific to generic, of which the first that finds text counts.
    """
    split = pages_.withColumn("card", F.explode(F.regexp_extract_all(html, F.lit(f"(?s){card}"), F.lit(1))))
    def field(patterns: list[str]) -> Column:
        return F.coalesce(*[F.when(F.trim(F.regexp_extract("card", f"(?s){p}", 1)) != "", F.trim(text_of(F.regexp_extract("card", f"(?s){p}", 1)))) for p in patterns])
    return split.select(*[c for c in pages_.columns if c != html], *[field(p).alias(k) for k, p in fields.items()])


def text_of(html: Column) -> Column:
    """Text without tags and entities."""
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(html, "<[^>]+>", " ")), r"\s+", " "))


def linked_data(pages_: DataFrame, html: str = "html") -> DataFrame:
    """name, price, url of the Product objects in embedded JSON-LD."""
    block = F.explode(F.regexp_extract_all(html, F.lit(r'(?s)<script[^>]*application/ld\+json[^>]*>(.*?)</script>'), F.lit(1)))
    offer = T.StructType([T.StructField("price", T.StringType())])
    schema = T.StructType([T.StructField("@type", T.StringType()), T.StructField("name", T.StringType()), T.StructField("url", T.StringType()), T.StructField("offers", offer)])
    found = pages_.select(*[c for c in pages_.columns if c != html], block.alias("b"))
    one, many = F.from_json("b", schema), F.from_json("b", T.ArrayType(schema))
    rows = found.select(*[c for c in found.columns if c != "b"], F.explode(F.coalesce(F.when(one["@type"].isNotNull(), F.array(one)), many)).alias("p"))
    return rows.where(F.col("p")["@type"] == "Product").select(*[c for c in found.columns if c != "b"], "p.name", F.col("p.offers.price").try_cast("double").alias("price"), "p.url")


MOST_DEPTH = 10


def embedded_products(pages_: DataFrame, html: str = "html", depth: int = MOST_DEPTH) -> DataFrame:
    """name, price of objects with both that lie anywhere, down to ``depth``, in the JSON a page carries in its scripts.

    The nesting differs from page to page, so the objects are walked in Arrow
    batches; scripts that are no JSON are left out.
    """
    keys = [c for c in pages_.columns if c != html]
    block = F.explode(F.regexp_extract_all(html, F.lit(r"(?s)<script[^>]*(?:application/json|__NEXT_DATA__)[^>]*>(.*?)</script>"), F.lit(1)))

    def walk(node: object, level: int) -> list[dict]:
        if level > depth:
            return []
        if isinstance(node, list):
            return [x for child in node for x in walk(child, level + 1)]
        if not isinstance(node, dict):
            return []
        own = [{"name": str(node["name"]), "price": str(node["price"])}] if node.get("name") and isinstance(node.get("price"), (int, float, str)) else []
        return own + [x for child in node.values() for x in walk(child, level + 1)]

    def found(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                out.append(walk(json.loads(t), 0))
            except (TypeError, ValueError):
                out.append([])
        return pd.Series(out, dtype=object)

    read = F.pandas_udf(found, "array<struct<name:string,price:string>>")
    return pages_.select(*keys, block.alias("b")).select(*keys, F.inline(read("b"))).withColumn("price", F.col("price").try_cast("double"))


def sitemap(spark: SparkSession, path: str, part: str = "/product/") -> DataFrame:
    """The distinct urls of sitemap files that contain ``part``."""
    xml = spark.read.text(path, wholetext=True)
    locs = xml.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), F.lit(1))).alias("url"))
    return locs.where(F.col("url").contains(part)).distinct()


BLOCKED_WORDS = ("recherche", "cherche", "achat", "échange", "location", "service")


def announcements(spark: SparkSession, path: str, base_url: str, blocked: tuple[str, ...] = BLOCKED_WORDS) -> DataFrame:
    """Announcements of a GraphQL answer: title, price text, url and image by fallback, availability by status."""
    media = T.StructType([T.StructField("mediaUrl", T.StringType()), T.StructField("thumbnail", T.StringType())])
    item = T.StructType([T.StructField("id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("slug", T.StringType()), T.StructField("price", T.LongType()), T.StructField("oldPrice", T.LongType()),
                         T.StructField("status", T.StringType()), T.StructField("store", T.StructType([T.StructField("name", T.StringType())])), T.StructField("defaultMedia", media), T.StructField("medias", T.ArrayType(media))])
    schema = T.StructType([T.StructField("data", T.StructType([T.StructField("search", T.StructType([T.StructField("announcements", T.StructType([T.StructField("data", T.ArrayType(item))]))]))]))])
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema)["data"]["search"]["announcements"]["data"]).alias("a")).select("a.*")
    title = F.lower("title")
    clean = rows.where(F.length(F.trim("title")) >= 3).where(~reduce(lambda x, y: x | y, (title.contains(b) for b in blocked)))
    return clean.select(
        F.trim("title").alias("name"), F.concat(F.col("price").cast("string"), F.lit(" DA")).alias("price"), F.concat(F.col("oldPrice").cast("string"), F.lit(" DA")).alias("old_price"),
        F.concat(F.lit(base_url + "/"), F.coalesce("slug", slug(F.col("title"))), F.lit("-d"), F.col("id")).alias("url"),
        F.coalesce(F.col("defaultMedia.mediaUrl"), F.col("defaultMedia.thumbnail"), F.get(F.col("medias"), F.lit(0))["mediaUrl"]).alias("image"),
        F.when(F.upper("status") == "PUBLISHED", "In Stock").otherwise("Unknown").alias("availability"), F.col("store.name").alias("retailer_name"),
    )


def store_api(spark: SparkSession, path: str, least: int = 1000) -> DataFrame:
    """Products of a store API answer [{name, prices{price}, permalink}] above a least price; titles of at most 120 characters."""
    schema = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("prices", T.StructType([T.StructField("price", T.StringType())])), T.StructField("permalink", T.StringType())]))
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema)).alias("p"))
    return rows.select(F.substring(text_of(F.col("p.name")), 1, 120).alias("name"), F.col("p.prices.price").try_cast("long").alias("price"), F.col("p.permalink").alias("url")).where(F.col("price") > least)


def categories_of(pages_: DataFrame, keywords: dict[str, list[str]], html: str = "html") -> DataFrame:
    """page, category, url: of each page the first link of each category whose address or text has one of its words."""
    keys = [c for c in pages_.columns if c != html]
    links = F.arrays_zip(F.regexp_extract_all(html, F.lit(r'(?s)<a[^>]*href="([^"]+)"[^>]*>.*?</a>'), F.lit(1)).alias("u"), F.regexp_extract_all(html, F.lit(r'(?s)<a[^>]*href="[^"]+"[^>]*>(.*?)</a>'), F.lit(1)).alias("t"))
    rows = pages_.select(*keys, F.posexplode(links).alias("pos", "l"))
    said = F.lower(F.concat(F.col("l.u"), F.lit(" "), text_of(F.col("l.t"))))
    parts = [rows.where(reduce(lambda a, b: a | b, (said.contains(w) for w in words))).select(*keys, F.lit(c).alias("category"), "pos", F.col("l.u").alias("url")) for c, words in keywords.items()]
    return reduce(DataFrame.unionByName, parts).groupBy(*keys, "category").agg(F.min_by("url", "pos").alias("url"))


def fan_in(sources: dict[str, Callable[[], DataFrame]], wanted: list[str] | None = None) -> tuple[DataFrame | None, dict[str, str]]:
    """The union of the named sources; one that fails counts as empty and is reported."""
    out, failed = None, {}
    for name, make in sources.items():
        if wanted and name not in wanted:
            continue
        try:
            part = make().withColumn("site", F.lit(name))
            part.schema  # analysis errors show here
        except Exception as e:  # noqa: BLE001 - a broken feed must not stop the others
            failed[name] = str(e).split("\n")[0]
            continue
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out, failed


def with_fallback(rows: DataFrame, least: int, more: Callable[[], DataFrame]) -> DataFrame:
    """The rows, and those of a second source where there are fewer than ``least``."""
    return rows.unionByName(more(), allowMissingColumns=True) if rows.limit(least).count() < least else rows


def unseen(rows: DataFrame, order: str = "pos") -> DataFrame:
    """Rows whose name and url are both new: the first of each name, then the first of each url among them."""
    first = rows.groupBy("name").agg(F.min(F.struct(order, *[c for c in rows.columns if c not in ("name", order)])).alias("r")).select("name", "r.*")
    return first.groupBy("url").agg(F.min(F.struct(order, *[c for c in rows.columns if c not in ("url", order)])).alias("r")).select("url", "r.*").select(*rows.columns)


def enriched(rows: DataFrame, details: DataFrame, key: str, column: str) -> DataFrame:
    """Fill a missing column from landed detail records."""
    extra = details.select(key, F.col(column).alias("_more")).dropDuplicates([key])
    return rows.join(extra, key, "left").withColumn(column, F.coalesce(column, "_more")).drop("_more")
