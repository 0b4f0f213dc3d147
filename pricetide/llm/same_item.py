"""Listings of different sellers that describe the same item.

A dictionary of brand-line-model phrases is mined from listings whose wording is
trusted (a reference brand, a line, a model number).  Brands and lines are found
in every text by one Aho-Corasick automaton, of overlapping hits the longest
counts, and the hit is completed with the model number beside it; a text without
a brand takes the one that the dictionary holds for its line, model and kind of
attributes.  What remains is the variant: attributes in canonical units.  The
variants of a phrase are its largest attribute sets, those that no other set of
the phrase contains; a text that says less belongs to a variant only if exactly
one agrees with it.

All comparisons run over distinct attribute sets of a phrase, never over its
rows, so a phrase that holds a third of all rows costs no more than another.

Defined results: a null, empty or unreadable text forms a group of its own; a
null seller is a seller of its own; repeated rows of one id count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm.batch_dedup import brand_words
from pricetide.llm.product_phrases import PhraseReader, mine_lines, specs_text
from pricetide.session import checkpointed


#: A kind of attribute that fewer of the texts of a phrase state is a stray reading.
KIND_SHARE = 0.05


def entries(clean_products: DataFrame, scrape_results: DataFrame) -> DataFrame:
    """Both tables as one: entry_id, seller, title, specs, typed_brand."""
    a = clean_products.select(
        F.col("product_id").cast("long").alias("entry_id"), F.col("source_name").alias("seller"), F.col("canonical_name").alias("title"),
        specs_text(F.col("specs")).alias("specs"), F.col("brand").alias("typed_brand"),
    )
    b = scrape_results.select(
        F.col("result_id").cast("long").alias("entry_id"), F.col("source").alias("seller"), "title",
        F.lit(None).cast("string").alias("specs"), F.lit(None).cast("string").alias("typed_brand"),
    )
    return a.unionByName(b).where("entry_id is not null")


def readings(entries_: DataFrame, brands: list[str], lines: list[str]) -> DataFrame:
    """entry_id, seller, brand, typed, line, model, attributes (map) of each entry."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = PhraseReader(brands, lines)
        none = lambda x: x if isinstance(x, str) else None
        for frame in frames:
            got = [reader.read(none(t), none(s)) for t, s in zip(frame["title"], frame["specs"])]
            typed = [reader.read(none(b)).brand if isinstance(b, str) else None for b in frame["typed_brand"]]
            yield pd.DataFrame({
                "entry_id": frame["entry_id"], "seller": frame["seller"], "brand": [r.brand for r in got], "typed": typed,
                "line": [r.line for r in got], "model": [r.model for r in got], "attributes": [dict(r.attributes) for r in got],
            })

    return entries_.mapInPandas(read, "entry_id long, seller string, brand string, typed string, line string, model string, attributes map<string,string>")


def _kinds(attributes: str) -> F.Column:
    return F.array_join(F.array_sort(F.map_keys(attributes)), ",")


def with_brand(read: DataFrame) -> DataFrame:
    """Fill missing brands from the phrase dictionary, else from the typed brand.

    The dictionary is a table keyed by line, model and kinds of attributes; only
    entries without a brand meet it, so nothing has to be held in memory.
    """
    whole = read.where("brand is not null and line is not null and model is not null")
    phrases = whole.groupBy("line", "model", _kinds("attributes").alias("kinds"), "brand").agg(F.count("*").alias("n"))
    known = phrases.groupBy("line", "model", "kinds").agg(F.collect_set("brand").alias("brands"))
    lacking = read.where("brand is null and line is not null and model is not null").withColumn("kinds", _kinds("attributes"))
    told = lacking.join(known, ["line", "model", "kinds"], "left").withColumn(
        "brand",
        F.when(F.array_contains("brands", F.col("typed")), F.col("typed")).when(F.size("brands") == 1, F.get("brands", F.lit(0))).otherwise(F.col("typed")),
    )
    rest = read.where("brand is not null or line is null or model is null")
    return rest.unionByName(told.select(*rest.columns))


def groups(entries_: DataFrame, brands: list[str], lines: list[str]) -> DataFrame:
    """entry_id, seller, item_id (null where the item can't be told) of each entry."""
    read = checkpointed(with_brand(checkpointed(readings(entries_, brands, lines))))
    flat = F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    keyed = read.select("entry_id", "seller", "brand", F.coalesce("line", F.when(F.col("model").isNotNull(), F.lit("-"))).alias("line"), "model", flat.alias("facts"))
    key = ["brand", "line", "model"]
    told = keyed.where("brand is not null and line is not null and model is not null")
    counted = checkpointed(told.groupBy(*key, "facts").agg(F.count("*").alias("n")))
    kind = lambda f: F.transform(f, lambda x: F.substring_index(x, "=", 1))
    total = counted.groupBy(*key).agg(F.sum("n").alias("total"))
    stating = counted.select(*key, "n", F.explode(kind(F.col("facts"))).alias("kind")).groupBy(*key, "kind").agg(F.sum("n").alias("n"))
    common = stating.join(total, key).where(F.col("n") >= F.col("total") * KIND_SHARE).groupBy(*key).agg(F.collect_set("kind").alias("kinds"))
    # stray readings of a kind that hardly any text of the phrase states tell nothing apart
    usual = F.filter("facts", lambda x: F.array_contains(F.coalesce("kinds", F.array().cast("array<string>")), F.substring_index(x, "=", 1)))
    kept = checkpointed(counted.join(common, key, "left").select(*key, "facts", usual.alias("usual")))
    sets = kept.select(*key, "usual").distinct()
    wider = sets.withColumnRenamed("usual", "wide")
    inside = sets.join(wider, key).where((F.size("wide") > F.size("usual")) & (F.size(F.array_except("usual", "wide")) == 0)).select(*key, "usual").distinct()
    full = checkpointed(sets.join(inside, [*key, "usual"], "left_anti").select(*key, F.col("usual").alias("variant")))
    agree = F.size(F.array_intersect(kind(F.col("usual")), kind(F.col("variant")))) == F.size(F.array_intersect("usual", "variant"))
    partial = inside.join(full, key).where(agree)
    placed = partial.groupBy(*key, "usual").agg(F.count("*").alias("n"), F.first("variant").alias("variant")).where("n = 1").select(*key, "usual", "variant")
    whole = full.select(*key, F.col("variant").alias("usual"), "variant").unionByName(placed)
    variants = kept.join(whole, [*key, "usual"]).select(*key, "facts", "variant")
    item = F.concat_ws(" ", "brand", "line", "model", F.array_join("variant", " "))
    found = told.join(variants, [*key, "facts"], "left").select("entry_id", "seller", F.when(F.col("variant").isNotNull(), item).alias("item"))
    unread = keyed.where("brand is null or line is null or model is null").select("entry_id", "seller", F.lit(None).cast("string").alias("item"))
    return found.unionByName(unread).distinct()


def same_items(clean_products: DataFrame, scrape_results: DataFrame, ref_values: DataFrame) -> DataFrame:
    """entry_id, seller, item of every entry of both tables."""
    brands = brand_words(ref_values)
    lines = mine_lines(clean_products, "canonical_name", brands)
    return groups(entries(clean_products, scrape_results), brands, lines)


def pairs_across_sellers(grouped: DataFrame) -> DataFrame:
    """id_a, id_b of entries of one item from different sellers, the smaller id first.

    The result names every pair.  Pairs of sellers of an item come first and are
    then filled with their entries, so entries of one seller never meet and the
    joins make no row that is no result.
    """
    seller = F.coalesce(F.trim(F.lower("seller")), F.concat(F.lit("?"), F.col("entry_id").cast("string")))
    rows = grouped.where("item is not null").select("item", "entry_id", seller.alias("seller")).distinct()
    offered = rows.select("item", "seller").distinct()
    sellers = offered.withColumnRenamed("seller", "a").join(offered.withColumnRenamed("seller", "b"), "item").where("a < b")
    left = rows.select("item", F.col("seller").alias("a"), F.col("entry_id").alias("x"))
    right = rows.select("item", F.col("seller").alias("b"), F.col("entry_id").alias("y"))
    pairs = sellers.join(left, ["item", "a"]).join(right, ["item", "b"])
    return pairs.where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
