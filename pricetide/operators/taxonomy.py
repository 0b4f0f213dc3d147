"""A tree of product kinds: paths by recursion, search keys, and matching of titles to products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.functions.text import scraped_name, squeeze
from pricetide.session import checkpointed


def with_paths(nodes: DataFrame, id_: str = "id", parent: str = "parent_id", name: str = "name") -> DataFrame:
    """Every node that hangs below a root (parent 0 or null) with its path of names.

    Level by level: each round joins only the newest level with its children.
    Orphans and cycles are never reached; no path is longer than there are nodes.
    """
    deepest = nodes.count()
    level = nodes.where(F.coalesce(parent, F.lit(0)) == 0).withColumn("path", F.array(name))
    out = level
    for _ in range(deepest):
        above = level.select(F.col(id_).alias("_up"), F.col("path").alias("_path"))
        level = checkpointed(nodes.where(F.coalesce(parent, F.lit(0)) != 0).join(above, F.col(parent) == F.col("_up")).withColumn("path", F.concat("_path", F.array(name))).drop("_up", "_path"))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def search_keys(products: DataFrame) -> DataFrame:
    """Products (name, model, brand) with the keys under which a title may name them."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    name, model, brand = low("name"), low("model"), low("brand")
    norm = squeeze(F.regexp_replace(name, r"[^A-Za-z0-9_\s]", " "))
    bare = F.when(brand != "", squeeze(F.replace(F.concat(F.lit(" "), norm, F.lit(" ")), F.concat(F.lit(" "), brand, F.lit(" ")), F.lit(" ")))).otherwise(norm)
    keys = F.array(name, model, F.when(brand != "", F.concat(brand, F.lit(" "), name)), norm, bare)
    return products.withColumn("keys", F.filter(F.array_distinct(F.array_compact(keys)), lambda k: F.length(k) > 2))


def candidates(t: DataFrame, keyed: DataFrame) -> DataFrame:
    """title_id, product where a phrase of the product (name, model, keys) begins at a word of the text ``t``.

    What is exploded is far larger than the size that is estimated for it.  Only the first words of
    phrases can be broadcast to it; what is left is shuffled once, and its size known before it is joined.
    """
    canonical = F.when(F.col("model") != "", F.col("model")).otherwise(F.col("name"))
    phrases = keyed.select("product", F.explode(F.array_distinct(F.array_compact(F.concat("keys", F.array(canonical, "model"))))).alias("piece")).where("piece <> ''")
    begin = lambda c: F.when(c.contains(" "), F.concat(F.substring_index(c, " ", 1), F.lit(" "))).otherwise(F.substring(c, 1, 1))
    lengths = phrases.select(begin(F.col("piece")).alias("begin"), F.length("piece").alias("n")).groupBy("begin").agg(F.collect_set("n").alias("lengths"))
    words = F.split("t", " ")
    rests = F.transform(words, lambda w, i: F.array_join(F.slice(words, i + 1, F.size(words)), " "))
    rest = t.select("title_id", F.explode(rests).alias("rest")).where("rest <> ''")
    begins = F.array(F.substring("rest", 1, 1), F.concat(F.substring_index("rest", " ", 1), F.lit(" ")))
    asked = rest.select("title_id", "rest", F.explode(begins).alias("begin")).join(lengths.select("begin"), "begin", "left_semi").repartition("title_id").join(lengths, "begin")
    pieces = asked.select("title_id", F.explode(F.transform("lengths", lambda n: F.substring(F.col("rest"), F.lit(1), n))).alias("piece")).distinct()
    return pieces.join(phrases, "piece").select("title_id", "product").distinct()


def title_matches(titles: DataFrame, products: DataFrame, least: int = 40) -> DataFrame:
    """title_id, product, score of the best product for each title from ``least`` on.

    A key, model or brand counts where it begins at a word of the title; one of
    the keys must share its first word with the title.  Candidates are found by
    whole phrases: from each word of a title on, the pieces of those lengths that
    phrases of this first word have are looked up (for phrases of one word, which
    may end inside a word, of this first letter).
    """
    t = titles.select("title_id", scraped_name(F.col("title")).alias("t")).repartition("title_id")
    text = lambda c: F.lower(F.coalesce(c, F.lit("")))
    keyed = search_keys(products).select(F.col("id").alias("product"), F.lower("name").alias("name"), text("model").alias("model"), text("brand").alias("brand"), "keys")
    # of products that are told alike only the smallest can be the best
    keyed = keyed.groupBy("name", "model", "brand", "keys").agg(F.min("product").alias("product"))
    canonical = F.when(F.col("model") != "", F.col("model")).otherwise(F.col("name"))
    pairs = candidates(t, keyed).join(t, "title_id").join(keyed, "product")
    pairs = pairs.where(F.arrays_overlap(F.transform("keys", lambda k: F.split(k, " ")[0]), F.array_remove(F.split("t", " "), "")))
    inside = lambda c: (c != "") & F.concat(F.lit(" "), F.col("t")).contains(F.concat(F.lit(" "), c))
    score = (
        F.when(inside(canonical), 100).otherwise(0) + F.when(inside(F.col("model")), 80).otherwise(0)
        + F.when(F.exists("keys", inside), 60).otherwise(0) + F.when(inside(F.col("brand")), 20).otherwise(0)
    )
    best = pairs.withColumn("score", score).where(F.col("score") >= least).groupBy("title_id").agg(F.max(F.struct("score", (-F.col("product")).alias("n"))).alias("b"))
    return best.select("title_id", (-F.col("b.n")).alias("product"), F.col("b.score").alias("score"))
