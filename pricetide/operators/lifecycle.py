"""State changes as pure functions from old to new tables; every one takes its point in time as a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(state: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The state after the changes: of each key the row that comes last in order, changes after state at equal order."""
    both = state.withColumn("_side", F.lit(0)).unionByName(changes.select(*state.columns).withColumn("_side", F.lit(1)))
    rest = [c for c in state.columns if c not in (*keys, *order)]
    last = both.groupBy(*keys).agg(F.max(F.struct(*order, "_side", *rest)).alias("r"))
    return last.select(*keys, "r.*").select(*state.columns)


def upsert_counts(state: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """How many keys an upsert inserts, updates and leaves."""
    s = state.select(*keys).distinct().withColumn("s", F.lit(True))
    c = changes.select(*keys).distinct().withColumn("c", F.lit(True))
    return s.join(c, keys, "full").agg(
        F.count_if(F.col("s").isNull()).alias("inserted"), F.count_if(F.col("s") & F.col("c")).alias("updated"), F.count_if(F.col("c").isNull()).alias("kept"),
    )


def price_log(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, old_price, new_price of every key whose value appeared or changed."""
    o = old.select(*keys, F.col(value).alias("old_price"))
    n = new.select(*keys, F.col(value).alias("new_price"))
    return n.join(o, keys, "left").where("new_price is not null and not (new_price <=> old_price)").select(*keys, "old_price", "new_price")


def aged(listings: DataFrame, as_of: Column, stale_after: Column) -> DataFrame:
    """Listings with their state by age: expired ones first, then stale, else fresh."""
    state = F.when(F.col("expires_at") < as_of, "expired").when(F.col("scraped_at") < as_of - stale_after, "stale").otherwise("fresh")
    return listings.withColumn("state", state)


def retained(history: DataFrame, at: str, as_of: Column, keep: Column) -> DataFrame:
    """Rows of a history that are not older than ``keep``."""
    return history.where(F.col(at) >= as_of - keep)


def get_or_create(known: DataFrame, names: DataFrame, name: str, id_column: str) -> DataFrame:
    """name, id, is_new: the ids of known names, and ids made from the names of unknown ones (compared without case)."""
    k = known.select(F.lower(F.trim(name)).alias("_k"), F.col(id_column).cast("string").alias("id")).where("_k is not null").groupBy("_k").agg(F.min("id").alias("id"))
    n = names.select(F.trim(name).alias(name)).where(F.col(name).isNotNull()).withColumn("_k", F.lower(name)).groupBy("_k").agg(F.min(name).alias(name))
    joined = n.join(k, "_k", "left")
    return joined.select(name, F.coalesce("id", F.md5("_k")).alias("id"), F.col("id").isNull().alias("is_new"))


def cached_or_new(cache: DataFrame, asked: DataFrame, as_of: Column) -> DataFrame:
    """Each asked query with whether an unexpired cache entry answers it, and the hits it has then."""
    live = cache.where(F.col("expires_at") > as_of).select("query_normalized", "hit_count")
    return asked.join(live, "query_normalized", "left").select("query_normalized", F.col("hit_count").isNotNull().alias("cache_hit"), (F.coalesce("hit_count", F.lit(0)) + 1).alias("hit_count"))
