"""Price changes as a stream: recomputed deals, one product's feed, rotation windows, change log."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from pricetide.operators.offers import latest_offers

CHANGES = T.StructType([
    T.StructField("listing_id", T.LongType()), T.StructField("product_id", T.LongType()), T.StructField("store_id", T.LongType()), T.StructField("current_price", T.LongType()),
    T.StructField("original_price", T.LongType()), T.StructField("stock_status", T.StringType()), T.StructField("shipping", T.StringType()), T.StructField("price_updated_at", T.TimestampType()), T.StructField("received_at", T.TimestampType()),
])


def change_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """New change files of a folder as a stream."""
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def product_feed(stream: DataFrame, product_id: int) -> DataFrame:
    """The changes of one product."""
    return stream.where(F.col("product_id") == product_id)


def rotation(stream: DataFrame, length: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Number of changes and best saving of each window; rows later than ``late`` are no longer counted."""
    saving = F.greatest(F.col("original_price") - F.col("current_price"), F.lit(0))
    return stream.withWatermark("price_updated_at", late).groupBy(F.window("price_updated_at", length)).agg(F.count("*").alias("n_changes"), F.max(saving).alias("best_saving"))


def first_seen(stream: DataFrame, late: str = "7 days") -> DataFrame:
    """Changes without repeated deliveries; the state of a key is dropped after ``late``."""
    return stream.withWatermark("price_updated_at", late).dropDuplicatesWithinWatermark(["listing_id", "price_updated_at", "current_price", "stock_status"])


def keep_deals(stream: DataFrame, state_path: str, checkpoint: str, limit: int, then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Keep the current offers under ``state_path`` and give the top deals after every batch.

    The state of batch n is written beside that of n - 1, so a batch that is run
    again after a failure writes the same rows again.
    """
    def apply(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        old_path, new_path = f"{state_path}/{n - 1}", f"{state_path}/{n}"
        old = spark.read.parquet(old_path) if n > 0 else spark.createDataFrame([], CHANGES)
        latest_offers(old.unionByName(batch.select(*old.columns))).select(*[f.name for f in CHANGES]).write.mode("overwrite").parquet(new_path)
        if then:
            now = spark.read.parquet(new_path).withColumn("saving", F.col("original_price") - F.col("current_price"))
            then(now.where("saving > 0").orderBy(F.desc("saving"), "listing_id").limit(limit), n)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def price_changes(stream: DataFrame, checkpoint: str, log_path: str) -> StreamingQuery:
    """Append listing, old and new price of every change of price to a table, those inside one batch too.

    The last price of each listing is kept beside the log as the state after
    each batch; of several prices at one moment the highest counts.
    """
    def apply(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        state = "listing_id long, before long, seen timestamp"
        last = spark.read.parquet(f"{log_path}_last/{n - 1}") if n > 0 else spark.createDataFrame([], state)
        told = batch.where("listing_id is not null and current_price is not null and price_updated_at is not null")
        moments = told.groupBy("listing_id", F.col("price_updated_at").alias("changed_at")).agg(F.max("current_price").alias("new_price"))
        earlier = F.lag("new_price").over(Window.partitionBy("listing_id").orderBy("changed_at"))
        joined = moments.withColumn("earlier", earlier).join(last.select("listing_id", "before"), "listing_id", "left").withColumn("old_price", F.coalesce("earlier", "before"))
        joined.where("not (new_price <=> old_price)").select("listing_id", "old_price", "new_price", "changed_at").write.mode("overwrite").parquet(f"{log_path}/{n}")
        now = moments.select("listing_id", F.col("new_price").alias("before"), F.col("changed_at").alias("seen"))
        both = last.unionByName(now).groupBy("listing_id").agg(F.max_by("before", "seen").alias("before"), F.max("seen").alias("seen"))
        both.write.mode("overwrite").parquet(f"{log_path}_last/{n}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_CHANGE = "listing_id long, old_price long, new_price long, changed_at timestamp"


def stateful_changes(stream: DataFrame, late: str = "1 hour", forget_after_ms: int = 7 * 24 * 3600 * 1000) -> DataFrame:
    """listing_id, old_price, new_price, changed_at of every change of price, with the last price of a listing as state.

    The rows of a listing in one batch are taken in order of time.  The state of
    a listing goes when the watermark has passed its last change by
    ``forget_after_ms``; rows later than ``late`` may be left out.
    """
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        out = []
        rows = pd.concat(list(frames)).sort_values("price_updated_at", kind="stable")
        for at, price in zip(rows["price_updated_at"], rows["current_price"]):
            if last is None or price != last:
                out.append((key[0], last, int(price), at))
                last = int(price)
        state.update((last,))
        seen = int(rows["price_updated_at"].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(seen, state.getCurrentWatermarkMs()) + forget_after_ms)
        if out:
            yield pd.DataFrame(out, columns=["listing_id", "old_price", "new_price", "changed_at"]).astype({"old_price": "Int64"})

    told = stream.where("listing_id is not null and current_price is not null and price_updated_at is not null")
    keyed = told.select("listing_id", "current_price", "price_updated_at").withWatermark("price_updated_at", late).groupBy("listing_id")
    return keyed.applyInPandasWithState(step, _CHANGE, "last long", "append", GroupStateTimeout.EventTimeTimeout)
