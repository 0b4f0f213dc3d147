"""History of changing attributes: every version of an entity with its period of validity.

Every observation is a unit interval.  In logarithmic rounds neighbouring runs
of intervals are merged pairwise: the right run takes over what the left one
last knew, and intervals of one entity and equal payload that then touch become
one.  The rounds run over whole column batches; what is left of a batch is short,
and its last interval meets the next batch as one more run.

Entities with more than ``CHUNK_ROWS`` observations are cut into spans of equal
numbers of moments by a range partitioning, however unevenly their observations
lie in time; the runs of neighbouring spans are then merged through their first
and last states, so no task holds a hot entity whole and none is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricetide.session import checkpointed

#: Moments of one entity that one task takes on; an entity with more is cut into spans.
CHUNK_ROWS = 200_000

_VERSIONS = "entity long, span long, start long, until long, price long, stock string"


class _Runs(NamedTuple):
    """Intervals in order: the entity and span they belong to, begin, and payload with what is known of it."""

    group: np.ndarray
    at: np.ndarray
    price: np.ndarray
    price_known: np.ndarray
    stock: np.ndarray
    stock_known: np.ndarray
    row: np.ndarray


def _merge_neighbours(runs: _Runs, block: np.ndarray) -> tuple[_Runs, np.ndarray]:
    """One round: the runs 2k and 2k + 1 become run k."""
    heads = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    left = np.repeat(heads, np.diff(np.r_[heads, len(block)])) - 1  # the last interval of the run to the left
    met = (block & 1 == 1) & (runs.group[left] == runs.group)
    payload = []
    for values, known in ((runs.price, runs.price_known), (runs.stock, runs.stock_known)):
        take = met & ~known & known[left]
        payload += [np.where(take, values[left], values), known | take]
    runs = _Runs(runs.group, runs.at, *payload, runs.row)
    block = block >> 1
    equal = (block[1:] == block[:-1]) & (runs.group[1:] == runs.group[:-1])
    for c in payload:
        equal &= c[1:] == c[:-1]
    keep = np.r_[True, ~equal]
    return _Runs(*(c[keep] for c in runs)), block[keep]


def _reduced(runs: _Runs) -> _Runs:
    """The maximal intervals of unit intervals, by log2 rounds of pairwise merging."""
    block = np.arange(len(runs.at))
    while len(block) and block[-1]:
        runs, block = _merge_neighbours(runs, block)
    return runs


def _coalesce(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Merge sorted observations into versions; the state of the open entity goes from batch to batch."""
    pending: tuple | None = None  # the version that is still open: entity, span, start, price, stock
    names = np.array([], dtype=object)
    for frame in frames:
        if not len(frame):
            continue
        entity, span, at = (frame[c].to_numpy(dtype=np.int64) for c in ("entity", "span", "at"))
        price_known = frame["price"].notna().to_numpy()
        price = frame["price"].fillna(0).to_numpy(dtype=np.float64).astype(np.int64)
        told = frame["stock"].to_numpy(dtype=object)
        codes, names = pd.factorize(np.r_[names, told])
        stock = codes[len(codes) - len(told):].astype(np.int64)
        stock_known = stock >= 0
        stock = np.where(stock_known, stock, 0)
        if pending is not None:  # the open version stands before the batch as one more interval
            e, s, t, p, k = pending
            entity, span, at = np.r_[e, entity], np.r_[s, span], np.r_[t, at]
            price_known, price = np.r_[p is not None, price_known], np.r_[0 if p is None else p, price]
            stock_known, stock = np.r_[k is not None, stock_known], np.r_[0 if k is None else k, stock]
        group = np.cumsum(np.r_[True, (entity[1:] != entity[:-1]) | (span[1:] != span[:-1])])
        runs = _reduced(_Runs(group, at, price, price_known, stock, stock_known, np.arange(len(at))))
        entity, span = entity[runs.row], span[runs.row]
        pending = (int(entity[-1]), int(span[-1]), int(runs.at[-1]), int(runs.price[-1]) if runs.price_known[-1] else None, int(runs.stock[-1]) if runs.stock_known[-1] else None)
        until = np.where(runs.group[1:] == runs.group[:-1], runs.at[1:], -1)
        yield _rows(entity[:-1], span[:-1], runs.at[:-1], until, runs.price[:-1], runs.price_known[:-1], runs.stock[:-1], runs.stock_known[:-1], names)
    if pending is not None:
        e, s, t, p, k = pending
        yield pd.DataFrame({"entity": [e], "span": [s], "start": [t], "until": [-1], "price": pd.array([p], dtype="Int64"), "stock": [None if k is None else names[k]]})


def _rows(entity, span, start, until, price, price_known, stock, stock_known, names) -> pd.DataFrame:
    lookup = np.array([*names, None], dtype=object)
    return pd.DataFrame({
        "entity": entity, "span": span, "start": start, "until": until,
        "price": pd.Series(price, dtype="Int64").where(price_known),
        "stock": lookup[np.where(stock_known, stock, len(names))],
    })


def versions(observations: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """entity, start, until, price, stock of every version; until is null for the current one.

    ``observations`` has entity (long), at (long, the moment), rank (the larger
    one counts of several at one moment), price (long) and stock (string).  A
    null price or stock says nothing.  Ties in rank are settled by the larger
    price, then stock.  Rows without entity or moment have no version.
    """
    seen = observations.where("entity is not null and at is not null")
    hot = checkpointed(seen.groupBy("entity").agg(F.count("*").alias("n")).where(F.col("n") > chunk_rows))
    n_hot = hot.agg(F.sum("n")).first()[0]
    latest = F.max(F.struct("rank", "price", "stock")).alias("o")
    cool = seen if n_hot is None else seen.join(hot, "entity", "left_anti")
    # the partitioning by entity already serves the grouping by moment
    moments = cool.select("entity", "at", "rank", "price", "stock").repartition("entity").groupBy("entity", "at").agg(latest)
    open_end = F.when(F.col("until") >= 0, F.col("until")).alias("until")
    ordered = moments.sortWithinPartitions("entity", "at").select("entity", F.lit(0).cast("long").alias("span"), "at", "o.price", "o.stock")
    found = ordered.mapInPandas(_coalesce, _VERSIONS).select("entity", "start", open_end, "price", "stock")
    if n_hot is None:
        return found
    # copies of one moment are merged before they meet, then ranges of equal size are the spans
    moments = seen.join(hot.select("entity"), "entity", "left_semi").groupBy("entity", "at").agg(latest)
    spread = checkpointed(moments).repartitionByRange(-(-n_hot // chunk_rows), "entity", "at").sortWithinPartitions("entity", "at")
    spans = spread.select("entity", F.spark_partition_id().cast("long").alias("span"), "at", "o.price", "o.stock")
    return found.unionByName(_joined_spans(checkpointed(spans.mapInPandas(_coalesce, _VERSIONS))).select("entity", "start", open_end, "price", "stock"))


def _joined_spans(runs: DataFrame) -> DataFrame:
    """Merge the runs of neighbouring spans: later spans take over what earlier ones last knew."""
    inside = Window.partitionBy("entity", "span").orderBy("start")
    across = Window.partitionBy("entity").orderBy("span")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    after = across.rowsBetween(1, Window.unboundedFollowing)
    ends = runs.groupBy("entity", "span").agg(F.max_by("price", "start").alias("last_price"), F.max_by("stock", "start").alias("last_stock"))
    came = ends.select(
        "entity", "span", F.last("last_price", ignorenulls=True).over(before).alias("in_price"),
        F.last("last_stock", ignorenulls=True).over(before).alias("in_stock"), (F.row_number().over(across) == 1).alias("is_first"),
    )
    filled = runs.join(came, ["entity", "span"]).withColumns({"price": F.coalesce("price", "in_price"), "stock": F.coalesce("stock", "in_stock")})
    first = F.row_number().over(inside) == 1
    marked = filled.select(
        "*", first.alias("leads"), F.when(first, F.col("in_price")).otherwise(F.lag("price").over(inside)).alias("old_price"),
        F.when(first, F.col("in_stock")).otherwise(F.lag("stock").over(inside)).alias("old_stock"),
    )
    kept = marked.where((F.col("leads") & F.col("is_first")) | ~F.col("price").eqNullSafe(F.col("old_price")) | ~F.col("stock").eqNullSafe(F.col("old_stock")))
    heads = kept.groupBy("entity", "span").agg(F.min("start").alias("head"))
    follows = heads.select("entity", "span", F.first("head").over(after).alias("next_head"))
    return kept.join(follows, ["entity", "span"]).select("entity", "start", F.coalesce(F.lead("start").over(inside), F.col("next_head")).alias("until"), "price", "stock")


def listing_observations(listings: DataFrame, price_views: DataFrame) -> DataFrame:
    """Observations of each listing that has a snapshot: its own row and its snapshots.

    The own row tells the price at ``scraped_at``; of an own row and a snapshot
    at the same moment the snapshot counts.
    """
    snapshots = price_views.where("listing_id is not null and price_updated_at is not null").select(
        F.col("listing_id").cast("long").alias("entity"), F.unix_micros("price_updated_at").alias("at"),
        F.coalesce(F.unix_micros("received_at"), F.lit(-1).cast("long")).alias("rank"), F.col("current_price").cast("long").alias("price"), F.col("stock_status").cast("string").alias("stock"),
    )
    own = listings.where("listing_id is not null and scraped_at is not null").select(
        F.col("listing_id").cast("long").alias("entity"), F.unix_micros("scraped_at").alias("at"),
        F.lit(-(2**62)).cast("long").alias("rank"), F.col("price").cast("long").alias("price"), F.lit(None).cast("string").alias("stock"),
    )
    return snapshots.unionByName(own.join(snapshots.select("entity").distinct(), "entity", "left_semi"))


def listing_versions(listings: DataFrame, price_views: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """listing_id, valid_from_s, valid_to_s of every version; valid_to_s is 0 for the current one."""
    second = lambda c: F.floor(F.col(c) / 1_000_000).cast("long")
    found = versions(listing_observations(listings, price_views), chunk_rows)
    return found.select(F.col("entity").alias("listing_id"), second("start").alias("valid_from_s"), F.coalesce(second("until"), F.lit(0).cast("long")).alias("valid_to_s")).distinct()


LISTING_VERSIONS_SQL = """
WITH snap AS (
  SELECT listing_id, price_updated_at AS moment, current_price AS price, stock_status AS stock
  FROM (SELECT *, row_number() OVER (PARTITION BY listing_id, price_updated_at
                                     ORDER BY received_at DESC NULLS LAST, current_price DESC NULLS LAST, stock_status DESC NULLS LAST) AS k
        FROM price_views WHERE listing_id IS NOT NULL AND price_updated_at IS NOT NULL) WHERE k = 1),
own AS (
  SELECT listing_id, scraped_at AS moment, price, CAST(NULL AS VARCHAR) AS stock FROM product_listings
  WHERE scraped_at IS NOT NULL AND listing_id IN (SELECT listing_id FROM snap)),
obs AS (
  SELECT * FROM snap UNION ALL
  SELECT * FROM own WHERE NOT EXISTS (SELECT 1 FROM snap s WHERE s.listing_id = own.listing_id AND s.moment = own.moment)),
filled AS (
  SELECT listing_id, moment,
    last_value(price IGNORE NULLS) OVER w AS price, last_value(stock IGNORE NULLS) OVER w AS stock,
    row_number() OVER (PARTITION BY listing_id ORDER BY moment) AS k
  FROM obs WINDOW w AS (PARTITION BY listing_id ORDER BY moment ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
begins AS (
  SELECT listing_id, moment FROM (
    SELECT *, lag(price) OVER v AS old_price, lag(stock) OVER v AS old_stock FROM filled WINDOW v AS (PARTITION BY listing_id ORDER BY moment))
  WHERE k = 1 OR price IS DISTINCT FROM old_price OR stock IS DISTINCT FROM old_stock)
SELECT listing_id, CAST(epoch(moment) AS BIGINT) AS valid_from_s,
  coalesce(CAST(epoch(lead(moment) OVER (PARTITION BY listing_id ORDER BY moment)) AS BIGINT), 0) AS valid_to_s
FROM begins
"""
