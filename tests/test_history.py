"""Versions of changing entities against a plain loop."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pricetide.operators.history import listing_versions, versions

OBS = "entity long, at long, rank long, price long, stock string"


def brute(rows):
    out, by = [], {}
    for e, at, rank, p, s in rows:
        if e is None or at is None:
            continue
        key, new = (e, at), ((rank, -1 if p is None else p, s or ""), p, s)
        if key not in by or by[key][0] < new[0]:
            by[key] = new
    for e in {k[0] for k in by}:
        p = s = None
        begun = []
        for at in sorted(k[1] for k in by if k[0] == e):
            _, np_, ns = by[e, at]
            q, t = (p if np_ is None else np_), (s if ns is None else ns)
            if not begun or (q, t) != (p, s):
                begun.append((at, q, t))
            p, s = q, t
        out += [(e, at, begun[i + 1][0] if i + 1 < len(begun) else None, q, t) for i, (at, q, t) in enumerate(begun)]
    return sorted(out, key=repr)


def rows(seed, n=400):
    r = random.Random(seed)
    # entity 1 holds a third of all rows
    return [(r.choice([1, 1, 1, 2, 3, 4, 5, 6, 7, None]), r.choice([*range(60), None]), r.randrange(3), r.choice([None, 10, 20]), r.choice([None, "a", "b"])) for _ in range(n)]


@pytest.mark.parametrize("chunk", [3, 25, 100_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_like_a_loop(spark, chunk, seed):
    data = rows(seed)
    got = versions(spark.createDataFrame(data, OBS).repartition(3), chunk)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == brute(data)


def test_across_arrow_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        data = rows(3)
        got = versions(spark.createDataFrame(data, OBS))
        assert sorted([tuple(r) for r in got.collect()], key=repr) == brute(data)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty(spark):
    assert versions(spark.createDataFrame([], OBS)).count() == 0


def test_listings(spark):
    listings = spark.createDataFrame([(1, 5, "2026-01-01 00:00:10"), (2, 7, "2026-01-01 00:00:00"), (None, 1, None)], "listing_id long, price long, scraped_at string").withColumn("scraped_at", F.col("scraped_at").cast("timestamp")).withColumn("entity", F.lit("clash")).withColumn("span", F.lit(0))
    views = spark.createDataFrame([(1, 5, None, "2026-01-01 00:00:20", None), (1, 5, "x", "2026-01-01 00:00:30", "2026-01-01"), (1, 5, "x", "2026-01-01 00:00:30", "2026-01-01"), (1, 6, "x", "2026-01-01 00:00:05", "2026-01-02"), (3, None, None, None, None)],
                                  "listing_id long, current_price long, stock_status string, u string, r string").select("*", F.col("u").cast("timestamp").alias("price_updated_at"), F.col("r").cast("timestamp").alias("received_at"), F.lit(1).alias("at"))
    t0 = 1767225600
    got = sorted(tuple(r) for r in listing_versions(listings, views).collect())
    assert got == [(1, t0 + 5, t0 + 10), (1, t0 + 10, 0)]


def test_merging_in_rounds_makes_the_versions(spark, monkeypatch):
    from pricetide.operators import history as h
    data = rows(4)
    frame = [(e, 0, at, p, s) for e, at, _, p, s in data if e is not None and at is not None]
    frame = pd.DataFrame(sorted({r[:3]: r for r in frame}.values(), key=lambda r: r[:3]), columns=["entity", "span", "at", "price", "stock"])
    got = pd.concat(h._coalesce(iter([frame])))
    assert len(got) < len(frame)
    rounds = []
    merge = h._merge_neighbours
    monkeypatch.setattr(h, "_merge_neighbours", lambda r, b: rounds.append(1) or merge(r, b))
    list(h._coalesce(iter([frame])))
    assert len(rounds) == (len(frame) - 1).bit_length()
    monkeypatch.setattr(h, "_reduced", lambda r: r)
    assert len(pd.concat(h._coalesce(iter([frame])))) == len(frame)


def test_a_burst_is_spread_over_spans(spark):
    """Most observations of the hot entity lie in one of its last seconds."""
    data = [(1, 0, 0, 1, "a")] + [(1, 10_000_000 + i, 0, i // 7 % 3, None) for i in range(500)] + [(2, 5, 0, 1, None)]
    got = versions(spark.createDataFrame(data, OBS).repartition(3), 50)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == brute(data)
