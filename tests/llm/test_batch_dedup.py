from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pricetide.llm import batch_dedup as bd

SCHEMA = "listing_id long, batch_no int, canonical_name string, sku string, url string, condition string"
REF = [("brand", 1, "Velmora"), ("brand", 2, "Kortexia")]


def row(i, b, name, url="https://a.example/p/1", sku=None, cond="new"):
    return (i, b, name, sku, url, cond)


def run(spark, rows):
    listings = spark.createDataFrame(rows, SCHEMA).withColumns({"root": F.lit(1), "first_id": F.lit("x"), "offer_key": F.lit(0)})
    ref = spark.createDataFrame(REF, "kind string, ref_id long, value string")
    return {tuple(r) for r in bd.repeats(listings, ref).collect()}


BASE = [row(i, 0, f"Velmora Granix {1000 + i} 16GB 3200MHz", f"https://a.example/p/{i}") for i in range(1, 9)]


def test_repeats(spark):
    rows = BASE + [
        row(20, 1, "PROMO GRANIX 1001 VELMORA 16 Go / 3.2GHz", "http://www.A.example:80/other"),  # the same offer in other words
        row(21, 1, "Velmora Granix 1001 32GB 3200MHz"), row(22, 1, "Velmora Granix 1001 16GB 3200MHz", cond="used"), row(23, 1, "Velmora Granix 1001 16GB 3200MHz", "https://b.example/p"),
        row(24, 1, "Velmora Granix 1001K 16GB 3200MHz"), row(30, 2, "Velmora Granix 1001 32GB 3200MHz"), row(31, 2, "Velmora Granix 1001 32 GB 3200Mhz"), row(32, 3, "Velmora Granix 1002 16GB 3200MHz"),
    ]
    assert run(spark, rows) == {(1, 20), (21, 30), (21, 31), (2, 32)}


def test_repeats_that_say_less_or_are_not_read(spark):
    words = "Lot tres rare sans reference connue du fabricant avec boite origine"
    rows = BASE + [
        row(9, 0, words), row(20, 1, "Velmora Granix 1001 16GB"), row(21, 1, "Granix 1002 16GB 3200MHz"),  # no attribute, no brand
        row(23, 1, "Velmora Granix 1003 32GB"), row(24, 1, "Velmora Granix 1004 16GB", cond="used"), row(25, 1, "Lot tres rare et autres choses du fabricant avec boite"),
    ]
    rows += [row(10, 0, "Velmora Granix 1005 32GB 3200MHz"), row(26, 1, "Velmora Granix 1005 3200MHz"), row(27, 2, "Velmora Granix 1001 16GB 3600MHz")]  # two agree; agrees with 20 but not with 1
    assert run(spark, rows) == {(1, 20), (2, 21)}


def test_odd_rows(spark):
    rows = BASE + [row(40, 1, None, None, None, None), row(41, 1, "", "", "", ""), row(42, 1, "x " * 50_000), row(43, 2, "x " * 50_000), row(43, 2, "x " * 50_000), row(44, 2, None, None, None, None), (45, None, "n", None, None, None)]
    assert run(spark, rows) == {(42, 43), (40, 44)}


def test_empty(spark):
    assert run(spark, []) == set()
    assert run(spark, BASE) == set()


def test_every_near_fingerprint_shares_a_block(spark):
    r = random.Random(1)
    rows = []
    for i in range(200):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), bd.MOST_BITS):
            b ^= 1 << bit
        rows.append((i, *(x - (1 << 64) if x >> 63 else x for x in (a, b))))
    df = spark.createDataFrame(rows, "i int, a long, b long")
    assert df.where(~F.arrays_overlap(bd._blocks(F.col("a")), bd._blocks(F.col("b")))).count() == 0


@pytest.mark.parametrize("url, shop", [("https://www.Shop-A.example:443/x?y", "shop-a.example"), ("http://shop.b.example/", "b.example"), ("//c.example/x", "c.example"), ("nonsense", ""), (None, "")])
def test_shop_of(spark, url, shop):
    assert spark.createDataFrame([(url,)], "u string").select(bd.shop_of(F.col("u"))).first()[0] == shop


def bits_between(a, b):
    f = bd.Fingerprint()
    x, y = (f.of(bd.weighted_parts(t)) & (2**64 - 1) for t in (a, b))
    return (x ^ y).bit_count()


def test_wordings_that_say_less_lie_within_the_bits():
    r = random.Random(5)
    near = 0
    for _ in range(300):
        facts = [f"{k}={r.randrange(99)}" for k in r.sample(["memory", "disk", "mhz", "hz", "inch", "watt", "colour"], r.randrange(1, 6))]
        head = ["item", f"brand{r.randrange(50)}", f"line{r.randrange(20)}", str(r.randrange(1000, 9999))]
        less = [*head, *facts]
        del less[r.randrange(4, len(less))]
        near += bits_between(" ".join([*head, *facts]), " ".join(less)) <= bd.MOST_BITS and bits_between(" ".join([*head, *facts]), " ".join(["item", "?", *head[2:], *facts])) <= bd.MOST_BITS
        assert bits_between(" ".join(head), " ".join([*head[:3], head[3] + "k"])) > bd.MOST_BITS
    assert near == 300


def test_fingerprints_of_long_texts():
    text = "words " + "x" * 100_000
    assert bd.Fingerprint().of(bd.weighted_parts(text)) == bd.Fingerprint().of(bd.weighted_parts(text))
    assert bits_between("words and a long common tail of many words", "words and a long common tail of many word") <= 6


def test_every_pair_comes_from_the_first_table_it_meets_in(spark):
    r = random.Random(2)
    rows = []
    for i in range(100):
        a = r.getrandbits(63)
        b = a
        for bit in r.sample(range(63), r.randrange(4)):
            b ^= 1 << bit
        rows.append((i, a, b))
    df = spark.createDataFrame(rows, "i int, a long, b long")
    n = bd.first_table(F.col("a").bitwiseXOR(F.col("b")))
    same = F.array_position(F.zip_with(bd._blocks(F.col("a")), bd._blocks(F.col("b")), lambda x, y: x == y), F.lit(True)) - 1
    assert df.where(~n.eqNullSafe(same.cast("int"))).count() == 0


def test_nothing_is_found_without_the_block_tables(spark, monkeypatch):
    rows = BASE + [row(20, 1, "Velmora Granix 1001 16GB 3200MHz"), row(21, 2, "Granix 1002 16GB 3200MHz")]
    assert run(spark, rows) == {(1, 20), (2, 21)}
    monkeypatch.setattr(bd, "rotated", lambda offers, rotated=bd.rotated: rotated(offers.limit(0)))
    assert run(spark, rows) == set()


def test_parts_are_merged_and_removed(spark):
    store = bd.OfferStore(spark, ["velmora"])
    batch = lambda n: spark.createDataFrame([row(n * 10 + i, n, f"Velmora Granix {1000 + n * 10 + i} 16GB") for i in range(4)], SCHEMA)
    for n in range(5):
        store.accept(batch(n))
    assert sum(rows for _, rows in store.parts) == 20 and len(store.parts) < 4
    assert {tuple(r) for r in store.accept(batch(2)).collect()} == set()
    again = spark.createDataFrame([row(90, 6, "Granix 1021 Velmora 16 Go")], SCHEMA)
    assert {tuple(r) for r in store.accept(again).collect()} == {(21, 90)}
    store.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(store.name)]


def test_same_as_grouping(spark, data):
    """On the test data every offer is readable, so the repeats are those of a plain grouping."""
    from pricetide.llm.product_phrases import PhraseReader, mine_lines
    listings, ref = spark.read.parquet(f"{data}/product_listings.parquet"), spark.read.parquet(f"{data}/ref_values.parquet")
    brands = bd.brand_words(ref)
    reader = PhraseReader(brands, mine_lines(listings, "canonical_name", brands))
    first, want = {}, set()
    rows = listings.select("listing_id", "batch_no", bd.shop_of(F.col("url")).alias("shop"), "condition", "canonical_name").orderBy("listing_id").collect()
    for r in rows:
        key = (r["shop"], r["condition"], reader.read(r["canonical_name"]))
        if key in first and r["batch_no"] > 0:
            want.add((first[key], r["listing_id"]))
        first.setdefault(key, r["listing_id"])
    assert {tuple(r) for r in bd.repeats(listings, ref).collect()} == want


def test_the_driver_keeps_nothing_of_finished_batches(spark):
    import time
    kept = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    batch = lambda n: spark.createDataFrame([row(n * 10 + i, n, f"Velmora Granix {1000 + n * 10 + i} 16GB") for i in range(4)], SCHEMA)
    spark.sparkContext._jvm.System.gc()
    time.sleep(3)
    before, store = kept(), bd.OfferStore(spark, ["velmora"])
    for n in range(3):
        store.accept(batch(n))
    until = time.time() + 10  # the cleaner runs beside
    while kept() > before and time.time() < until:
        time.sleep(0.2)
    store.close()
    assert kept() <= before


def test_no_large_batch_is_broadcast(spark, monkeypatch):
    """Files tell too small a size: nothing but the keys of a small batch may be sent to the driver."""
    from pyspark.sql.readwriter import DataFrameWriter
    plans = []
    for name in ("parquet", "saveAsTable"):
        def seen(self, *args, write=getattr(DataFrameWriter, name), **kwargs):
            plans.append(self._df._jdf.queryExecution().executedPlan().toString())
            return write(self, *args, **kwargs)
        monkeypatch.setattr(DataFrameWriter, name, seen)
    rows = BASE + [row(20, 1, "Velmora Granix 1001 16GB 3200MHz"), row(21, 2, "Granix 1002 16GB 3200MHz")]
    monkeypatch.setattr(bd, "MOST_SENT", 0, raising=False)
    assert run(spark, rows) == {(1, 20), (2, 21)}
    assert sum("Join" in p for p in plans) >= 6 and not [p for p in plans if "BroadcastExchange" in p]
    monkeypatch.setattr(bd, "MOST_SENT", 100, raising=False)
    plans.clear()
    assert run(spark, rows) == {(1, 20), (2, 21)}
    assert [p for p in plans if "BroadcastExchange" in p]
