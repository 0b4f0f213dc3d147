"""Feeds, sinks and streams."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import functions as F

from pricetide.operators.offers import latest_offers
from pricetide.sources import readers, sinks
from pricetide.streaming import changes


def put(folder, name, text):
    folder.mkdir(exist_ok=True, parents=True)
    (folder / name).write_text(text, encoding="utf-8")
    return str(folder)


def test_raw_products(spark, tmp_path):
    put(tmp_path / "raw", "a.json", json.dumps({"products": [{"name": " RTX ", "price": "1 DA", "site": "x"}, {"title": "Ryzen", "imageUrl": "u", "source": "y"}]}))
    path = put(tmp_path / "raw", "b.json", json.dumps([{"name": "", "title": None}, {"name": "SSD"}]))
    rows = {r["name"]: (r["site"], r["image"]) for r in readers.raw_products(spark, path).collect()}
    assert rows == {"RTX": ("x", None), "Ryzen": ("y", "u"), "SSD": ("unknown", None)}


def test_taxonomy_file(spark, tmp_path):
    path = put(tmp_path / "t", "t.csv", 'ID,Parent_ID,Node_Type,Name,Category,Brand,Model,Key_Specs,Interface_Socket,Release_Year,Price_USD,Condition,Notes\n1,0,Root,"PC, parts",,,,,,,,,\nx,1,Product,RTX,GPU,NVIDIA,,,,,,,\n')
    assert [(r["id"], r["parent_id"], r["name"]) for r in readers.taxonomy(spark, path).orderBy("parent_id").collect()] == [(1, 0, "PC, parts"), (0, 1, "RTX")]


PAGE = """<html><a href="/c/gpu">Cartes graphiques</a><a href="/c/ram">RAM</a><div class="card"><h2>RTX &amp; co</h2><span class="p">1 000 DA</span></div><div class="card"><h3>SSD</h3></div>
<script type="application/ld+json">{"@type": "Product", "name": "RTX", "url": "u", "offers": {"price": "12.5"}}</script><script type="application/ld+json">[{"@type": "Thing"}]</script></html>"""


def test_pages(spark, tmp_path):
    pages = readers.pages(spark, put(tmp_path / "p", "a.html", PAGE))
    cards = readers.cards(pages, r'<div class="card">(.*?)</div>', {"name": [r"<h2>(.*?)</h2>", r"<h3>(.*?)</h3>"], "price": [r'<span class="p">(.*?)</span>']})
    assert [(r["name"], r["price"]) for r in cards.collect()] == [("RTX & co", "1 000 DA"), ("SSD", None)]
    assert [(r["name"], r["price"]) for r in readers.linked_data(pages).collect()] == [("RTX", 12.5)]
    data = '<script type="application/json">{"a": {"b": [{"name": "SSD", "price": 9}, {"name": "x"}]}, "name": "top", "price": "1.5"}</script><script type="application/json">{broken</script>'
    deep = spark.createDataFrame([(1, data), (2, None)], "id int, html string")
    assert sorted((r["name"], r["price"]) for r in readers.embedded_products(deep).collect()) == [("SSD", 9.0), ("top", 1.5)]
    assert readers.embedded_products(deep, depth=1).count() == 1
    assert {(r["category"], r["url"]) for r in readers.categories_of(pages, {"gpu": ["graphique"], "ram": ["ram"]}).collect()} == {("gpu", "/c/gpu"), ("ram", "/c/ram")}


def test_other_feeds(spark, tmp_path):
    assert [r["url"] for r in readers.sitemap(spark, put(tmp_path / "s", "s.xml", "<urlset><url><loc>h/product/1</loc></url><url><loc>h/about</loc></url></urlset>")).collect()] == ["h/product/1"]
    api = json.dumps([{"name": "<b>X</b>", "prices": {"price": "5000"}, "permalink": "u"}, {"name": "Y", "prices": {"price": "10"}, "permalink": "v"}])
    assert [tuple(r) for r in readers.store_api(spark, put(tmp_path / "api", "a.json", api)).collect()] == [("X", 5000, "u")]
    ann = {"data": {"search": {"announcements": {"data": [{"id": "7", "title": "RTX 4060", "slug": "rtx", "price": 9, "status": "PUBLISHED", "medias": [{"mediaUrl": "m"}]}, {"id": "8", "title": "Cherche RTX"}]}}}}
    assert [(r["name"], r["url"], r["image"]) for r in readers.announcements(spark, put(tmp_path / "an", "a.json", json.dumps(ann)), "h").collect()] == [("RTX 4060", "h/rtx-d7", "m")]


def test_fan_in(spark):
    a = spark.createDataFrame([(1, "n", "u")], "pos int, name string, url string")
    def broken():
        raise OSError("gone")
    df, failed = readers.fan_in({"a": lambda: a, "b": broken, "c": lambda: a.select("name")})
    assert df.count() == 2 and set(failed) == {"b"}
    assert readers.with_fallback(a, 2, lambda: a).count() == 2 and readers.with_fallback(a, 1, lambda: a).count() == 1
    rows = spark.createDataFrame([(1, "n", "u"), (2, "n", "v"), (3, "m", "u"), (4, "k", "w")], "pos int, name string, url string")
    assert sorted(r["pos"] for r in readers.unseen(rows).collect()) == [1, 4]
    assert readers.first_existing(spark, ["/none/at/all", "/tmp"]) == "/tmp"


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("s", "r1", 1), ("s", "r2", 2)], "site string, run_ts string, v int")
    path = str(tmp_path / "snap")
    sinks.snapshot(rows, path)
    sinks.snapshot(rows.where("run_ts = 'r2'").withColumn("v", F.lit(9)), path)
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [1, 9]
    sinks.to_targets(rows, [str(tmp_path / "x"), str(tmp_path / "y")])
    assert spark.read.parquet(str(tmp_path / "y")).count() == 2
    lines = sinks.sitemap_lines(spark.createDataFrame([("Élan 1", 5), ("", 9)], "name string, p int"), "h", F.desc("p"))
    assert [r["value"] for r in lines.collect()] == ["<url><loc>h/product/elan-1</loc></url>"]


def change(i, p, price, minute, stock="En stock"):
    at = datetime(2026, 1, 1, 0, minute)
    return (i, p, 1, price, 100, stock, None, at, at)


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([change(1, 1, 50, 0), change(2, 2, 90, 1)], changes.CHANGES).coalesce(1).write.parquet(src)
    top = {}
    kept = changes.keep_deals(changes.change_stream(spark, src), str(tmp_path / "state"), str(tmp_path / "c1"), 5, lambda df, n: top.__setitem__(n, [r["listing_id"] for r in df.collect()]))
    kept.awaitTermination()
    log = changes.price_changes(changes.change_stream(spark, src), str(tmp_path / "c2"), str(tmp_path / "log"))
    log.awaitTermination()
    spark.createDataFrame([change(2, 2, 10, 7), change(1, 1, 50, 8)], changes.CHANGES).coalesce(1).write.mode("append").parquet(src)
    changes.keep_deals(changes.change_stream(spark, src), str(tmp_path / "state"), str(tmp_path / "c1"), 5, lambda df, n: top.__setitem__(n, [r["listing_id"] for r in df.collect()])).awaitTermination()
    changes.price_changes(changes.change_stream(spark, src), str(tmp_path / "c2"), str(tmp_path / "log")).awaitTermination()
    assert top == {0: [1, 2], 1: [2, 1]}
    assert {(r["listing_id"], r["old_price"], r["new_price"]) for r in spark.read.parquet(str(tmp_path / "log/0"), str(tmp_path / "log/1")).collect()} == {(1, None, 50), (2, None, 90), (2, 90, 10)}
    st = changes.stateful_changes(changes.change_stream(spark, src, 1)).writeStream.format("memory").queryName("st").outputMode("append").trigger(availableNow=True).start()
    st.awaitTermination()
    assert {(r["listing_id"], r["old_price"], r["new_price"]) for r in spark.table("st").collect()} == {(1, None, 50), (2, None, 90), (2, 90, 10)}
    q = changes.rotation(changes.product_feed(changes.change_stream(spark, src), 2)).writeStream.format("memory").queryName("rot").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["n_changes"], r["best_saving"]) for r in spark.table("rot").collect()) == [(1, 10), (1, 90)]
    seen = changes.first_seen(changes.change_stream(spark, src)).writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    seen.awaitTermination()
    assert spark.table("seen").count() == 4


def test_latest_offers_of_repeats(spark):
    rows = [change(1, 1, 50, 0), change(1, 1, 50, 0), change(1, 1, None, 0), change(None, 1, 1, 0)]
    got = latest_offers(spark.createDataFrame(rows, changes.CHANGES)).collect()
    assert [(r["listing_id"], r["current_price"]) for r in got] == [(1, 50)]
