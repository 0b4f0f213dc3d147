"""Scalar functions against worked examples."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pricetide.functions import catalog, kinds, price, text

PRICES = [  # text, scraped, cleaned, engine
    ("129.000,00 DA", 129000, None, 129.0), ("55.000 DA", 55000, 55000.0, 55.0), ("55.500 DA", 55500, 55.5, 55.5), ("96 000,00 DA", 96000, 96000.0, 96000.0), ("96000,00 DZD", 9600000, 96000.0, 9600000.0),
    ("77,000 DA", 77000, 77000.0, 77000.0), ("39000", 39000, 39000.0, 39000.0), ("1 234 567 DA", 1234567, 1234567.0, 1234567.0), ("1.299.000 DA", 1299000, None, 1.299), ("", None, None, None), (None, None, None, None), ("gratuit", None, None, None),
]


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()[0]


def test_price_texts(spark):
    df = spark.createDataFrame([(p[0],) for p in PRICES], "x string").select(price.scraped_price(F.col("x")), price.clean_price(F.col("x")), price.engine_price(F.col("x")))
    assert [tuple(r) for r in df.collect()] == [p[1:] for p in PRICES]


def test_price_arithmetic(spark):
    df = spark.createDataFrame([(80.0, 100.0), (100.0, 80.0), (None, 100.0), (100.0, None)], "c double, o double")
    assert [tuple(r) for r in df.select(price.savings(F.col("c"), F.col("o")), price.savings_percent(F.col("c"), F.col("o"))).collect()] == [(20.0, 20), (0.0, 0), (0.0, 0), (0.0, 0)]
    assert one(spark, 2.5, price.half_up, "double") == 3 and one(spark, 2.5, price.half_even, "double") == 2
    assert one(spark, 9_600_000, price.hundredfold_fixed, "long") == 96000 and one(spark, 96000, price.hundredfold_fixed, "long") == 96000
    assert one(spark, 1234567, price.format_price, "long") == "1,234,567 DA" and one(spark, None, price.format_price, "long") == ""
    line = one(spark, "77,000 DA 65,000 DA", price.price_range)
    assert (line["current"], line["old"]) == (65000.0, 77000.0)


@pytest.mark.parametrize("raw, clean", [
    ("NewGPU CARTE GRAPHIQUE ASUS DUAL GEFORCE RTX 5060 OC EDITION 8GB", "ASUS Dual GeForce RTX 5060 OC 8GB"),
    ("In stockGPU CARTE GRAPHIQUE ZOTAC GEFORCE RTX 5060 Ti 16GB TWIN EDGE", "Zotac GeForce RTX 5060 Ti 16GB Twin Edge"), ("", ""), (None, None),
])
def test_smart_name(spark, raw, clean):
    assert one(spark, raw, catalog.smart_name) == clean


@pytest.mark.parametrize("name, kind", [
    ("Carte graphique RTX 4060 8GB", "gpu"), ("Processeur Ryzen 5 5600X", "cpu"), ("Barrette mémoire DDR5 16GB", "ram"), ("Écran PC 27\" 144Hz", "monitor"), ("Clavier mécanique", "keyboard"), ("Souris gaming", "mouse"), ("xyz", "unknown"), ("", "unknown"), (None, "unknown"),
])
def test_category(spark, name, kind):
    assert one(spark, name, catalog.category) == kind


def test_details_of_names(spark):
    df = spark.createDataFrame([("Intel Core i5-14600K 3.5GHz 14 cores LGA1700 occasion", "cpu")], "n string, c string")
    r = df.select(catalog.specs(F.col("n"), F.col("c")).alias("s"), catalog.model_key(F.col("n"), F.col("c")).alias("k"), catalog.condition(F.col("n")).alias("d"), catalog.brand(F.col("n")).alias("b"), catalog.model_identifiers(F.col("n")).alias("i")).first()
    assert r["s"] == {"cores": "14", "base_clock": "3.5 GHz", "socket": "LGA1700"} and r["k"] == "Intel-i514600k" and r["d"] == "Used" and r["b"] == "Intel"


def test_search_text(spark):
    assert one(spark, "Écran  LG 27-pouces!", text.normalize) == "ecran lg 27 pouces"
    assert one(spark, "SSD 1 TB 500gb", text.tokenize) == ["ssd", "1", "tb", "500gb", "1tb"]
    assert [(s["value"], s["unit"]) for s in one(spark, 'RAM 16 Go 27"', text.search_specs)] == [(16.0, "gb"), (27.0, "inch")]
    assert one(spark, "Kizz", text.phonetic_key) == "kiss"
    assert one(spark, "a A b b c", text.without_repeated_words) == "a b c"
    assert one(spark, "Élan & Co / 2", text.slug_ascii) == "elan-co-2" and one(spark, "Élan", text.slug) == "lan" and one(spark, None, text.slug_ascii) == ""


def hash31(s):
    h = 0
    for c in s:
        h = (h * 31 + ord(c) + 2**31) % 2**32 - 2**31
    return format(abs(h), "x")


@pytest.mark.parametrize("s", ["", "a", "hello world", "x" * 200])
def test_hash31(spark, s):
    assert one(spark, s, text.hash31) == hash31(s)


def test_similarity(spark):
    df = spark.createDataFrame([("abc", "abc"), ("abc", "abd"), ("", "")], "a string, b string").select(text.similarity(F.col("a"), F.col("b")))
    assert [round(r[0], 3) for r in df.collect()] == [1.0, 0.667, 1.0]


def test_spec_lines(spark):
    df = spark.createDataFrame([({"a": "1", "b": "N/A"},), ({},), (None,)], "s map<string,string>").select(text.spec_lines(F.col("s")))
    assert [r[0] for r in df.collect()] == [["a: 1"], ["Produit neuf"], ["Produit neuf"]]


def test_title_rules(spark):
    assert one(spark, "<b>RTX 4070</b> new pro DZ - ", text.without_fluff) == "RTX 4070"
    assert one(spark, "processeur pro pro", text.without_fluff) == "cesseur pro pro"  # first occurrence, also inside a word
    assert len(one(spark, "mot " * 60, text.without_fluff)) <= 120
    got = one(spark, 'Écran 27" 144Hz IPS noir RTX 4070 Ti Core i5-12400F 32 Go DDR5', kinds.title_specs)
    assert got == {"screen": '27"', "refreshRate": "144Hz", "panel": "IPS", "color": "Black", "gpu": "RTX 4070 Ti", "cpu": "Core i5-12400F", "ram": "32GB", "storage": "32GB", "memory": "DDR5"}
    df = spark.createDataFrame([("Carte graphique RTX 4060", "http://x/gpu"), ("", None), (None, "http://x/ssd/1")], "t string, u string")
    assert [r[0] for r in df.select(kinds.engine_category(F.col("t"), F.col("u"))).collect()] == ["gpu", "unknown", "storage"]


@pytest.mark.parametrize("title, portable", [("PC portable HP", True), ("Asus TUF i5-12400 RTX 4060 16GB 15.6 pouces", True), ("Carte graphique TUF i5-12400 RTX 4060 16GB 27 pouces", False), ("Ryzen 5 5600 RTX 3060 16GB SSD 512GB", False), ("", False), (None, False)])
def test_portables(spark, title, portable):
    assert one(spark, title, kinds.is_portable) == portable


def test_slugs_of_titles(spark):
    df = spark.createDataFrame([("RTX 4060 8GB", "memory"), ("notebook", "memory"), ("xyz", None)], "t string, r string")
    assert [r[0] for r in df.select(kinds.resolved_slug(F.lit(None).cast("string"), F.col("t"), F.col("r"))).collect()] == ["graphics-cards", "laptop", "pc-parts"]
    assert [r[0] for r in df.select(kinds.cascade(F.col("t"))).collect()] == ["pc_part", "laptop", "pc_part"]
    fits = spark.createDataFrame([("RTX 4060", "graphics-cards"), ("boitier RTX 4060", "graphics-cards"), ("laptop RTX 4060", "graphics-cards"), ("anything", "unlisted")], "t string, s string")
    assert [r[0] for r in fits.select(kinds.fits_slug(F.col("t"), F.col("s"))).collect()] == [True, False, False, True]


def test_sql_names(spark):
    from pricetide.functions import sql
    assert len(sql.register(spark)) == len(sql.FUNCTIONS)
    r = spark.sql("select pt_normalize('Écran  LG') a, pt_clean_price('96 000,00 DA') b, pt_savings(80L, 100L) c, pt_slug_of('RTX 4060') d, pt_similarity('abc', 'abc') e").first()
    assert tuple(r) == ("ecran lg", 96000.0, 20, "graphics-cards", 1.0)


@pytest.mark.parametrize("title", ["Firefly 14", "Erazer Defender", "GF66", "MSI Thin GF63 i7 16 Go 512 ssd", "MSI GF65 core i7 16 go fhd", "XMG 15"])
def test_portables_of_every_name(spark, title):
    assert one(spark, title, kinds.is_portable) is True


@pytest.mark.parametrize("title, slug, fits", [
    ("Boitier ATX noir", "pc-parts", False), ("Clavier mecanique", "pc-parts", False), ("MacBook Air", "pc-parts", False), ("Carte mère MSI B550", "pc-parts", True), ("PC ThinkPad RTX 3050", "graphics-cards", False),
    ("RTX 4060 8Go", "graphics-cards", True), ("Écran 27 pouces IPS", "monitors", True), ("Core i7 RTX 4060 FHD", "processors", False), ("anything", "other", True), (None, "mouse", False),
])
def test_titles_under_slugs(spark, title, slug, fits):
    assert spark.createDataFrame([(title, slug)], "t string, s string").select(kinds.fits_slug(F.col("t"), F.col("s"))).first()[0] is fits
