from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pricetide.llm import same_item as si
from pricetide.llm.product_phrases import PhraseReader, attributes
from pricetide.llm.words import fold

BRANDS, LINES = ["velmora", "kortexia"], ["granix", "basalte"]
READER = PhraseReader(BRANDS, LINES)
SCHEMA = "entry_id long, seller string, title string, specs string, typed_brand string"


@pytest.mark.parametrize("title, read", [
    ("PROMO Velmora Granix 1001-K 16 Go 3,2GHz", ("velmora", "granix", "1001k", {"memory": "16", "mhz": "3200"})),
    ("écran 55.9cm GRANIX | 1001 Velmroa 144 hertz", ("velmora", "granix", "1001", {"inch": "22", "hz": "144"})), ("Ventirad Kortexia Basalte 2002 12cm couleur noire", ("kortexia", "basalte", "2002", {"mm": "120", "colour": "black"})),
    ("Souris Granx 3003 16K DPI câblé", (None, "granix", "3003", {"dpi": "16000", "link": "wired"})), ("Vеlmоra Ｇｒａｎｉｘ 1001 0.85kW Gold", ("velmora", "granix", "1001", {"watt": "850", "rating": "gold"})), ("", (None, None, None, {})), (None, (None, None, None, {})),
])
def test_readings(title, read):
    r = READER.read(title)
    assert (r.brand, r.line, r.model, dict(r.attributes)) == read


@pytest.mark.parametrize("text, found", [("1 TB NVMe", {"disk": "1000", "bus": "nvme"}), ("8-core 4.2 GHz", {"cores": "8", "mhz": "4200"}), ("azerty FR switchs rouges", {"layout": "azerty", "switch": "red"}), ("Mini-ITX blanc", {"form": "itx", "colour": "white"})])
def test_attributes(text, found):
    assert attributes(fold(text)) == found


def grouped(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"item": F.lit(1), "brand": F.lit("clash"), "facts": F.lit(0)})
    return si.groups(df, BRANDS, LINES)


ROWS = [
    (1, "A", "Velmora Granix 1001 16GB 3200MHz", None, None), (2, "B", "RAM GRANIX 1001 16 Go 3.2GHz", None, None), (3, "C", "Velmora Granix 1001 32GB 3200MHz", None, None), (4, "D", "Velmora Granix 1001 promo", "16GB | 3200 MHz", None),
    (5, "A", "Velmora Granix 1001 16GB 3200MHz", None, None), (6, "E", "Velmora Granix 1001 32GB", None, None), (7, "F", "Velmora Granix 1001 3200MHz", None, None), (8, "G", None, None, None), (9, "H", "", "", ""), (9, "H", "", "", ""), (10, None, "Granix 1001 16GB 3200MHz", None, "VELMORA"),
]


def test_groups(spark):
    items = {r["entry_id"]: r["item"] for r in grouped(spark, ROWS).collect()}
    same = "velmora granix 1001 memory=16 mhz=3200"
    assert [items[i] for i in (1, 2, 4, 5, 10)] == [same] * 5
    assert items[3] == items[6] == "velmora granix 1001 memory=32 mhz=3200"
    assert items[7] is None and items[8] is None and items[9] is None  # two variants agree; nothing to read


def test_pairs(spark):
    got = {tuple(r) for r in si.pairs_across_sellers(grouped(spark, ROWS)).collect()}
    assert got == {(1, 2), (1, 4), (2, 4), (2, 5), (4, 5), (1, 10), (2, 10), (4, 10), (5, 10), (3, 6)}


def test_empty_and_long(spark):
    assert grouped(spark, []).count() == 0
    assert grouped(spark, [(1, "A", "velmora " * 20_000, None, None)]).first()["item"] is None


def test_data(spark, data):
    """Entries whose page address spells the product out agree with it."""
    read = lambda t: spark.read.parquet(f"{data}/{t}.parquet")
    items = si.same_items(read("clean_products"), read("scrape_results"), read("ref_values"))
    slug = F.regexp_extract("url", r"/(?:produit|product|p/\d+)/([a-z0-9-]+?)(?:-\d+)?(?:\.html|/)?$", 1)
    told = items.join(read("scrape_results").select(F.col("result_id").alias("entry_id"), slug.alias("slug")), "entry_id").where("slug <> ''")
    assert told.count() > 10 and told.where("item is null").count() == 0
    assert told.groupBy("slug").agg(F.countDistinct("item").alias("n")).where("n > 1").count() == 0


def test_a_stray_attribute_takes_no_variant_away(spark):
    rows = [(i, f"s{i}", "Velmora Granix 1001 16GB 3200MHz", None, None) for i in range(1, 30)] + [(i, f"s{i}", "Velmora Granix 1001 32GB 3200MHz", None, None) for i in range(30, 60)]
    rows += [(70, "x", "Velmora Granix 1001 16GB 3200MHz noir", None, None), (71, "y", "Velmora Granix 1001 32GB", None, None), (72, "z", "Velmora Granix 1001 3200MHz", None, None)]
    item = {r["entry_id"]: r["item"] for r in grouped(spark, rows).collect()}
    assert item[70] == item[1] != item[30] == item[71] and item[72] is None


def test_a_stray_attribute_of_a_rare_item(spark):
    rows = [(1, "A", "Velmora Granix 1001 16GB 3200MHz", None, None), (2, "B", "Velmora Granix 1001 32GB 3200MHz", None, None), (3, "C", "Velmora Granix 1001 32GB 3200MHz", None, None), (4, "D", "Velmora Granix 1001 16GB noir", None, None)]
    item = {r["entry_id"]: r["item"] for r in grouped(spark, rows).collect()}
    assert item[2] == item[3] and item[1] is not None and item[1] != item[2]


@pytest.mark.parametrize("title, line, model", [("Intel Core i7-13700K", "core", "i713700k"), ("AMD Ryzen 5 5600X", "ryzen 5", "5600x"), ("MSI GeForce RTX 4070 Ti", "geforce rtx", "4070 ti"), ("MSI MAG B650 Tomahawk", "mag", "b650"), ("Corsair RM850e 850W", "rm", "rm850e"), ("Samsung 870 EVO 1TB SATA", None, "870 evo")])
def test_models_of_any_shape(spark, title, line, model):
    brands = ["intel", "amd", "msi", "corsair", "samsung"]
    r = PhraseReader(brands, LINES).read(title)
    assert (r.line, r.model) == (line, model)


def test_articles_get_items(spark):
    df = spark.createDataFrame([(1, "A", "Samsung 870 EVO 1TB SATA", None, None), (2, "B", "PROMO Samsung 870 EVO 1 To SATA neuf", None, None), (3, "C", "MSI MAG B650 Tomahawk", None, None), (4, "D", "MSI MAG B650 Mortar", None, None)], SCHEMA)
    item = {r["entry_id"]: r["item"] for r in si.groups(df, ["samsung", "msi"], []).collect()}
    assert item[1] == item[2] is not None and item[3] != item[4] and None not in item.values()


def test_a_line_with_one_listing_is_mined(spark):
    from pricetide.llm.product_phrases import mine_lines
    df = spark.createDataFrame([("Velmora Granix 1001",)] * 2000 + [("Velmora Solitar 1002",), ("Velmora Granx 1003",), (None,)], "n string")
    assert mine_lines(df, "n", BRANDS) == ["granix", "solitar"]
