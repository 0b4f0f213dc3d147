from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pricetide.llm import value_mapping as vm
from pricetide.llm.words import damerau

BRANDS = [(1, "Velmora", None, None), (2, "Kortexia", None, None), (3, "Nordhaven", None, "NDNX"), (4, "Ivoryx", None, None)]
SHOPS = [(10, "Zebrak PC", None, "zebrak-pc.example"), (11, "Fennetic Tech DZ", None, "fennetic-tech-dz.example"), (12, "Bidzan Informatique", None, None), (13, "Mirzane Store", None, None)]
KINDS = [(20, "mouse", "Souris", "mse"), (21, "power-supplies", "Alimentations", "psu"), (22, "monitors", "Écrans", "ecran")]


@pytest.mark.parametrize("entries, typed, ref_id", [
    (BRANDS, "velmora", 1), (BRANDS, "V E L M O R A", 1), (BRANDS, "Vel-mora", 1), (BRANDS, "marque : Vellmora", 1), (BRANDS, "Kortexai (officiel)", 2), (BRANDS, "Kortexia®", 2), (BRANDS, "Velmora Granix", 1), (BRANDS, "ndnx", 3), (BRANDS, "Vélmоra", 1),
    (BRANDS, "Kortune", 0), (BRANDS, "Norduval", 0), (BRANDS, "Unknown", 0), (BRANDS, "-", 0), (BRANDS, "بدون علامة", 0), (BRANDS, "x" * 100_000, 0), (BRANDS, "a " * 20_000, 0),
    (SHOPS, "PC Zebrak", 10), (SHOPS, "https://www.zebrak-pc.example/", 10), (SHOPS, "Zebrka-PC", 10), (SHOPS, "Tech DZ Fennetic", 11), (SHOPS, "Bidzan Info.", 12), (SHOPS, "Puces d'Oued Mirzane", 0), (SHOPS, "Boutique du Coin", 0), (SHOPS, "Ets Mirzane Store SARL", 13),
    (KINDS, "mose", 20), (KINDS, "Souri", 20), (KINDS, "mouse & co", 20), (KINDS, "Power Supplie", 21), (KINDS, "Catégorie > Ecrans", 22), (KINDS, "MSE", 20), (KINDS, "misc", 0), (KINDS, "Imprimantes", 0),
])
def test_matches(entries, typed, ref_id):
    _, ids = vm.Matcher(entries).match(typed)
    assert (ids[0] if len(ids) == 1 else 0) == ref_id


words = st.text(alphabet="abcd", max_size=7)


@settings(max_examples=200, deadline=None)
@given(words, words, words)
def test_a_metric(a, b, c):
    assert (damerau(a, b) == 0) == (a == b)
    assert damerau(a, b) == damerau(b, a)
    assert damerau(a, c) <= damerau(a, b) + damerau(b, c)


def test_tree_finds_all_that_a_scan_finds():
    r = random.Random(3)
    names = ["".join(r.choice("abcde") for _ in range(r.randint(3, 8))) for _ in range(300)]
    tree = vm.BKTree()
    for i, n in enumerate(names):
        tree.add(n, i)
    for _ in range(50):
        q = "".join(r.choice("abcde") for _ in range(r.randint(3, 8)))
        assert sorted(p for _, _, p in tree.within(q, 2)) == [i for i, n in enumerate(names) if damerau(q, n) <= 2]
    tree.visited = 0
    tree.within("aaaa", 1)
    assert tree.visited < len(set(names))


def frames(spark):
    ref = spark.createDataFrame([(i, "brand", v, a, c) for i, v, a, c in BRANDS] + [(99, "source", "Velmora", None, None)], "ref_id long, kind string, value string, alt_value string, short_code string")
    table = spark.createDataFrame([(1, "Velmora"), (2, "velmora"), (3, None), (4, "   "), (5, "zzz"), (6, "Kortexai"), (6, "Kortexai"), (None, "velmora")], "product_id long, brand string")
    return table.withColumns({"value": F.lit("clash"), "ref_id": F.lit(0), "record_id": F.lit(0)}), ref


def test_field(spark):
    table, ref = frames(spark)
    got = {tuple(r) for r in vm.mapped_field(table, "product_id", "brand", "brand", ref).collect()}
    assert got == {("brand", 2, 1), ("brand", 5, 0), ("brand", 6, 2), ("brand", None, 1)}


def test_shards_give_the_same(spark):
    _, ref = frames(spark)
    values = spark.createDataFrame([(v,) for v in ("velmora", "Kortexai", "zzz", "Ivorx", "NDNX")], "value string")
    brands = ref.where("kind = 'brand'")
    whole = {tuple(r) for r in vm.mapped_values(values, brands).collect()}
    assert {tuple(r) for r in vm.mapped_values(values, brands, most_broadcast=1).collect()} == whole
    assert whole == {("velmora", 1), ("Kortexai", 2), ("zzz", 0), ("Ivorx", 4), ("NDNX", 3)}


def test_any_sharding_gives_the_same():
    """The winners of shards, merged by rank, are those of one tree."""
    r = random.Random(8)
    words = ["western", "westyrn", "digital", "digit", "velmora", "shop", "nord", "haven", "ivorex", "iv"]
    entries = [(i, " ".join(r.sample(words, r.randrange(1, 4))), None, None) for i in range(1, 40)] + [(90, "westyrnx", None, None), (91, "western digital", None, None), (92, "a b c d e f g longer name", None, None)]
    whole = vm.Matcher(entries)
    typed = [" ".join(r.sample(words, r.randrange(1, 4))) + r.choice(["", ".", " x", "z"]) for _ in range(150)] + ["western d.", "western digi.", "a b c d e f g longer nome", "westyrn digital."]
    for shards in (2, 5):
        parts = [vm.Matcher([e for e in entries if e[0] % shards == k]) for k in range(shards)]
        for t in typed:
            got = [m.match(t) for m in parts]
            best = min(rank for rank, _ in got)
            assert whole.match(t) == (best, sorted(i for rank, ids in got for i in ids if rank == best)), t
    few = vm.Matcher(entries[-3:])
    assert few.match("a b c d e f g longer nome")[1] == [92] and few.match("western d.")[1] == [90] and vm.Matcher(entries[-2:]).match("western d.")[1] == [91] and few.match("westyrnx")[1] == [90]


def test_empty(spark):
    table, ref = frames(spark)
    assert vm.mapped_field(table.limit(0), "product_id", "brand", "brand", ref).count() == 0
    assert {r["ref_id"] for r in vm.mapped_field(table, "product_id", "brand", "brand", ref.limit(0)).collect()} == {0}
