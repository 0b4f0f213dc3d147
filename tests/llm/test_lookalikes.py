from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pricetide.llm import lookalikes as la
from pricetide.llm.words import LOOKALIKES

SCHEMA = "result_id long, source string, url string, title string, price string"
UNIFIER = la.Unifier({("К", "л"): 5, ("л", "а"): 5, ("P", "r"): 9, ("r", "i"): 9})


@pytest.mark.parametrize("a, b", [
    ("Ｖｅｌｍｏｒａ", "Velmora"), ("Vеlmоra", "Velmora"), ("Écran", "Écran"), ("Vel​mo­ra", "Velmora"), ("14 300 DA", "14 300 DA"), ("5.900 DА", "5.900 DA"), ("x‑y", "x-y"), ("Pօlarqսe", "Polarque"), ("ﬁlaire", "filaire"), (" a  b ", "a b"),
])
def test_same_look(a, b):
    assert UNIFIER.text(a) == UNIFIER.text(b)


@pytest.mark.parametrize("a, b", [("Velmora", "velmora"), ("Ecran", "Écran"), ("10 m²", "10 m2"), ("½", "1/2"), ("Core™", "CoreTM"), ("5900 DA", "5.900 DA"), ("47 Ω", "47 O"), ("a b", "ab")])
def test_visible_differences(a, b):
    assert UNIFIER.text(a) != UNIFIER.text(b)


def test_words_of_another_script_stay():
    assert UNIFIER.text("Клавиша ЙЦУКЕН") == "Клавиша ЙЦУКЕН"
    assert UNIFIER.text("ЙЦУKЕН") == "ЙЦУКЕН"  # a Latin K among Cyrillic letters
    assert UNIFIER.text("عرض خاص") == "عرض خاص"


TO = {}
for foreign, base in LOOKALIKES.items():
    TO.setdefault(base, []).append(foreign)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcehimnoprsuxyABEHIKMNOPTX089 -"), min_size=1, max_size=20), st.randoms())
def test_any_replacement_by_doubles_comes_back(letters, random):
    plain = "".join(letters)
    disguised = "".join(random.choice([c, *TO.get(c, [])]) + random.choice(["", "", "​"]) for c in plain)
    assert UNIFIER.text(disguised) == UNIFIER.text(plain)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_a_form_is_its_own_form(text):
    once = UNIFIER.text(text)
    assert UNIFIER.text(once) == once


def pairs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"look": F.lit(1), "form": F.lit(2), "a": F.lit(3)})
    return sorted(tuple(r) for r in la.same_looking_pairs(df).collect())


def test_pairs(spark):
    rows = [(1, "s", "u", "Velmora", None), (2, "s", "u", "Vеlmora", None), (3, "s", "u", "Velmora", None), (3, "s", "u", "Velmora", None), (4, "s", "v", "Velmora", None), (5, "s", "u", "velmora", None), (6, "s", "u", "Velmora", "1"),
            (7, "s", "u", "Velmora", "1​"), (8, None, "u", "Vеlmora", None), (9, "s", None, "x", "y"), (10, "s", "w", None, None), (11, "s", "w", "", None), (12, "s", "w", "​", None)]
    assert pairs(spark, rows) == [(1, 2), (2, 3), (6, 7), (11, 12)]


def test_empty_and_long(spark):
    assert pairs(spark, []) == []
    assert pairs(spark, [(1, "s", "u", "о" * 100_000, ""), (2, "s", "u", "o" * 100_000, "")]) == [(1, 2)]


def test_classes_hold_the_links_of_the_pairs(spark, data):
    results = spark.read.parquet(f"{data}/scrape_results.parquet")
    links = {}
    for a, b in map(tuple, la.same_looking_pairs(results).collect()):
        links.setdefault(a, set()).add(b)
        links.setdefault(b, set()).add(a)
    rows = {r["result_id"]: (r["class_id"], r["n_links"]) for r in la.look_classes(results).collect()}
    assert {i: n for i, (_, n) in rows.items() if n} == {i: len(x) for i, x in links.items()}
    assert all(rows[a][0] == rows[b][0] for a, x in links.items() for b in x)


def test_letters_of_other_fonts_and_scripts():
    u = la.Unifier({})
    assert u.text("𝐑𝐓𝐗 𝖱𝖳𝖷 ꓣꓔX") == "RTX RTX RTX"
    assert u.text("a" * 30_000 + "Ꮇ") == "a" * 30_000 + "M"
