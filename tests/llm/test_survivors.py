from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from pricetide.llm import survivors as sv

SCHEMA = "candidate_id long, group_id long, canonical_name string, brand string, specs map<string,string>, image_url string, source_id long, updated_at timestamp"
DAY = [datetime(2026, 1, d) for d in range(1, 9)]
REAL = "https://img.a.example/m/1-{}.jpg"


def run(spark, rows, sources=((1, 5), (2, 3), (3, None))):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"trust": F.lit(9), "field": F.lit("x"), "claim": F.lit("y"), "key": F.lit("y"), "value": F.lit("z"), "entry": F.lit(1), "pattern": F.lit(1), "n": F.lit(0)})
    src = spark.createDataFrame(list(sources), "source_id long, trust_level int")
    ref = spark.createDataFrame([("brand", "Velmora")], "kind string, value string")
    return {(r["group_id"], r["field_name"]): r["candidate_id"] for r in sv.survivors(df, src, ref).collect()}


# names of a trusted form, from which the lines are mined
NAMES = [(100 + i, 50 + i, f"Velmora Granix {1000 + i} 16GB 3200MHz", "Velmora", None, None, 1, DAY[0]) for i in range(4)]


def test_choice_field_by_field(spark):
    rows = NAMES + [
        (1, 1, "PROMO Velmora Granix 1000 16GB hot deal", "-", {"a": "1", "b": "?"}, "no-image", 1, DAY[0]),
        (2, 1, "granix 1000 16go 3.2ghz velmora", "VELMORA", {"a": "1", "b": "2", "c": ""}, REAL.format(2), 2, DAY[1]),
        (3, 1, "Velmora Granix…", "Velmora", {"a": "1", "b": "2"}, REAL.format(3), 2, DAY[2]),
        (4, 1, "Sans nom", "N/A", {"a": None}, "https://img.a.example/default/no_image.gif", 1, DAY[3]),
        (5, 1, "Velmora", "Velmora", None, REAL.format(5), 3, DAY[7]),
    ]
    got = run(spark, rows)
    assert {f: c for (g, f), c in got.items() if g == 1} == {"canonical_name": 2, "brand": 3, "specs": 3, "image_url": 3}


def test_nothing_real_no_row_and_full_ties(spark):
    rows = NAMES + [
        (1, 1, None, None, None, None, None, None), (2, 1, "???", " ", {}, "", 1, DAY[0]), (3, 2, "Velmora", "Velmora", {"a": "1"}, REAL.format(1), None, None), (4, 2, "Velmora", "Velmora", {"a": "1"}, REAL.format(1), None, None),
        (4, 2, "Velmora", "Velmora", {"a": "1"}, REAL.format(1), None, None), (6, None, "Velmora", "Velmora", None, None, 1, DAY[0]), (7, 3, "Velmora " * 20_000, None, {"k" * 1000: "v" * 100_000}, None, 1, DAY[0]),
    ]
    got = run(spark, rows)
    assert {k: v for k, v in got.items() if k[0] < 50} == {(2, f): 3 for f in sv.FIELDS} | {(3, "canonical_name"): 7, (3, "specs"): 7}


def test_empty(spark):
    assert run(spark, []) == {}


def statement(g, s, key, value, field="specs"):
    return (g, g * 10 + s, s, field, key, key, value)


STATED = "group_id long, candidate_id long, source long, field string, entry string, key string, value string"


def false_claims(spark, rows):
    return {(r["group_id"], r["key"], r["value"]) for r in sv.judged_false(spark.createDataFrame(rows, STATED)).collect()}


def test_quality_is_learned_from_the_data(spark):
    """Source 3 contradicts the others wherever they agree, so it also loses where it stands against one alone."""
    rows = [statement(g, s, "ram", f"v{g}") for g in range(40) for s in (1, 2)] + [statement(g, 3, "ram", f"wrong{g}") for g in range(40)]
    rows += [statement(g, 1, "colour", f"c{g}") for g in range(40, 60)] + [statement(g, 3, "colour", f"d{g}") for g in range(40, 60)]
    rows += [statement(g, 3, "only", "by one") for g in range(60, 70)]  # nobody denies it
    false = false_claims(spark, rows)
    assert {(g, "ram", f"wrong{g}") for g in range(40)} <= false and {(g, "colour", f"d{g}") for g in range(40, 60)} <= false
    assert not {x for x in false if x[1] == "only" or x[2][0] in "vc"}


def test_silence_denies_nothing_and_equal_sources_keep_both(spark):
    rows = [statement(g, s, "a", "x") for g in range(30) for s in (1, 2, 3)] + [statement(g, s, "b", "y") for g in range(30) for s in (1, 2)]
    rows += [statement(99, 1, "c", "p"), statement(99, 2, "c", "q")]  # a key of several values
    assert false_claims(spark, rows) == set()


def test_same_judgement_at_other_sizes(spark):
    rows = lambda n: [statement(g, s, "k", "no" if s == 3 else "yes") for g in range(n) for s in (1, 2, 3)]
    for n in (1, 300):
        assert {x[2] for x in false_claims(spark, rows(n))} == {"no"}


def test_an_unreliable_source_loses_its_groups(spark, monkeypatch):
    """The fullest specs come from source 3, whose values the others deny; without the model it would win."""
    specs = lambda s: {"ram": "8 gb", "size": "15 inch"} if s < 3 else {"ram": "9 gb", "size": "16 inch", "weight": "1 kg"}
    rows = NAMES + [(g * 10 + s, g, None, None, specs(s), None, s, DAY[s]) for g in range(1, 21) for s in (1, 2, 3)]
    got = run(spark, rows)
    assert {got[g, "specs"] for g in range(1, 21)} == {g * 10 + 1 for g in range(1, 21)}
    monkeypatch.setattr(sv, "judged_false", lambda stated: stated.select("group_id", "field", "key", "value").limit(0))
    assert {run(spark, rows)[g, "specs"] for g in range(1, 21)} == {g * 10 + 3 for g in range(1, 21)}


def test_like_the_plain_rule(spark, data):
    from pricetide.llm.batch_dedup import brand_words
    from pricetide.llm.product_phrases import PhraseReader, mine_lines
    read = lambda t: spark.read.parquet(f"{data}/{t}.parquet")
    m, ref = read("merge_candidates"), read("ref_values")
    brands = brand_words(ref)
    reader = PhraseReader(brands, mine_lines(m, "canonical_name", brands))
    trust = {r["source_id"]: r["trust_level"] for r in read("sources").collect()}
    bad = {"", "-", "?", "n/a", "unknown"}
    best = {}
    for r in m.collect():
        name = reader.read(r["canonical_name"])
        sizes = {
            "canonical_name": sum(x is not None for x in name[:3]) + len(name.attributes), "brand": int((r["brand"] or "").strip().lower() not in bad),
            "specs": sum((v or "").strip().lower() not in bad for v in (r["specs"] or {}).values()), "image_url": int("/m/" in (r["image_url"] or "")),
        }
        for f, n in sizes.items():
            if n:
                best[r["group_id"], f] = max(best.get((r["group_id"], f), ()), (n, trust[r["source_id"]], r["updated_at"], -r["candidate_id"]))
    want = {k: -v[3] for k, v in best.items()}
    got = {(r["group_id"], r["field_name"]): r["candidate_id"] for r in sv.survivors(m, read("sources"), ref).collect()}
    assert got == want
