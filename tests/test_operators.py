"""Operators against plain loops, and their defined results on odd inputs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pricetide.operators import clusters, lifecycle, offers, search, taxonomy


def test_without_outliers_like_a_loop(spark):
    r = random.Random(5)
    data = [(r.randrange(6), i, r.choice([10, 11, 12, 13, 500, None])) for i in range(120)] + [(99, 1000, 5), (99, 1001, 9000)]
    kept = {tuple(x) for x in offers.without_outliers(spark.createDataFrame(data, "k int, i int, v int"), "k", "v").collect()}
    want = set()
    for k in {d[0] for d in data}:
        vals = sorted(d[2] for d in data if d[0] == k and d[2] is not None)
        n = len(vals)
        q1, q3 = vals[n // 4], vals[n * 3 // 4]
        for d in data:
            if d[0] == k and (n < 3 or (d[2] is not None and q1 - 1.5 * (q3 - q1) <= d[2] <= q3 + 1.5 * (q3 - q1))):
                want.add(d)
    assert kept == want


def greedy(n, edges):
    used, seed = set(), {}
    linked = {(a, b) for a, b in edges}
    for i in range(n):
        if i in used:
            continue
        used.add(i)
        seed[i] = i
        for j in range(i + 1, n):
            if j not in used and (i, j) in linked:
                used.add(j)
                seed[j] = i
    return seed


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_greedy_clusters_like_the_pass(spark, seed):
    r = random.Random(seed)
    n = 40
    edges = {tuple(sorted(r.sample(range(n), 2))) for _ in range(60)} | {(i, i + 1) for i in range(10)}
    got = clusters.greedy_clusters(spark.range(n).withColumnRenamed("id", "pos"), spark.createDataFrame(list(edges), "lo long, hi long"))
    assert {x["pos"]: x["seed"] for x in got.collect()} == greedy(n, edges)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 12)] + [(20, 22), (21, 22)]
    got = clusters.components(spark.range(25).withColumnRenamed("id", "pos"), spark.createDataFrame(edges, "lo long, hi long"))
    want = {i: 0 for i in range(13)} | {i: i for i in range(13, 25)} | {20: 20, 21: 20, 22: 20}
    assert {x["pos"]: x["component"] for x in got.collect()} == want


def test_clusters_of_nothing(spark):
    none = spark.createDataFrame([], "lo long, hi long")
    assert clusters.greedy_clusters(spark.range(0).withColumnRenamed("id", "pos"), none).count() == 0
    assert [tuple(x) for x in clusters.greedy_clusters(spark.range(1).withColumnRenamed("id", "pos"), none).collect()] == [(0, 0)]


def test_title_edges_find_every_like_pair(spark):
    from pricetide.functions.text import similarity
    titles = ["asus rtx 4060 dual", "asus rtx 4060 dual oc", "asus rtx 4060", "x", "xy", "asus rtx 4060 dual", "something else entirely", ""]
    items = spark.createDataFrame([(i, t, "b", "c") for i, t in enumerate(titles)] + [(50, None, "b", "c"), (51, "t", None, None)], "pos long, title string, brand string, category string")
    found = {tuple(x) for x in clusters.title_edges(items).collect()}
    a = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "p long, t string")
    pairs = a.crossJoin(a.select(F.col("p").alias("q"), F.col("t").alias("u"))).where("p < q").where(similarity(F.col("t"), F.col("u")) >= 0.65)
    firsts = {t: titles.index(t) for t in titles}
    for p, t, q, u in pairs.collect():
        assert (min(firsts[t], firsts[u]), max(firsts[t], firsts[u])) in found or t == u
    assert (0, 5) in found


def test_j13_links_equal_chips(spark, tmp_path):
    """Over brands, categories and nulls; 4 and 5 stay together though 3 of the same chip is taken by 1."""
    from pricetide.plans.analytics_queries import j13_greedy_clusters
    rows = [
        (1, "alpha card one", "a", "x", {"gpu": "g1"}), (2, "quite other name", None, None, {"gpu": "g1"}), (3, "third", "b", "x", {"gpu": "g1", "cpu": "c1"}), (4, "fourth item", "c", "y", {"cpu": "c1"}),
        (5, "plain 5", "d", None, {"cpu": "c1"}), (6, "zzzzzzzz", "a", "x", {"gpu": "g1"}), (7, "no specs", None, None, None), (8, "empty chip", None, None, {"gpu": ""}),
    ]
    spark.createDataFrame(rows, "product_id long, canonical_name string, brand string, category string, specs map<string,string>").write.parquet(f"{tmp_path}/clean_products.parquet")
    assert {tuple(r) for r in j13_greedy_clusters(spark, str(tmp_path)).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 7), (8, 8)}


def test_merges(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "pos long, name string")
    new = spark.createDataFrame([(5, "B"), (6, "c"), (7, "C"), (8, None)], "pos long, name string")
    assert sorted(x["pos"] for x in clusters.anti_merge(base, new, F.lower("name"), "pos").collect()) == [1, 2, 6, 8]
    assert sorted(x["pos"] for x in clusters.replace_source(base, new, F.col("name") == "a").collect()) == [2, 5, 6, 7, 8]


def test_upsert_and_log(spark):
    s = spark.createDataFrame([(1, 10, 100), (2, 10, 200)], "id long, v long, price long")
    c = spark.createDataFrame([(1, 10, 101), (2, 9, 999), (3, 1, 300)], "id long, v long, price long")
    assert sorted(tuple(x) for x in lifecycle.upsert(s, c, ["id"], ["v"]).collect()) == [(1, 10, 101), (2, 10, 200), (3, 1, 300)]
    assert tuple(lifecycle.upsert_counts(s, c, ["id"]).first()) == (1, 2, 0)
    assert sorted(tuple(x) for x in lifecycle.price_log(s, c, ["id"], "price").collect()) == [(1, 100, 101), (2, 200, 999), (3, None, 300)]
    names = lifecycle.get_or_create(spark.createDataFrame([("A", 7)], "n string, id long"), spark.createDataFrame([(" a ",), ("b",), (None,)], "n string"), "n", "id")
    assert {(x["n"], x["is_new"]) for x in names.collect()} == {("a", False), ("b", True)}


def test_taxonomy(spark):
    nodes = spark.createDataFrame([(1, 0, "PC"), (2, 1, "GPU"), (3, 2, "RTX 5080"), (4, 9, "orphan"), (5, 6, "x"), (6, 5, "y")], "id long, parent_id long, name string")
    assert {x["id"]: x["path"] for x in taxonomy.with_paths(nodes).collect()} == {1: ["PC"], 2: ["PC", "GPU"], 3: ["PC", "GPU", "RTX 5080"]}
    products = spark.createDataFrame([(3, "RTX 5080", "", "NVIDIA"), (4, "Core i5-14600K", "i5-14600K", "Intel")], "id long, name string, model string, brand string")
    titles = spark.createDataFrame([(1, "Carte NVIDIA RTX 5080 neuf"), (2, "souris"), (3, None)], "title_id long, title string")
    assert [tuple(x) for x in taxonomy.title_matches(titles, products).collect()] == [(1, 3, 180)]


def test_titles_meet_products_by_whole_phrases(spark):
    """Two thousand products of one first word: a title is held against those that it names only."""
    products = spark.createDataFrame([(i, f"granix {1000 + i}", ("m1", "", "")[i % 3], "Velmora") for i in range(2000)] + [(5000, "x9", None, "asus"), (5001, "granix 1003", "m1", "Velmora"), (5002, "abc", "", "")], "id long, name string, model string, brand string")
    titles = spark.createDataFrame([(1, "velmora granix 1007"), (2, "granix 10031"), (3, "asus x9"), (4, "x9 seul"), (5, "abcd"), (6, "granix velmora"), (7, "m1 granix"), (8, "")], "title_id long, title string")
    got = taxonomy.title_matches(titles, products)
    assert sorted(tuple(x) for x in got.collect()) == [(1, 7, 180), (2, 3, 60), (3, 5000, 180), (7, 0, 180)]
    keyed = taxonomy.search_keys(products).select(F.col("id").alias("product"), "name", F.coalesce("model", F.lit("")).alias("model"), "keys")
    assert taxonomy.candidates(titles.limit(1).withColumnRenamed("title", "t"), keyed).count() == 1


def broadcast_rows(node):
    """Rows of every broadcast table of an executed plan."""
    if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return broadcast_rows(node.executedPlan())
    if node.getClass().getSimpleName().endswith("QueryStageExec"):
        return broadcast_rows(node.plan())
    own = [node.metrics().apply("numOutputRows").value()] if node.getClass().getSimpleName() == "BroadcastExchangeExec" else []
    return own + [n for i in range(node.children().size()) for n in broadcast_rows(node.children().apply(i))]


def test_exploded_titles_are_not_broadcast(spark, tmp_path):
    """A well compressed table of titles: its file is below the threshold, its words are not."""
    spark.range(5000).select(F.col("id").alias("title_id"), F.concat(F.repeat(F.lit("carte graphique neuve "), 4), F.lit("granix "), F.col("id") + 1000).alias("title")).write.parquet(str(tmp_path / "t"))
    spark.range(9000).select("id", F.concat(F.lit("granix "), F.col("id") + 1000).alias("name"), F.lit("").alias("model"), F.lit("Velmora").alias("brand")).write.parquet(str(tmp_path / "p"))
    got = taxonomy.title_matches(spark.read.parquet(str(tmp_path / "t")), spark.read.parquet(str(tmp_path / "p")))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1m")
    try:
        rows = got.collect()
        sent = broadcast_rows(got._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert len(rows) == 5000 and all(r["product"] == r["title_id"] for r in rows)
    assert sent and max(sent) <= 18_000  # the phrases of the products; the titles have 140,000 beginnings


def token_score(q, t):
    """The ladder as a plain function."""
    def key(w):
        import re
        return re.sub("[^a-z]", "", re.sub("h+", "h", re.sub("w+", "w", w.translate(str.maketrans("ckqszfvbpdtgjiyouaern", "kkkssffppttggiiooeenn")))))

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    if q == t:
        return 100
    if t.startswith(q):
        return 85
    if q.startswith(t) and len(t) >= 2:
        return 75
    if q in t:
        return 65
    if t in q and len(t) >= 3:
        return 55
    syn = search.synonyms(q)
    if t in syn:
        return 70
    for s in syn:
        if t.startswith(s):
            return 60
        if s in t:
            return 50
    a, b = key(q), key(t)
    like = 1 if a == b else 0.7 if a.startswith(b) or b.startswith(a) else max(0, 1 - lev(a, b) / max(len(a), len(b)))
    if like >= 0.85:
        return 45
    if like >= 0.7:
        return 30
    if len(q) >= 3 and len(t) >= 3 and len(q) == len(t):
        k = sum(0 if x == y else 0.5 if y in search.NEIGHBOURS.get(x, "") else 1 for x, y in zip(q, t))
        if k <= 1:
            return 50
        if k <= 1.5:
            return 35
    d = lev(q, t)
    if d <= max(1, max(len(q), len(t)) // 4) and d <= 2 and len(q) >= 3:
        return 40 - d * 10
    return 0


def test_token_score_like_the_ladder(spark):
    from pricetide.functions.text import phonetic_key
    words = "gpu graphics asus assus rtx 4060 4070 clavier keyboard souris gigabyte gigabite memoire ram ssd nvme kortexia kortexa rouge bleu xyz ab".split()
    rows = spark.createDataFrame([(w,) for w in words], "t string")
    for q in words:
        got = {r[0]: r[1] for r in rows.select("t", search.token_score(q, F.col("t"), phonetic_key(F.col("t")))).collect()}
        assert got == {w: token_score(q, w) for w in words}, q


@pytest.mark.parametrize("query, rest, low, high", [
    ("ssd under 100000", "ssd", None, 100000), ("ram below 100k", "ram", None, 100000), ("over 50000", "", 50000, None), ("50k-100k", "", 50000, 100000), ("between 50000 and 100000", "", 50000, None), ("i5-12400f", "if", 5, 12400), ("clavier", "clavier", None, None),
])
def test_price_bounds(query, rest, low, high):
    assert search.price_bounds(query) == (rest, low, high)


def test_search(spark):
    rows = [(1, 1, "Asus RTX 4060 Dual", "Asus", "Cartes", "S", "graphics-cards", 100, 5), (2, 2, "Asus RTX 4070", "Asus", "Cartes", "S", "graphics-cards", 200, 9), (3, 3, "Clavier mécanique", None, None, None, "keyboard", None, None)]
    ix = search.index(spark.createDataFrame(rows, "listing_id long, product_id long, product_name string, product_brand string, category_name_fr string, store_name string, category_slug string, current_price long, product_review_count long"))
    assert [r["listing_id"] for r in search.ranked(search.search(ix, "asus rtx 4060")).collect()][0] == 1
    assert [r["listing_id"] for r in search.ranked(search.search(ix, "clavier")).collect()] == [3]
    assert search.search(ix, "  ").count() == 3
    assert [r["listing_id"] for r in search.search(ix, "asus under 150").collect()] == [1]
    assert {r["token"]: r["ids"] for r in search.postings(ix).collect()}["asus"] == [1, 2]
    vocab = search.vocabulary(ix)
    assert search.corrections(vocab, "assus").first()["correction"] == "asus"
    assert search.suggestions(ix.select(F.col("product_name").alias("name")), "asus rtx").count() == 2
    marks = ix.where("listing_id = 1").select(search.highlighted(F.col("product_name"), "asus 4060")).first()[0]
    assert [(m["text"], m["match"]) for m in marks][:3:2] == [("Asus", "exact"), ("4060", "exact")]


def test_edits_are_one_slip_away():
    e = search.edits("asus")
    assert {"sus", "saus", "adus"} <= e and "asus" not in e and all(len(w) >= 2 for w in e)


@pytest.mark.parametrize("query, kind", [("gpu under 100k", "mixed"), ("under 100k", "price_range"), ("souris", "category"), ("asus", "brand"), ("16gb", "spec"), ("granix", "product")])
def test_query_kind(query, kind):
    assert search.query_kind(query)["type"] == kind
