from __future__ import annotations

import random

from pyspark.sql import functions as F

from pricetide.llm import leaks

WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango uniform victor whiskey xray yankee zulu".split()


def text(seed, n=60):
    r = random.Random(seed)
    return " ".join(f"{r.choice(WORDS)}{r.randrange(99)}" for _ in range(n))


ITEMS = [(1, "Read the passage, then answer: " + text(1)), (2, "Read the passage, then answer: " + text(2)), (3, "short item"), (4, ""), (5, None)]
FILL = text(9, 80)


def find(spark, docs, items=ITEMS, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    return {tuple(r) for r in leaks.leaked(d, spark.createDataFrame(items, "item_id long, text string"), **more).collect()}


def part(item, begin, n):
    return " ".join(ITEMS[item - 1][1].split()[begin:begin + n])


def test_leaks(spark):
    spoiled = part(1, 10, 40).split()
    spoiled[12], spoiled[25] = "other", "words"
    docs = [
        (1, FILL + " " + ITEMS[0][1] + " " + FILL), (2, FILL + " " + part(1, 20, 22)), (3, FILL + " " + part(1, 20, 21)), (4, "<p>" + part(2, 5, 30).upper().replace(" ", ", ").replace("1", "<b>1</b>", 1) + "</p>"), (5, " ".join(spoiled)),
        (6, "Read the passage, then answer: " + FILL), (7, None), (8, ""), (9, "   "), (10, "a short item indeed"), (10, "a short item indeed"), (11, part(1, 5, 30) + " " + FILL + " " + part(2, 5, 30)),
    ]
    got = find(spark, docs)
    assert got == {(1, 1), (2, 1), (4, 2), (5, 1), (10, 3), (11, 1), (11, 2)}
    assert find(spark, docs, most_items=1) == got


def test_every_word_changed_now_and_then_is_no_leak(spark):
    assert find(spark, [(1, " ".join(w if i % 3 else "changed" for i, w in enumerate(ITEMS[0][1].split())))]) == set()


def test_every_stretch_that_the_alignment_accepts_is_found():
    """Every sixth word replaced: runs of five short words give few patterns of 20 letters, or none."""
    r = random.Random(7)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.choice((2, 3, 4, 6)))) for _ in range(90)]
    finder = leaks.LeakFinder([(1, " ".join(words))])
    accepted = 0
    for share in (0.35, 0.4, 0.5):
        n = int(len(words) * share)
        for begin in range(0, len(words) - n, 5):
            doc = [w if i % 6 != 5 else "changed" for i, w in enumerate(words[begin:begin + n])]
            if finder.items[1].longest_stretch(doc) >= finder.items[1].least:
                accepted += 1
                assert finder.leaks(f"{FILL} {' '.join(doc)} {FILL}") == [1]
    assert accepted >= 20


def test_empty_and_long(spark):
    assert find(spark, []) == set() and find(spark, [(1, FILL)], [(4, "")]) == set()
    assert find(spark, [(1, FILL * 500 + " " + ITEMS[1][1])]) == {(1, 2)}


def test_search_finds_what_a_scan_finds():
    r = random.Random(4)
    for _ in range(20):
        stream = "".join(r.choice("abc") for _ in range(600))
        patterns = {stream[i:i + 8]: [(0, 0)] for i in r.sample(range(590), 5)} | {"".join(r.choice("abc") for _ in range(8)): [(0, 0)] for _ in range(5)}
        found = sorted(leaks.WuManber(patterns, 8, 3).find(stream))
        assert found == sorted((i, stream[i:i + 8]) for i in range(593) if stream[i:i + 8] in patterns)


def test_short_items_and_marked_up_items():
    f = leaks.LeakFinder([(1, "short item"), (2, "ab"), (3, "b"), (4, '<a href="x y">' + text(3, 40) + "</a> &amp; more")])
    assert f.leaks("A short, item.") == [1] and f.leaks("a short itemised") == [] and f.leaks("cab b") == [3] and f.leaks("x ab") == [2] and f.leaks("a b") == [3]
    assert f.leaks("some " + text(3, 40)) == [4] and f.items[4].n_tokens == 42
