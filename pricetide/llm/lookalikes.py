"""One consistent form for texts that look the same but are made of other characters.

A text is first brought to composed form: full-width letters, presentation forms
and the many blanks become the plain characters, code points that draw nothing
go.  Then every word is a lattice: each position offers all letters drawn like
the one that stands there.  A Viterbi search takes the path with the best
character n-gram score under a model that keeps a word in one script; the
n-grams are counted over all words of the corpus.  Where only one script can
spell the word, the path is plain without a search.  As the lattice depends only on how the word
looks, words that look the same always come out the same, and a word truly written in another script keeps its script.

Letter case, accents, wording, other notations and signs such as (tm), squares
and fractions are visible and stay.  Null gives null, an empty or blank text the
empty string.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.llm.words import IGNORABLE, LOOKALIKES
from pricetide.session import checkpointed

#: Cost of changing the script within a word, in nats.
SWITCH_COST = 30.0
#: Of equal paths the one wins whose letters come first in their classes, Latin before all.
TIE_COST = 0.001
#: Letters beyond this one that have no doubles are counted as their script, which bounds the pairs of the model.
LAST_LETTER = 0x58F

_BLANKS = re.compile(r"\s+")
_HYPHENS = str.maketrans({"‐": "-", "‑": "-", "﹣": "-", "－": "-"})
#: Kinds of compatibility decomposition that leave the look of a character unchanged.
_SAME_LOOK = ("<wide>", "<noBreak>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>", "<font>")


def _plain_char(c: str) -> str:
    kind = unicodedata.decomposition(c)
    if kind.startswith(_SAME_LOOK) or "ﬀ" <= c <= "ﬆ" or "Ⅰ" <= c <= "ⅿ":
        return unicodedata.normalize("NFKC", c)
    return c


def plain(text: str) -> str:
    """Composed form without ignorable characters, special blanks, full-width and presentation forms."""
    text = IGNORABLE.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFC", "".join(map(_plain_char, text)).translate(_HYPHENS))
    return _BLANKS.sub(" ", text).strip()


def script(c: str) -> str:
    """The script of a letter; "" for all that belongs to none."""
    n = ord(c)
    if c.isalpha():
        for last, name in ((0x24F, "latin"), (0x2AF, "latin"), (0x3FF, "greek"), (0x52F, "cyrillic"), (0x58F, "armenian"), (0x5FF, "hebrew"), (0x77F, "arabic")):
            if n <= last and n >= 0x41:
                return name
        if 0x13A0 <= n <= 0x13FF:
            return "cherokee"
        if 0xA4D0 <= n <= 0xA4FF:
            return "lisu"
        if 0x1F00 <= n <= 0x1FFF:
            return "greek"
        if 0x1E00 <= n <= 0x1EFF:
            return "latin"
        return "other"
    return ""


_CLASS: dict[str, tuple[str, ...]] = {}
for _c, _base in LOOKALIKES.items():
    _CLASS[_base] = (*_CLASS.get(_base, (_base,)), _c)
for _base, _members in list(_CLASS.items()):
    for _c in _members:
        _CLASS[_c] = _members


_LATIN = frozenset({"latin"})


@lru_cache(maxsize=None)
def _scripts(c: str) -> frozenset[str]:
    """The scripts that have a letter which looks like this one."""
    return frozenset(script(m) for m in _CLASS.get(c, (c,))) - {""}


@lru_cache(maxsize=None)
def _spread(c: str) -> str:
    """A letter with marks as the letter and its marks, where the letter has doubles."""
    parts = unicodedata.normalize("NFD", c)
    return parts if len(parts) > 1 and parts[0] in _CLASS else c


@lru_cache(maxsize=None)
def symbol(c: str) -> str:
    """What stands for a letter in the model: itself, or its script."""
    return c if ord(c) <= LAST_LETTER or c in _CLASS else script(c)


class Unifier:
    """Viterbi search over look-alike lattices; ``pairs`` holds the counts of letter pairs."""

    def __init__(self, pairs: dict[tuple[str, str], int], most_words: int = 100_000):
        self.pairs, self.most_words = pairs, most_words
        self.first: dict[str, int] = {}
        for (a, _), n in pairs.items():
            self.first[a] = self.first.get(a, 0) + n
        self.cache: OrderedDict[str, str] = OrderedDict()

    def score(self, a: str, b: str) -> float:
        a, b = symbol(a), symbol(b)
        return math.log((self.pairs.get((a, b), 0) + 0.1) / (self.first.get(a, 0) + 10.0))

    def word(self, word: str) -> str:
        """The form of a word; it depends only on the classes of its letters, that is, on its look."""
        if not word.isascii():
            word = "".join(map(_spread, word))
        common: frozenset[str] | None = None
        for c in word:
            scripts = _scripts(c)
            if scripts:
                common = scripts if common is None else common & scripts
        if common is None:
            return word
        if common == _LATIN:  # no other script can spell the word
            return "".join(LOOKALIKES.get(c, c) for c in word)
        done = self.cache.get(word)
        if done is None:
            done = self._search(word, common)
            if len(self.cache) >= self.most_words:
                self.cache.popitem(last=False)
            self.cache[word] = done
        return done

    def _search(self, word: str, allowed: frozenset[str]) -> str:
        # a state is (letter, script in force); signs without a script carry the script on; a path is its last letter and the path before
        paths: dict[tuple[str, str], tuple[float, tuple | None]] = {("^", ""): (0.0, None)}
        for c in word:
            after: dict[tuple[str, str], tuple[float, tuple | None]] = {}
            for (last, now), (total, path) in paths.items():
                for place, letter in enumerate(_CLASS.get(c, (c,))):
                    kind = script(letter)
                    if kind and allowed and kind not in allowed:
                        continue
                    cost = total + (self.score(last, letter) if kind else 0.0) - (SWITCH_COST if kind and now and kind != now else 0.0)
                    cost -= TIE_COST * place
                    key = (letter if kind else "^", kind or now)
                    if key not in after or cost > after[key][0]:
                        after[key] = cost, (letter, path)
            paths = after
        _, path = max(paths.values(), key=lambda p: p[0])
        letters = []
        while path is not None:
            letters.append(path[0])
            path = path[1]
        return "".join(reversed(letters))

    def text(self, text: str | None) -> str | None:
        if text is None:
            return None
        return unicodedata.normalize("NFC", " ".join(map(self.word, plain(text).split(" "))))


def letter_pairs(texts: DataFrame, columns: list[str]) -> dict[tuple[str, str], int]:
    """How often letters follow each other within one script, over all words of the columns.

    Counted on the executors; letters enter by their ``symbol``, which bounds what
    comes to the driver.
    """
    schema = "a string, b string, n long"
    chosen = texts.select(*[F.col(c).cast("string").alias(f"t{i}") for i, c in enumerate(columns)])

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[str, str], int] = {}
        for frame in frames:
            for column in frame.columns:
                for text in frame[column].dropna():
                    for word in plain(text).split(" "):
                        if len({script(c) for c in word} - {""}) > 1:
                            continue
                        last = "^"
                        for c in word:
                            if not script(c):
                                last = "^"
                            else:
                                s = symbol(c)
                                seen[last, s] = seen.get((last, s), 0) + 1
                                last = s
        yield pd.DataFrame([(a, b, n) for (a, b), n in seen.items()], columns=["a", "b", "n"])

    rows = chosen.mapInPandas(count, schema).groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    return {(r["a"], r["b"]): r["n"] for r in rows}


def unified(df: DataFrame, columns: list[str], pairs: dict[tuple[str, str], int] | None = None, suffix: str = "_plain") -> DataFrame:
    """``df`` with the consistent form of each text column beside it."""
    counts = df.sparkSession.sparkContext.broadcast(letter_pairs(df, columns) if pairs is None else pairs)
    held: dict[str, Unifier] = {}

    def form(texts: pd.Series) -> pd.Series:
        u = held.get("u") or held.setdefault("u", Unifier(counts.value))
        return texts.map(lambda t: u.text(t if isinstance(t, str) else None))

    fold_udf = F.pandas_udf(form, "string")
    return df.withColumns({c + suffix: fold_udf(F.col(f"`{c}`")) for c in columns})


def _or_mark(c: Column) -> Column:
    """Null as a value of its own: the mark can't occur in a consistent form."""
    return F.coalesce(c, F.lit("\x00"))


def _looks(results: DataFrame) -> DataFrame:
    """result_id, look, look_check, form of each reading: its page and how it looks, and how it is stored.  Cut, as the search is dear."""
    rows = unified(results.select("result_id", "source", "url", "title", "price").where("source is not null and url is not null"), ["title", "price"])
    return checkpointed(rows.select(
        "result_id",
        F.xxhash64("source", "url", _or_mark(F.col("title_plain")), _or_mark(F.col("price_plain"))).alias("look"),
        F.sha2(F.to_json(F.struct("source", "url", "title_plain", "price_plain")), 256).alias("look_check"),
        F.sha2(F.concat_ws("\x01", F.coalesce("title", F.lit("\x00")), F.coalesce("price", F.lit("\x00"))), 256).alias("form"),
    ).distinct())


def look_classes(results: DataFrame) -> DataFrame:
    """result_id, class_id, n_links: the smallest reading of the page that looks the same, and how many of those are stored otherwise."""
    rows = _looks(results)
    by_form = rows.groupBy("look", "look_check", "form").agg(F.min("result_id").alias("low"), F.count("*").alias("n"))
    classes = by_form.groupBy("look", "look_check").agg(F.min("low").alias("class_id"), F.sum("n").alias("total"))
    sized = by_form.join(classes, ["look", "look_check"]).select("look", "look_check", "form", "class_id", (F.col("total") - F.col("n")).alias("n_links"))
    return rows.join(sized, ["look", "look_check", "form"]).select("result_id", "class_id", "n_links")


def same_looking_pairs(results: DataFrame) -> DataFrame:
    """result_id_a, result_id_b of readings of one page that look the same but are stored otherwise.

    Readings are first merged into their stored forms; forms are paired within a
    page and look, and only then expanded to the readings, so identical copies
    never meet each other.
    """
    rows = _looks(results)
    forms = rows.select("look", "look_check", "form").distinct()
    other = forms.select("look", "look_check", F.col("form").alias("form_b"))
    pairs = forms.withColumnRenamed("form", "form_a").join(other, ["look", "look_check"]).where("form_a < form_b")
    a = rows.select("look", "look_check", F.col("form").alias("form_a"), F.col("result_id").alias("a"))
    b = rows.select("look", "look_check", F.col("form").alias("form_b"), F.col("result_id").alias("b"))
    met = pairs.join(a, ["look", "look_check", "form_a"]).join(b, ["look", "look_check", "form_b"])
    return met.where("a <> b").select(F.least("a", "b").alias("result_id_a"), F.greatest("a", "b").alias("result_id_b")).distinct()
