"""Reading product wordings: brand, line, model and typed variant attributes of a free title.

``PhraseReader`` holds a vocabulary of brands and lines in one Aho-Corasick
automaton and completes a found brand or line phrase with the model number and
the attributes around it.  The vocabulary is mined from trusted listings by
``mine_lines``, every line with a single trusted listing included.  Where no
known line is followed by a model, the first article code after the brand is the
model and the words between them are the line.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.llm.words import fold, osa

#: Every task holds the automaton of lines; a longer list is refused.
MOST_LINES = 500_000
#: A line that lies within two edits of one this many times as frequent is a misspelling of it.
MISSPELT_RATIO = 5

# The words by which an attribute value is told.
WORD_VALUES = {
    "link": {"sans fil": "wireless", "sans-fil": "wireless", "wireless": "wireless", "filaire": "wired", "cable": "wired", "wired": "wired"},
    "colour": {"noir": "black", "noire": "black", "black": "black", "blanc": "white", "blanche": "white", "white": "white"},
    "rating": {"bronze": "bronze", "gold": "gold", "platinum": "platinum", "silver": "silver", "titanium": "titanium"},
    "layout": {"qwerty": "qwerty", "azerty": "azerty"},
    "bus": {"nvme": "nvme", "sata": "sata", "sata3": "sata"},
    "form": {"mini-itx": "itx", "mini itx": "itx", "itx": "itx", "micro-atx": "matx", "micro atx": "matx", "matx": "matx", "atx": "atx"},
}
SWITCH_COLOURS = {"rouge": "red", "rouges": "red", "red": "red", "brun": "brown", "bruns": "brown", "brown": "brown", "bleu": "blue", "bleus": "blue", "blue": "blue"}
#: Longer words of the attribute and kind vocabulary; a word one edit away from one of them is read as it.
KNOWN_WORDS = (
    "wireless filaire blanche blanc black white noire bronze platinum qwerty azerty switch switchs rouge rouges brown bruns bleus "
    "hertz pouces watts cores coeurs souris mouse clavier keyboard casque headset memoire carte graphique graphics processeur "
    "processor boitier alimentation ecran monitor moniteur portable ordinateur notebook laptop gamer gaming mecanique "
    "refroidisseur ventirad watercooling cooler disque solid state drive power supply barrette memory couleur gold"
).split()

_NUMBER_RULES = [
    ("mhz", re.compile(r"(\d+(?:[.,]\d+)?)\s*(ghz|mhz)(?![a-z])"), lambda m: round(float(m[1].replace(",", ".")) * (1000 if m[2] == "ghz" else 1))),
    ("gb", re.compile(r"(?<![\d.,])(\d+)\s*(gb|go|tb|to)(?![a-z0-9])"), lambda m: int(m[1]) * (1000 if m[2][0] == "t" else 1)),
    ("cores", re.compile(r"(?<!\d)(\d{1,3})[\s-]*(?:cores?|coeurs?)(?![a-z])"), lambda m: int(m[1])),
    ("hz", re.compile(r"(?<![\d.,])(\d{2,3})\s*(?:hz|hertz)(?![a-z])"), lambda m: int(m[1])),
    ("inch", re.compile(r"(?<![\d.,])(\d{2})(?:[.,]0)?\s*(?:\"|''|”|″|inch(?:es)?(?![a-z])|pouces?(?![a-z]))"), lambda m: int(m[1])),
    ("inch", re.compile(r"(?<![\d.,])(\d{2,3}[.,]\d)\s*cm(?![a-z])"), lambda m: round(float(m[1].replace(",", ".")) / 2.54)),
    ("mm", re.compile(r"(?<![\d.,])(\d{2})\s*cm(?![a-z])"), lambda m: int(m[1]) * 10),
    ("mm", re.compile(r"(?<![\d.,])(\d{2,3})\s*mm(?![a-z])"), lambda m: int(m[1])),
    ("watt", re.compile(r"(?<![\d.,])(\d{3,4})\s*(?:watts?|w)(?![a-z])"), lambda m: int(m[1])),
    ("watt", re.compile(r"(?<![\d.,])(\d(?:[.,]\d+)?)\s*kw(?![a-z])"), lambda m: round(float(m[1].replace(",", ".")) * 1000)),
    ("dpi", re.compile(r"(?<![\d.,])(\d+(?:[.,]\d+)?)\s*(k)?\s*dpi(?![a-z])"), lambda m: round(float(m[1].replace(",", ".")) * (1000 if m[2] else 1))),
]
_WORD_RULES = [
    (kind, re.compile(r"(?<![a-z0-9])(" + "|".join(sorted(map(re.escape, words), key=len, reverse=True)) + r")(?![a-z0-9])"), words)
    for kind, words in WORD_VALUES.items()
]
_SWITCH = re.compile(r"(?<![a-z])(?:switchs?\s+(" + "|".join(SWITCH_COLOURS) + r")|(" + "|".join(SWITCH_COLOURS) + r")\s+switchs?)(?![a-z])")
_MODEL = re.compile(r"\s*[|/–-]?\s*(?<![a-z])(\d{4})(?![\d.,]\d)(?:\s?-?\s?([ksx])(?![a-z0-9]))?(?![a-z0-9])")
_WORD = re.compile(r"[a-z]+")
#: An article code of any shape: letters and digits, at least two digits, perhaps behind a series as in "i7-".
_CODE = re.compile(r"(?<![\w.,])(?:[a-z]{1,3}\d-)?[a-z]{0,5}-?\d{2,6}[a-z]{0,3}(?![\w.,]\w|\w)")
_NO_CODE = re.compile(r"(?:ddr|usb|pcie|wifi|sata|hdmi|lga|socket|am|rj)-?\d+|\d{2,3}")
_PLAIN_NUMBER = re.compile(r"\d{3}")
# Words that belong to the model number before them, and words of sale.
MODEL_SUFFIXES = frozenset("ti super xt xtx gre pro max plus evo ultra mini oc".split())
SALES_WORDS = frozenset(
    "promo promotion solde soldes neuf neuve new original originale dispo disponible stock en arrivage garantie livraison prix deal hot best seller top offre special "
    "speciale destockage mois sous emballage jamais servi utilise occasion etat bon tres avec sans pour le la les de du des et pc kit version edition".split()
)
#: Memory below and disks from this size on are different attributes.
DISK_FROM_GB = 128


class Reading(NamedTuple):
    """What one wording states; null where it is silent."""

    brand: str | None
    line: str | None
    model: str | None
    attributes: tuple[tuple[str, str], ...]


@lru_cache(maxsize=100_000)
def _known(word: str) -> str:
    """A misspelt attribute word, corrected."""
    if len(word) < 5 or word in _KNOWN:
        return word
    near = [k for k in KNOWN_WORDS if len(k) >= 5 and osa(word, k, 1) <= 1]
    return near[0] if len({_meaning(k) for k in near}) == 1 else word


_KNOWN = frozenset(KNOWN_WORDS)


def _meaning(word: str) -> str:
    """What a known word says: forms of one colour mean the same, and so do forms of one stem."""
    return WORD_VALUES["colour"].get(word) or SWITCH_COLOURS.get(word) or word[:2]


def attributes(folded: str) -> dict[str, str]:
    """The typed attributes that a folded text states."""
    found: dict[str, str] = {}
    text = _WORD.sub(lambda m: _known(m[0]), folded)
    for kind, pattern, value in _NUMBER_RULES:
        for m in pattern.finditer(text):
            v = value(m)
            k = kind if kind != "gb" else "disk" if v >= DISK_FROM_GB else "memory"
            found.setdefault(k, str(v))
    for m in _SWITCH.finditer(text):
        found.setdefault("switch", SWITCH_COLOURS[m[1] or m[2]])
    for kind, pattern, words in _WORD_RULES:
        for m in pattern.finditer(text):
            found.setdefault(kind, words[m[1]])
            break
    return found


def _by_length(words: list[str]) -> dict[int, tuple[np.ndarray, list[str]]]:
    """The words by length, with the set of letters of each as bits."""
    grouped: dict[int, list[str]] = {}
    for w in words:
        grouped.setdefault(len(w), []).append(w)
    return {n: (np.array([_letters(w) for w in ws], dtype=np.uint64), ws) for n, ws in grouped.items()}


def _letters(word: str) -> int:
    bits = 0
    for c in word:
        bits |= 1 << (ord(c) & 63)
    return bits


def _alike(shapes: dict[int, tuple[np.ndarray, list[str]]], word: str, most: int) -> Iterator[str]:
    """Words that can lie within ``most`` edits: an edit changes the length by one and the letters by two at most."""
    mine = np.uint64(_letters(word))
    for n in range(len(word) - most, len(word) + most + 1):
        if n in shapes:
            bits, words = shapes[n]
            for i in np.flatnonzero(np.bitwise_count(bits ^ mine) <= 2 * most):
                yield words[i]


def _article(text: str, start: int) -> tuple[str | None, str, str | None, str] | None:
    """Line words, model, own name after the model, and the rest of a text whose brand ends at ``start``."""
    masked = text
    for _, pattern, _ in _NUMBER_RULES:
        masked = pattern.sub(lambda m: " " * len(m[0]), masked)
    for m in _CODE.finditer(masked, start):
        if _NO_CODE.fullmatch(m[0]) and not (_PLAIN_NUMBER.fullmatch(m[0])):
            continue
        words = [w for w in re.findall(r"[^\W_]+", masked[start:m.start()]) if w not in _KNOWN and w not in SALES_WORDS]
        model, end = m[0].replace("-", ""), m.end()
        while (s := re.compile(r"\s+([a-z]+)(?![a-z0-9])").match(masked, end)) and s[1] in MODEL_SUFFIXES:
            model, end = f"{model} {s[1]}", s.end()
        name = re.compile(r"\s+([a-z]{3,})(?![a-z0-9])").match(masked, end)
        own = name[1] if name and _known(name[1]) not in _KNOWN and name[1] not in SALES_WORDS and not _value_word(name[1]) else None
        line = " ".join(words) or (re.match(r"[a-z]*", m[0])[0] or None)
        return line, model, own, text[:m.start()] + " | " + text[end:]
    return None


def _value_word(word: str) -> bool:
    return word in SWITCH_COLOURS or any(word in words for words in WORD_VALUES.values())


class PhraseReader:
    """Finds brand and line phrases by Aho-Corasick and reads what stands around them.

    ``brands`` and ``lines`` are folded words.  Of overlapping hits the longest
    wins.  A word that is no hit is taken as a brand or line when it lies within
    one edit of exactly one of them (two edits from eight letters on); a line
    must in that case be followed by a model number.
    """

    def __init__(self, brands: Iterable[str], lines: Iterable[str]):
        self.brands, self.lines = sorted(set(brands)), sorted(set(lines))
        self.automaton = ahocorasick.Automaton()
        for kind, words in (("brand", self.brands), ("line", self.lines)):
            for w in words:
                self.automaton.add_word(w, (kind, w))
        if len(self.automaton):
            self.automaton.make_automaton()
        self._near: dict[tuple[str, str], str | None] = {}
        self._shapes = {"brand": _by_length(self.brands), "line": _by_length(self.lines)}

    def near(self, kind: str, word: str) -> str | None:
        key = (kind, word)
        if key not in self._near:
            if len(self._near) > 200_000:
                self._near.clear()
            most = 1 if len(word) < 8 else 2
            hits: list[tuple[int, str]] = []
            if len(word) >= 4 and word not in _KNOWN:
                for w in _alike(self._shapes[kind], word, most):
                    d = osa(word, w, most)
                    if d <= most:
                        hits.append((d, w))
            hits.sort()
            self._near[key] = hits[0][1] if hits and (len(hits) == 1 or hits[0][0] < hits[1][0]) else None
        return self._near[key]

    def read(self, title: str | None, specs_text: str | None = None) -> Reading:
        """What ``title`` states; attributes that it lacks come from ``specs_text``."""
        text = fold(title)
        hits = []
        if len(self.automaton):
            for end, (kind, w) in self.automaton.iter_long(text):
                begin = end - len(w) + 1
                if (begin == 0 or not text[begin - 1].isalnum()) and (end + 1 == len(text) or not text[end + 1].isalnum()):
                    hits.append((begin, end + 1, kind, w))
        brand = next((w for _, _, kind, w in hits if kind == "brand"), None)
        line = model = None
        rest = text
        for begin, end, kind, w in hits:
            if kind == "line" and (m := _MODEL.match(text, end)):
                line, model = w, m[1] + (m[2] or "")
                rest = text[:begin] + " | " + text[m.end():]
                break
        if model is None:
            for m0 in _WORD.finditer(text):
                m = _MODEL.match(text, m0.end())
                if m and (w := self.near("line", m0[0])):
                    line, model = w, m[1] + (m[2] or "")
                    rest = text[:m0.start()] + " | " + text[m.end():]
                    break
        if line is None:
            line = next((w for _, _, kind, w in hits if kind == "line"), None)
        if line is None:
            line = next((w for m0 in _WORD.finditer(text) if (w := self.near("line", m0[0]))), None)
        if brand is None:
            for m0 in _WORD.finditer(text):
                if m0[0] != line and (w := self.near("brand", m0[0])):
                    brand = w
                    break
        told_by_code: dict[str, str] = {}
        if model is None and brand is not None:
            at = next((end for _, end, kind, w in hits if kind == "brand" and w == brand), None)
            if at is not None and (general := _article(text, at)):
                words, model, name, rest = general
                line = words or line
                told_by_code = {"name": name} if name else {}
        found = attributes(rest) | told_by_code
        if specs_text:
            for k, v in attributes(fold(specs_text)).items():
                found.setdefault(k, v)
        return Reading(brand, line, model, tuple(sorted(found.items())))


def mine_lines(names: DataFrame, name: str, brands: Iterable[str]) -> list[str]:
    """The product lines of trusted listings."""
    return correct_lines(count_lines(names, name, brands))


def count_lines(names: DataFrame, name: str, brands: Iterable[str]) -> dict[str, int]:
    """How many trusted listings hold each line.

    A listing is trusted where its name begins "brand word number" with a brand
    of the reference list; the word is then a line.  All rows are counted, on
    the executors; only the distinct lines come to the driver.
    """
    known = [b for b in sorted(set(brands))]
    shape = r"^(\p{L}+)\s+([a-z]{3,})\s+[0-9]{4}[ksx]?(?:\s|$)"
    text = F.lower(F.col(f"`{name}`"))
    parts = names.select(F.regexp_extract(text, shape, 1).alias("brand"), F.regexp_extract(text, shape, 2).alias("line"))
    counts = parts.where(F.col("line") != "").where(F.col("brand").isin(known)).groupBy("line").agg(F.count("*").alias("n"))
    rows = counts.limit(MOST_LINES + 1).collect()
    if len(rows) > MOST_LINES:
        raise ValueError("more product lines than an automaton may hold")
    return {r["line"]: r["n"] for r in rows}


def correct_lines(counts: dict[str, int]) -> list[str]:
    """The lines without misspellings of far more frequent ones."""
    ranked = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    shapes = _by_length([line for line, _ in ranked])
    misspelt = lambda n, line: any(counts[o] >= MISSPELT_RATIO * n and o in kept and osa(line, o, 2) <= 2 for o in _alike(shapes, line, 2))
    kept: set[str] = set()
    for line, n in ranked:
        if not misspelt(n, line):
            kept.add(line)
    return sorted(kept)


def specs_text(specs: Column) -> Column:
    """The values of a specs map as one text; null for a null map."""
    return F.array_join(F.transform(F.map_values(specs), lambda v: F.coalesce(v, F.lit(""))), " | ")
