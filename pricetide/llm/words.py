"""String primitives shared by the operators of this subpackage (pure Python, no Spark)."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Letters of other scripts drawn like a Latin letter.
LOOKALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "У": "Y", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W",
    "Ӏ": "I", "Ѵ": "V", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y",
    "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ү": "y", "ӏ": "l",
    "ѵ": "v",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N",
    "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "ο": "o", "ν": "v",
    "α": "a", "ι": "i", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j", "γ": "y",
    # Armenian
    "օ": "o", "ս": "u", "ո": "n", "հ": "h", "ց": "g", "զ": "q", "յ": "j", "Օ": "O", "Տ": "S",
    "Ս": "U", "Լ": "L",
    # Latin letters drawn like another one
    "ɡ": "g", "ɑ": "a", "ı": "i",
    # Cherokee
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭼ": "E", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M",
    "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F",
    "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y",
    "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
}

# Code points that draw nothing.
IGNORABLE = re.compile(
    "[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e"
    "\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\U000e0000-\U000e0fff]"
)

_FOLD = str.maketrans(LOOKALIKES)
_DASHES = str.maketrans({c: "-" for c in "‐‑‒–—−﹣－"})


def strip_accents(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


@lru_cache(maxsize=200_000)
def _fold_word(word: str) -> str:
    if word.isascii():
        return word
    mapped = unicodedata.normalize("NFD", word).translate(_FOLD)
    kept = [c for c in strip_accents(mapped) if c.isalpha()]
    return mapped if kept and all(ord(c) < 0x250 for c in kept) else word


def fold(text: str | None) -> str:
    """Lower-case, accent-free, compatibility-normalised text with Latin look-alikes resolved.

    Words that stay in another script after the mapping are kept as they are.
    Null gives the empty string.
    """
    if not text:
        return ""
    text = IGNORABLE.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_DASHES)
        text = " ".join(_fold_word(w) for w in text.split())
        text = strip_accents(text.replace("œ", "oe").replace("Œ", "oe"))
    return " ".join(text.lower().split())


def osa(a: str, b: str, most: int) -> int:
    """Edit distance with adjacent transpositions; ``most + 1`` where it is larger than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def damerau(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance, a true metric (triangle inequality holds)."""
    n, m = len(a), len(b)
    far = n + m
    seen: dict[str, int] = {}
    d = [[far] * (m + 2) for _ in range(n + 2)]
    for i in range(n + 1):
        d[i + 1][1] = i
    for j in range(m + 1):
        d[1][j + 1] = j
    for i in range(1, n + 1):
        match = 0
        for j in range(1, m + 1):
            k, l = seen.get(b[j - 1], 0), match
            same = a[i - 1] == b[j - 1]
            if same:
                match = j
            d[i + 1][j + 1] = min(
                d[i][j] + (not same), d[i + 1][j] + 1, d[i][j + 1] + 1,
                d[k][l] + (i - k - 1) + 1 + (j - l - 1),
            )
        seen[a[i - 1]] = i
    return d[n + 1][m + 1]
