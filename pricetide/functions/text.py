"""Text functions as Column expressions: normalisation, tokens, slugs, phonetic keys.

All of them run inside the JVM; none is a Python UDF.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accent_table() -> tuple[str, str]:
    """Letters with marks and the plain letters under them, from the canonical decompositions."""
    marked, plain = [], []
    for cp in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(cp))
        if len(base) > 1 and base[0].isascii() and base[0].isalpha():
            marked.append(chr(cp))
            plain.append(base[0])
    return "".join(marked), "".join(plain)


_MARKED, _PLAIN = _accent_table()

# Units that may follow a number in a search text, in the order in which they are tried.
SPEC_UNITS = "gb|tb|mb|mhz|ghz|hz|w|watt|v| inch|\"|mm|cm|k|ko|mo|go|°c|rpm|fps|mp|px|x\\d+|core|thread|pin|modular|bit|channel|ms|polegada|pouces|polegadas|pulgadas|zoll|pollici|дюйм|インチ|英寸"
_SPEC = rf"(\d+(?:\.\d+)?)\s*({SPEC_UNITS})"

# HTML entities that occur in shop titles.
ENTITIES = {"&amp;": "&", "&quot;": '"', "&apos;": "'", "&#x27;": "'", "&#39;": "'", "&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&rsquo;": "'", "&lsquo;": "'", "&rdquo;": '"', "&ldquo;": '"', "&mdash;": "-", "&ndash;": "-", "&hellip;": "..."}


def squeeze(c: Column) -> Column:
    """Blanks collapsed and trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def without_accents(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, _MARKED, _PLAIN), r"[̀-ͯ]", "")


def normalize(c: Column) -> Column:
    """Search form: lower case, no accents, only ASCII word characters and dots; null for null."""
    return squeeze(F.regexp_replace(without_accents(F.lower(c)), r"[^A-Za-z0-9_\s.]", " "))


def words(c: Column) -> Column:
    """The blank-separated words; an empty array for an empty text."""
    return F.filter(F.split(c, " "), lambda w: w != "")


def tokenize(c: Column) -> Column:
    """Distinct search tokens in order: the words, then number-and-unit tokens."""
    norm = normalize(c)
    raw = words(norm)
    low = F.lit("(?i)" + _SPEC)
    specs = F.zip_with(F.regexp_extract_all(norm, low, F.lit(1)), F.regexp_extract_all(norm, low, F.lit(2)), lambda n, u: F.concat(n, F.regexp_replace(F.lower(u), r"\s", "")))
    return F.array_distinct(F.concat(raw, specs))


def search_specs(c: Column) -> Column:
    """array<struct<value double, unit string, raw string>> of the numbers with units in a text."""
    pattern = F.lit("(?i)" + _SPEC)
    def unit(u: Column) -> Column:
        u = F.regexp_replace(F.regexp_replace(F.lower(u), r"\s", ""), '"', "inch")
        return F.regexp_replace(u, "([kmg])o", "$1b")
    value = F.regexp_extract_all(c, pattern, F.lit(1))
    units = F.regexp_extract_all(c, pattern, F.lit(2))
    raw = F.regexp_extract_all(c, pattern, F.lit(0))
    zipped = F.arrays_zip(value.alias("v"), units.alias("u"), raw.alias("r"))
    return F.transform(zipped, lambda z: F.struct(z["v"].cast("double").alias("value"), unit(z["u"]).alias("unit"), z["r"].alias("raw")))


def phonetic_key(c: Column) -> Column:
    """Consonants and vowels that sound alike as one letter; anything but a-z goes."""
    t = F.translate(F.lower(c), "ckqszfvbpdtgjiyouaern", "kkkssffppttggiiooeenn")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "w+", "w"), "h+", "h"), "[^a-z]", "")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, over lower-case letters, digits and blanks; 1 for two empty texts."""
    clean = lambda c: F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", " ")
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(clean(a), clean(b)) / longest)


def unescape(c: Column, entities: dict[str, str] = ENTITIES) -> Column:
    for entity, char in entities.items():
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def clean_product_name(c: Column) -> Column:
    """Blanks, outer dashes, quotes and the five basic entities of a product name."""
    c = F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"^[-\s]+|[-\s]+$", "")
    c = F.regexp_replace(c, "[\"']", '"')
    return F.trim(unescape(c, {k: ENTITIES[k] for k in ("&amp;", "&quot;", "&lt;", "&gt;", "&nbsp;")}))


# Generic words that don't tell products apart when names are matched.
GENERIC_WORDS = "ecran pc|processeur|carte graphique|carte mere|disque dur|boitier|alimentation|clavier|souris|casque|ecran|pc"
# Words of offers that are no part of a catalogue name.
OFFER_WORDS = "used|etat|occasion|neuf|new|tray|bulk|boite|box|in stock|disponible|livraison|promo|soldes|offre|special|limited|edition|tactile|inclinable|reconditionne|reconditionné|oem"


def for_matching(c: Column) -> Column:
    c = F.regexp_replace(F.lower(c), r"[^A-Za-z0-9_\s]", " ")
    return squeeze(F.regexp_replace(c, rf"(?<![A-Za-z0-9_])(?:{GENERIC_WORDS})(?![A-Za-z0-9_])", " "))


def scraped_name(c: Column) -> Column:
    c = F.regexp_replace(F.lower(c), rf"(?<![A-Za-z0-9_])(?:{OFFER_WORDS})(?![A-Za-z0-9_])", " ")
    return squeeze(F.regexp_replace(c, r"[^A-Za-z0-9_\s\-]", " "))


def slug(c: Column, length: int = 60) -> Column:
    """Runs of anything but a-z and digits become one dash; accents count as such."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, length)


def slug_ascii(c: Column, length: int = 80) -> Column:
    """Accents folded first, slashes as dashes, other signs dropped; "" for null."""
    t = F.regexp_replace(without_accents(F.lower(F.coalesce(c, F.lit("")))), "/+", "-")
    t = F.trim(F.regexp_replace(t, r"[^a-z0-9\s-]", ""))
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\s+", "-"), "-+", "-"), "^-+|-+$", "")
    return F.substring(t, 1, length)


def offer_id(name: Column, retailer: Column) -> Column:
    """retailer-name of at most 30 word characters."""
    left = F.regexp_replace(F.lower(F.coalesce(retailer, F.lit("unknown"))), r"\s+", "")
    return F.concat(left, F.lit("-"), F.substring(F.regexp_replace(F.lower(name), "[^A-Za-z0-9_]", ""), 1, 30))


def hash31(c: Column) -> Column:
    """Hex of the absolute 32-bit rolling hash h*31 + character, wrapped as signed integers."""
    wrap = lambda x: (x + F.lit(1 << 31)).cast("long").bitwiseAND(F.lit((1 << 32) - 1)) - F.lit(1 << 31)
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    total = F.aggregate(codes, F.lit(0).cast("long"), lambda h, x: wrap(h * 31 + x))
    return F.lower(F.hex(F.abs(total)))


def without_repeated_words(c: Column) -> Column:
    """Consecutive equal words (whatever their case) once."""
    w = words(squeeze(c))
    kept = F.filter(w, lambda x, i: (i == 0) | (F.lower(x) != F.lower(F.element_at(w, F.when(i > 0, i).otherwise(F.lit(1))))))
    return F.array_join(kept, " ")


def spec_lines(specs: Column, default: str = "Produit neuf") -> Column:
    """"key: value" lines of a specs map without empty, Unknown and N/A values; the default where none is left."""
    entries = F.filter(F.map_entries(specs), lambda e: e["value"].isNotNull() & ~e["value"].isin("", "Unknown", "N/A"))
    lines = F.transform(F.array_sort(entries), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.when(F.size(lines) > 0, lines).otherwise(F.array(F.lit(default)))


# Shop words taken out of titles, each where it first stands, also inside words.
FLUFF = ("dz$", "dz\\s+", "dz\\b", "algerie", "algeria", "dzair", "store", "shop", "market", "boutique", "gamme", "series", "collection", "nouveau", "new", "neuf", "occasion", "promo", "solde", "discount", "offre", "en stock", "disponible", "livraison", "best price", "meilleur prix", "acheter", "buy", "commande", "pc gamer", "gaming", "pro", "ultra", "setup", "config", "build")


def without_fluff(c: Column, length: int = 120) -> Column:
    """A title without mark-up, links, shop words and signs, cut at a word where it is longer than ``length``."""
    c = squeeze(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), r"https?://\S+", ""))
    for word in FLUFF:
        # the first occurrence only: what stands before it is kept by a reluctant prefix
        c = F.regexp_replace(c, f"(?is)^(.*?)(?:{word})", "$1")
    c = squeeze(F.regexp_replace(c, r"[⭐✅🔥💯🎮💻]|\bnull\b|\bundefined\b", ""))
    c = F.trim(F.regexp_replace(c, r"[\-|/\\,.]+$", ""))
    return F.when(F.length(c) > length, F.regexp_replace(F.substring(c, 1, length), r"\s+\S*$", "")).otherwise(c)
