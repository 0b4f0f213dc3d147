"""Price texts to numbers, and arithmetic on prices, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FLOAT = r"^[+-]?(?:\d+\.?\d*|\.\d+)$"


def _nonempty(c: Column) -> Column:
    return F.when(c != "", c)


def clean_price(c: Column, cap: float = 5_000_000) -> Column:
    """A price in French or local notation as double; null where unreadable, not positive or from ``cap`` on.

    A comma before one or two final digits is a decimal comma; ".000" is a thousands mark.
    """
    t = F.regexp_replace(F.regexp_replace(c, r"[\s  ]", ""), r"(?i)DA|DZD|\$|€|£|din", "")
    t = F.when(t.rlike(r",\d{1,2}$"), F.replace(t, F.lit(","), F.lit("."))).otherwise(F.replace(t, F.lit(","), F.lit("")))
    t = F.when(t.rlike(r"^\d+\.000$"), F.replace(t, F.lit("."), F.lit(""))).otherwise(t)
    value = F.when(t.rlike(_FLOAT), t.try_cast("double"))
    return F.when((value > 0) & (value < cap), value)


def scraped_price(c: Column) -> Column:
    """Whole dinars from a scraped text: dotted thousands first, then spaced ones, then a plain number of three digits or more."""
    t = F.regexp_replace(c, "د\\.ج", "")
    t = F.regexp_replace(t, r"(?i)DZD", "")
    t = F.regexp_replace(t, r"(?i)DA(?![A-Za-z0-9_])", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)Dinar", ""), r"(?i)Prix", "")
    t = F.trim(F.regexp_replace(F.replace(t, F.lit(","), F.lit("")), r"[\s  ]+", " "))
    return F.coalesce(*_readings(t, (r"(\d{1,3}(?:\.\d{3})+)", r"(\d{1,3}(?:\s+\d{3})+)", r"(\d{3,})")))


def listed_price(c: Column) -> Column:
    """Like ``scraped_price`` but with spaced thousands tried before dotted ones."""
    t = F.regexp_replace(F.lower(c), "[\n\t ]", " ")
    t = F.regexp_replace(t, "د\\.ج|dzd|da|dinar|,", "")
    return F.coalesce(*_readings(F.trim(t), (r"(\d{1,3}(?:\s+\d{3})+)", r"(\d{1,3}(?:\.\d{3})+)", r"(\d{3,})")))


def _readings(t: Column, patterns: tuple[str, ...]) -> list[Column]:
    return [F.regexp_replace(_nonempty(F.regexp_extract(t, p, 1)), r"[\s.]", "").try_cast("long") for p in patterns]


def engine_price(c: Column) -> Column:
    """The leading number after currency, blanks and commas are gone, as double."""
    t = F.regexp_replace(c, r"[\s ]", "")
    t = F.regexp_replace(t, r"(?i)[.,](\d{2})\s*DA$", ".$1")
    t = F.replace(F.regexp_replace(t, r"(?i)DA|DZD|\$|€|£", ""), F.lit(","), F.lit(""))
    return _nonempty(F.regexp_extract(t, r"^([+-]?(?:\d+\.?\d*|\.\d+))", 1)).try_cast("double")


def price_range(c: Column, least: float = 1000) -> Column:
    """struct<current, old> of a line with one or more prices above ``least``: the smallest, and the largest of several."""
    found = F.transform(F.regexp_extract_all(F.replace(c, F.lit(" "), F.lit(" ")), F.lit(r"([\d,.]+)"), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double"))
    prices = F.filter(found, lambda x: x > least)
    return F.struct(F.array_min(prices).alias("current"), F.when(F.size(prices) > 1, F.array_max(prices)).alias("old"))


def plain_price(c: Column) -> Column:
    """Digits left after commas, blanks and the currency are gone."""
    return F.regexp_replace(c, r"(?i)[,\s]|DA", "").try_cast("long")


def half_up(c: Column) -> Column:
    """Rounding of halves upwards."""
    return F.floor(c + F.lit(0.5)).cast("long")


def half_even(c: Column) -> Column:
    """Rounding of halves to the even neighbour."""
    return F.bround(c, 0).cast("long")


def savings(current: Column, original: Column) -> Column:
    """What is saved, never negative; 0 where either price is missing."""
    return F.coalesce(F.greatest(original - current, F.lit(0)), F.lit(0))


def savings_percent(current: Column, original: Column) -> Column:
    return F.when(original > current, half_up((1 - current / original) * 100)).otherwise(F.lit(0).cast("long"))


def format_price(c: Column, currency: str = "DA") -> Column:
    return F.when(c.isNotNull(), F.concat(F.format_number(c.cast("double"), 0), F.lit(f" {currency}"))).otherwise(F.lit(""))


def hundredfold_fixed(c: Column, cap: int = 5_000_000, least: int = 1000) -> Column:
    """A price that is a hundred times too high, put right."""
    fixed = half_up(c / 100)
    return F.when((c > cap) & fixed.between(least, cap), fixed).otherwise(c)


def spec_distance_score(a: Column, b: Column) -> Column:
    """80 for equal values, 50 within a tenth, 25 within a quarter of their mean, else 0."""
    ratio = F.abs(a - b) / ((a + b) / 2)
    return F.when(a == b, 80).when(ratio <= 0.1, 50).when(ratio <= 0.25, 25).otherwise(0)
