"""Free-entered values mapped to the closest entry of a reference list.

The names of the entries (value, other-language name, and the words of a name
in another order) stand in a BK-tree under the unrestricted Damerau-Levenshtein
metric.  A typed value and its runs of words are looked up; the triangle
inequality prunes the tree, every entry within the threshold is returned, and
the closest wins.  Besides words that shops put around a name, a value may hold
one word more than the name, which weighs like an edit.  Hosts must agree exactly;
a value that is no entry and ends in a full stop may be the begin of a name.

A reference list up to ``MOST_BROADCAST`` names is one tree that every task
holds; a longer one is cut into shards, each value meets each shard in its own
task, and the shard winners are merged.

Defined results: null and blank values have no row; a value that is an entry
exactly has none either; placeholders, unknown names and values equally close to
two entries get ref_id 0.  Repeated rows of one id count once.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm.words import damerau, fold
from pricetide.session import checkpointed

MOST_BROADCAST = 50_000
#: Ranks of beginnings of a name, spelled exactly or with one edit: behind every other match.
BEGINNING, MISSPELT_BEGINNING = (50, 0), (51, 0)
#: Distinct typed values that meet a shard in one task.
VALUES_PER_TASK = 20_000
#: Edits allowed: one for a name of four to six letters, two from seven on; none below.
MOST_EDITS = 2
NO_MATCH = (99, 99)

# Words around a name that say nothing about it.
SIDE_WORDS = frozenset("marque brand officiel official gaming gamer dz corp sarl eurl ets boutique web co pc categorie category composants composant shop store site le la les the".split())


class BKTree:
    """Names under a metric; ``within`` visits only branches that the triangle inequality allows."""

    def __init__(self) -> None:
        self.root: list | None = None
        self.visited = 0

    def add(self, name: str, payload: object) -> None:
        if self.root is None:
            self.root = [name, {payload}, {}]
            return
        node = self.root
        while True:
            d = damerau(name, node[0])
            if d == 0:
                node[1].add(payload)
                return
            if d not in node[2]:
                node[2][d] = [name, {payload}, {}]
                return
            node = node[2][d]

    def within(self, name: str, most: int) -> list[tuple[int, str, object]]:
        found: list[tuple[int, str, object]] = []
        open_ = [self.root] if self.root else []
        while open_:
            node = open_.pop()
            self.visited += 1
            d = damerau(name, node[0])
            if d <= most:
                found += [(d, node[0], p) for p in node[1]]
            open_ += [child for at, child in node[2].items() if d - most <= at <= d + most]
        return found


def squeezed(text: str) -> str:
    return re.sub(r"[^\w]|_", "", text)


def edits_for(name: str) -> int:
    return 0 if len(name) < 4 else 1 if len(name) < 7 else MOST_EDITS


class Matcher:
    """One shard of the reference list of one kind."""

    def __init__(self, entries: list[tuple[int, str, str | None, str | None]]):
        self.tree, self.exact, self.longest = BKTree(), {}, 0
        self.beginnings: dict[str, set[int]] = {}
        self.begin_trees: dict[int, BKTree] = {}
        for ref_id, value, alt, code in entries:
            for name in (value, alt):
                words = re.findall(r"[^\W_]+", fold(name))
                for i in range(len(words)):
                    key = "".join(words[i:] + words[:i])
                    self.exact.setdefault(key, set()).add(ref_id)
                    self.tree.add(key, ref_id)
                    self.longest = max(self.longest, len(key))
                joined = "".join(words)
                for size in range(len(words[0]) + 1, len(joined) + 1) if len(words) > 1 else ():
                    self.beginnings.setdefault(joined[:size], set()).add(ref_id)
                    if size > len(words[0]) + 1:
                        self.begin_trees.setdefault(size, BKTree()).add(joined[:size], ref_id)
            if code and squeezed(fold(code)):
                self.exact.setdefault(squeezed(fold(code)), set()).add(ref_id)

    def match(self, typed: str) -> tuple[tuple[int, int], list[int]]:
        """Rank (edits and foreign words dropped, words dropped) of the closest entries, and the entries."""
        text = re.sub(r"^[a-z]+://|(?<![\w])www\.", "", fold(typed)).strip(" /.")
        whole = squeezed(text)
        if whole in self.exact:
            return (0, 0), sorted(self.exact[whole])
        words = re.findall(r"[^\W_]+", text)
        best: tuple[int, int] = NO_MATCH
        entries: set[int] = set()

        def take(rank: tuple[int, int], ids: set[int]) -> None:
            nonlocal best, entries
            if rank < best:
                best, entries = rank, set(ids)
            elif rank == best:
                entries |= ids

        n = len(words)
        single = n > 3 and all(len(w) == 1 for w in words)
        foreign = [0]
        for w in words:
            foreign.append(foreign[-1] + (w not in SIDE_WORDS))
        runs = [(0, n)] if single else sorted(self._runs(words), key=lambda r: r[0] - r[1])
        for i, j in runs:
            # dropping a word of unknown meaning weighs like an edit
            dropped, outside = foreign[n] - foreign[j] + foreign[i], n - (j - i)
            if dropped > 1:
                continue
            run = "".join(words[i:j])
            if len(run) > self.longest + MOST_EDITS:
                continue
            if run in self.exact and (len(run) > 2):
                take((dropped, outside), self.exact[run])
                continue
            most = min(edits_for(run), best[0] - dropped)
            if most > 0:
                for d, name, ref_id in self.tree.within(run, most):
                    if d <= edits_for(name):
                        take((d + dropped, outside), {ref_id})
        if best == NO_MATCH and fold(typed).endswith(".") and len(whole) >= 5:
            take(BEGINNING, self.beginnings.get(whole, set()))
            if not entries and len(whole) in self.begin_trees:
                best = NO_MATCH
                take(MISSPELT_BEGINNING, {ref_id for _, _, ref_id in self.begin_trees[len(whole)].within(whole, 1)})
        return (best, sorted(entries)) if entries else (NO_MATCH, [])

    def _runs(self, words: list[str]) -> Iterator[tuple[int, int]]:
        """Runs of words that are not longer than the longest name may be."""
        for i in range(len(words)):
            size = 0
            for j in range(i, len(words)):
                size += len(words[j])
                if size > self.longest + MOST_EDITS:
                    break
                yield i, j + 1


_MATCHERS: dict[str, Matcher] = {}


def _matcher(key: str, entries: list[tuple[int, str, str | None, str | None]]) -> Matcher:
    """The trees of a list of entries, built once in each process."""
    if key not in _MATCHERS:
        if len(_MATCHERS) >= 8:
            _MATCHERS.clear()
        _MATCHERS[key] = Matcher(entries)
    return _MATCHERS[key]


def _entries(ref: DataFrame) -> list[tuple[int, str, str | None, str | None]]:
    rows = ref.select("ref_id", "value", "alt_value", "short_code").where("value is not null").orderBy("ref_id").collect()
    return [(r[0], r[1], r[2], r[3]) for r in rows]


def mapped_values(values: DataFrame, ref: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """``value``, ``ref_id`` of each distinct typed value; ``ref`` holds the entries of one kind."""
    spark = values.sparkSession
    schema = "value string, edits int, dropped int, ref_id long, entries int"
    size = ref.limit(most_broadcast + 1).count()

    def rows_of(matcher: Matcher, typed: pd.Series) -> pd.DataFrame:
        out = []
        for v in typed:
            (edits, dropped), ids = matcher.match(v)
            out.append((v, edits, dropped, ids[0] if ids else 0, len(ids)))
        return pd.DataFrame(out, columns=["value", "edits", "dropped", "ref_id", "entries"])

    if size <= most_broadcast:
        held, key = spark.sparkContext.broadcast(_entries(ref)), uuid.uuid4().hex

        def one(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            matcher = _matcher(key, held.value)
            for frame in frames:
                yield rows_of(matcher, frame["value"])

        # spread by number and by another key than that of the distinct values: the search costs far more than their bytes tell
        spread = values.select("value").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("value"))
        found = spread.mapInPandas(one, schema)
    else:
        shards = -(-ref.count() // most_broadcast)
        parts = ref.select("ref_id", "value", "alt_value", "short_code", F.pmod(F.xxhash64("ref_id"), F.lit(shards)).alias("shard"))
        # a value meets each shard; salts keep a shard's values apart in pieces that fit one task
        pieces = values.select("value", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
        salts = -(-values.count() // VALUES_PER_TASK) or 1
        pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(salts)))
        parts = parts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

        def both(typed: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
            rows = entries.astype(object).where(entries.notna(), None)
            return rows_of(Matcher(list(zip(rows["ref_id"], rows["value"], rows["alt_value"], rows["short_code"]))), typed["value"])

        found = pieces.groupBy("shard", "salt").cogroup(parts.groupBy("shard", "salt")).applyInPandas(both, schema)
    found = checkpointed(found)
    best = found.where("entries > 0").groupBy("value").agg(F.min(F.struct("edits", "dropped", "entries", "ref_id")).alias("w"), F.min_by(F.struct("edits", "dropped"), F.struct("edits", "dropped")).alias("r"))
    ties = found.where("entries > 0").join(best, "value").where("edits = r.edits and dropped = r.dropped").groupBy("value").agg(F.min("ref_id").alias("low"), F.max("ref_id").alias("high"), F.max("entries").alias("most"))
    sure = ties.where("low = high and most = 1").select("value", F.col("low").alias("ref_id"))
    return values.select("value").join(sure, "value", "left").select("value", F.coalesce("ref_id", F.lit(0).cast("long")).alias("ref_id"))


def mapped_field(table: DataFrame, id_column: str, value_column: str, kind: str, ref_values: DataFrame, field_name: str | None = None) -> DataFrame:
    """field_name, record_id, ref_id of every value that isn't exactly an entry of its kind.

    Distinct values are mapped once and joined back, so the look-ups grow with
    the different spellings, not with the rows.
    """
    ref = ref_values.where(F.col("kind") == kind)
    typed = table.select(F.col(id_column).cast("long").alias("record_id"), F.col(value_column).alias("value"))
    typed = typed.where("value is not null").where(F.regexp_replace("value", r"[\s ]+", "") != "")
    exact = ref.where("value is not null").select("value").distinct()
    typed = typed.join(exact, "value", "left_anti")
    mapped = mapped_values(typed.select("value").distinct(), ref)
    return typed.join(mapped, "value").select(F.lit(field_name or value_column).alias("field_name"), "record_id", "ref_id").distinct()


def mapped_catalogue(clean_products: DataFrame, listings: DataFrame, ref_values: DataFrame) -> DataFrame:
    """The typed brands and categories of products and the shop names of listings."""
    return (
        mapped_field(clean_products, "product_id", "brand", "brand", ref_values)
        .unionByName(mapped_field(clean_products, "product_id", "category", "category", ref_values))
        .unionByName(mapped_field(listings, "listing_id", "source_name", "source", ref_values))
    )
