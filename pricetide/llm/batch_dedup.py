"""Repeats of already accepted offers in new batches, without going through the history again.

Every offer gets a 64-bit fingerprint of its item wording, in which similar
wordings differ in few bits: the model and line weigh more than all that a seller
may leave out, so a wording without the brand or an attribute lies within the
bits allowed.  The fingerprints of all accepted offers stand in a store of
rotated block tables: the word is cut into five blocks, and for each of the ten
pairs of blocks one table holds the fingerprint keyed by those two blocks, the
shop and the condition.  Two fingerprints that differ in at most three bits agree
in at least two whole blocks, so an exact look-up of the ten keys finds every one
of them.  Candidates are verified by Hamming distance and by what their texts
state; the fingerprints of new offers are appended.

Equal wordings come out of the same look-up, with a distance of zero; there is no
other way from an offer to those before it.

Defined results: a null or unreadable name is compared by its words; a null
condition is a condition of its own; a url without a host is the shop "";
repeated rows of one listing_id count once; rows without a batch_no belong to the
history.  An empty batch gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetide.llm.product_phrases import PhraseReader, correct_lines, count_lines
from pricetide.llm.words import fold
from pricetide.session import release, remove, scratch_path

MOST_BITS = 3
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
TABLES = tuple(combinations(range(len(BLOCKS)), 2))
#: Weights of the parts of an item wording in its fingerprint.
WEIGHTS = {"model": 9, "line": 3, "brand": 1, "attribute": 1}
#: Look-ups read only the stored offers of the batch's shops where it has at most so many shops and conditions.
MOST_PLACES = 1_000
#: The look-up keys of a batch of at most so many offers are broadcast to the stored ones.
MOST_SENT = 2_000
#: Word overlap from which two names without a readable model are the same text.
LEAST_OVERLAP = 0.8

_OFFER = T.StructType([
    T.StructField("listing_id", T.LongType()), T.StructField("shop", T.StringType()), T.StructField("condition", T.StringType()),
    T.StructField("sku", T.StringType()), T.StructField("offer_key", T.StringType()), T.StructField("fingerprint", T.LongType()),
])


def shop_of(url: Column) -> Column:
    """The shop behind a url: its host in lower case without port, "www." and the like."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#\s]*)", 1))
    return F.regexp_replace(host, r"^(?:www[0-9]?|shop|m|store|boutique)\.(?=[^.]+\.)", "")


def real_sku(sku: Column) -> Column:
    """The article number without separators and label, or null for a placeholder: a real one has letters and at least four digits."""
    s = F.regexp_replace(F.regexp_replace(F.upper(F.trim(sku)), r"^(?:SKU|REF)\s*[#:.]\s*", ""), r"[-_./\s]", "")
    return F.when(s.rlike("[A-Z]") & s.rlike("[0-9].*[0-9].*[0-9].*[0-9]"), s)


class Fingerprint:
    """64-bit similarity fingerprints: the sign, bit by bit, of the weighted sum of hashed parts."""

    def __init__(self) -> None:
        self._row: dict[str, int] = {}
        self._bits = np.zeros((1024, 64), dtype=np.int16)

    def _index(self, gram: str) -> int:
        at = self._row.get(gram)
        if at is None:
            at = len(self._row)
            if at >= len(self._bits):
                self._bits = np.vstack([self._bits, np.zeros_like(self._bits)])
            digest = np.frombuffer(hashlib.blake2b(gram.encode(), digest_size=8).digest(), dtype=np.uint8)
            self._bits[at] = np.unpackbits(digest).astype(np.int16) * 2 - 1
            self._row[gram] = at
        return at

    def of(self, parts: Iterable[tuple[str, int]]) -> int:
        """The fingerprint of weighted parts, taken piece by piece as there may be very many."""
        total, rows, weights = np.zeros(64, dtype=np.int64), [], []
        for part, weight in parts:
            if len(rows) == 4096:
                total += np.array(weights) @ self._bits[rows]
                rows, weights = [], []
            if len(self._row) > 500_000 and not rows:
                self._row.clear()
            rows.append(self._index(part))
            weights.append(weight)
        if rows:
            total += np.array(weights) @ self._bits[rows]
        return int(np.packbits((total > 0).astype(np.uint8)).view(">i8")[0])


def _stated(reader: PhraseReader, name: str | None) -> str:
    """The canonical wording of a name: what it states, in fixed order; its words where no model is read."""
    r = reader.read(name)
    if r.model is None:
        return "words " + " ".join(sorted(set(re.findall(r"\w+", fold(name)))))
    one = lambda x: x.replace(" ", "_") if x else "?"
    return " ".join(["item", one(r.brand), one(r.line), one(r.model), *(f"{k}={v}" for k, v in r.attributes)])


def weighted_parts(offer_key: str) -> Iterator[tuple[str, int]]:
    """What of a canonical wording goes into its fingerprint, and how much it weighs: 4-grams where no model is read."""
    if offer_key.startswith("item "):
        _, brand, line, model, *facts = offer_key.split(" ")
        told = [("model", model), ("line", line), ("brand", brand), *(("attribute", f) for f in facts)]
        return ((f"{kind} {value}", WEIGHTS[kind]) for kind, value in told if value != "?")
    padded = f"  {offer_key}  "
    return ((padded[i:i + 4], 1) for i in range(len(padded) - 3))


def offers(listings: DataFrame, brands: list[str], lines: list[str]) -> DataFrame:
    """listing_id, shop, condition, sku, offer_key and fingerprint of each listing."""
    wanted = listings.select(
        F.col("listing_id").cast("long").alias("listing_id"), shop_of(F.col("url")).alias("shop"),
        F.lower(F.trim(F.coalesce(F.col("condition"), F.lit("?")))).alias("condition"), real_sku(F.col("sku")).alias("sku"),
        F.col("canonical_name").alias("name"),
    )

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, prints = PhraseReader(brands, lines), Fingerprint()
        for frame in frames:
            key = [_stated(reader, n if isinstance(n, str) else None) for n in frame["name"]]
            frame["offer_key"] = key
            frame["fingerprint"] = [prints.of(weighted_parts(k)) for k in key]
            yield frame[_OFFER.fieldNames()]

    return wanted.mapInPandas(parts, _OFFER)


def _block(fingerprint: Column, i: int) -> Column:
    begin, width = BLOCKS[i]
    return F.shiftrightunsigned(fingerprint, 64 - begin - width).bitwiseAND(F.lit((1 << width) - 1))


def _blocks(fingerprint: Column) -> Column:
    """The ten look-up keys of a fingerprint: table number and the two rotated-in blocks in one number."""
    return F.array(*[
        F.shiftleft(_block(fingerprint, i), BLOCKS[j][1]).bitwiseOR(_block(fingerprint, j)) + F.lit(n << 32) for n, (i, j) in enumerate(TABLES)])


def first_table(difference: Column) -> Column:
    """The first table in which two fingerprints meet, given their exclusive or; null where they meet in none."""
    equal = [_block(difference, i) == 0 for i in range(len(BLOCKS))]
    return F.coalesce(*[F.when(equal[i] & equal[j], F.lit(n)) for n, (i, j) in enumerate(TABLES)])


def rotated(offers_: DataFrame) -> DataFrame:
    """block_key, place, fingerprint, offer_id, nth: one row per offer and block table.

    Offers of different shops or conditions never match, so both go into the
    key; a hot shop is spread over all its block values.  Texts stay behind.
    """
    place = F.xxhash64("shop", "condition")
    rows = offers_.select("offer_id", "fingerprint", place.alias("place"), F.posexplode(_blocks(F.col("fingerprint"))).alias("nth", "block"))
    return rows.select(F.xxhash64("block", "place").alias("block_key"), "place", "fingerprint", "offer_id", "nth")


def _compatible(a: Column, b: Column) -> Column:
    """Whether two different canonical wordings can mean one item."""
    wa, wb = F.split(a, " "), F.split(b, " ")
    heads = [(F.get(wa, F.lit(i)) == F.get(wb, F.lit(i))) | (F.get(wa, F.lit(i)) == "?") | (F.get(wb, F.lit(i)) == "?") for i in (1, 2)]
    names = lambda w: F.transform(F.filter(w, lambda x: x.contains("=")), lambda x: F.substring_index(x, "=", 1))
    values = lambda w: F.filter(w, lambda x: x.contains("="))
    shared = F.size(F.array_intersect(names(wa), names(wb))) == F.size(F.array_intersect(values(wa), values(wb)))
    items = a.startswith("item ") & b.startswith("item ") & heads[0] & heads[1] & (F.get(wa, F.lit(3)) == F.get(wb, F.lit(3))) & shared
    overlap = F.size(F.array_intersect(wa, wb)) >= F.size(F.array_union(wa, wb)) * F.lit(LEAST_OVERLAP)
    return items | ((a.startswith("words ") | b.startswith("words ")) & overlap)


_OFFER_KEY = ["offer_id", "shop", "condition", "offer_key"]
_TEXT = [*_OFFER_KEY, "sku", "first_id", "linked"]


class OfferStore:
    """All accepted offers: rotated block tables of their fingerprints and a table of their texts.

    Both lie in the shared folder in parts, bucketed by block key and by offer
    when they are written, so a look-up shuffles what the batch holds and never
    what is stored; of the stored parts it reads the keys of the batch's shops,
    and the texts of the candidates.  A part that is no longer larger than twice
    the next one is merged with it, so there are logarithmically many parts and
    each offer is rewritten as often.  All but small batches are joined by merging:
    files are several times smaller than their rows in memory, and a broadcast
    chosen by their size would hold all of them in the driver.  ``buckets`` is fixed for a store; by
    default it is the session's number of shuffle partitions.
    """

    def __init__(self, spark: SparkSession, brands: list[str], path: str | None = None, buckets: int | None = None):
        self.spark, self.brands = spark, brands
        self.path = path or scratch_path(spark, "offers")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"offers_{uuid.uuid4().hex}"
        self.lines: dict[str, int] = {}
        self.parts: list[tuple[int, int]] = []  # number and offers of each part, the oldest first
        self.batches = self.written = 0

    def _part(self, kind: str, number: int) -> DataFrame:
        return self.spark.table(f"{self.name}_{kind}_{number}")

    def _write(self, rows: DataFrame, kind: str, number: int, key: str) -> None:
        spread = rows.repartition(self.buckets, key).write.bucketBy(self.buckets, key).sortBy("place", key) if kind == "blocks" else rows.repartition(self.buckets, key).write.bucketBy(self.buckets, key)
        spread.option("path", f"{self.path}/{kind}/{number}").saveAsTable(f"{self.name}_{kind}_{number}")

    def _drop(self, number: int) -> None:
        for kind in ("blocks", "texts"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{kind}_{number}")
            remove(self.spark, f"{self.path}/{kind}/{number}")

    def _append(self, texts: DataFrame, blocks: DataFrame) -> None:
        number = self.written
        self.written += 1
        self._write(texts, "texts", number, "offer_id")
        self._write(blocks, "blocks", number, "block_key")
        self.parts.append((number, self._part("texts", number).count()))
        if len(self.parts) > 1 and self.parts[-2][1] < 2 * self.parts[-1][1]:
            (a, _), (b, _) = self.parts[-2:]
            del self.parts[-2:]
            self._append(*(self._part(kind, a).unionByName(self._part(kind, b)) for kind in ("texts", "blocks")))
            self._drop(a)
            self._drop(b)

    def close(self) -> None:
        """Remove the store; the results of its batches stay."""
        for number, _ in self.parts:
            self._drop(number)
        for label in ("rows", "offers", "roots"):
            remove(self.spark, f"{self.path}/{label}")
        self.parts = []

    def accept(self, batch: DataFrame) -> DataFrame:
        """The rows of ``batch`` that repeat an offer: first_listing_id, listing_id.  The result is a written table."""
        spark = self.spark
        rows_at, offers_at, roots_at, found_at = (f"{self.path}/{label}/{self.batches}" for label in ("rows", "offers", "roots", "found"))
        for line, n in count_lines(batch, "canonical_name", self.brands).items():
            self.lines[line] = self.lines.get(line, 0) + n
        read_rows = offers(batch, self.brands, correct_lines(self.lines)).withColumn("offer_id", F.xxhash64("shop", "condition", "offer_key"))
        read_rows.write.parquet(rows_at)
        rows = spark.read.parquet(rows_at)
        # one row per offer; copies of a hot offer are merged before anything is shuffled by key
        rows.groupBy(*_OFFER_KEY, "fingerprint").agg(F.min("listing_id").alias("first_id"), F.max("sku").alias("sku"), F.lit(False).alias("linked")).write.parquet(offers_at)
        mine = spark.read.parquet(offers_at)
        self._roots(mine).write.parquet(roots_at)
        release(spark)
        settled = mine.join(spark.read.parquet(roots_at).hint("merge"), _OFFER_KEY, "left")
        root = F.least("first_id", F.coalesce("root", "first_id"))
        linked = rows.hint("merge").join(settled.select(*_OFFER_KEY, root.alias("root")), _OFFER_KEY).where("listing_id > root")
        linked.select(F.col("root").alias("first_listing_id"), "listing_id").distinct().write.parquet(found_at)
        new = settled.where(~F.coalesce("stored", F.lit(False)))
        texts = new.select(*_OFFER_KEY, "sku", root.alias("first_id"), F.col("root").isNotNull().alias("linked"))
        self._append(texts, rotated(new))
        self.batches += 1
        release(spark)
        return spark.read.parquet(found_at)

    def _roots(self, mine: DataFrame) -> DataFrame:
        """Key of an offer, root, stored: the earliest offer that each offer of the batch agrees with, and whether it is stored already."""
        asked = rotated(mine).repartition(self.buckets, "block_key")
        ask = asked.select("block_key", "place", "nth", "fingerprint", "offer_id").hint("broadcast" if mine.count() <= MOST_SENT else "merge")
        places = [r[0] for r in mine.select(F.xxhash64("shop", "condition").alias("place")).distinct().limit(MOST_PLACES + 1).collect()]
        pairs = [self._met(ask, asked, mine, stored=False)]
        for number, _ in self.parts:
            blocks = self._part("blocks", number)
            if len(places) <= MOST_PLACES:
                blocks = blocks.where(F.col("place").isin(places))
            pairs.append(self._met(ask, blocks, self._part("texts", number), stored=True))
        met = pairs[0]
        for p in pairs[1:]:
            met = met.unionByName(p)
        met = self._judged(met, mine)
        facts = F.filter(F.split("o_offer_key", " "), lambda x: x.contains("="))
        stated = F.array_distinct(F.flatten(F.collect_set(F.when(F.col("agrees"), facts))))
        agreed = met.groupBy(*_OFFER_KEY).agg(
            F.min(F.when(F.col("equal"), F.col("o_first_id"))).alias("known"), F.min(F.when(F.col("same_sku"), F.col("o_first_id"))).alias("by_sku"),
            F.min(F.when(F.col("agrees"), F.col("o_first_id"))).alias("earliest"), stated.alias("stated"))
        # agreeing with offers that contradict each other tells none of them
        kinds = F.array_distinct(F.transform("stated", lambda x: F.substring_index(x, "=", 1)))
        root = F.coalesce("known", "by_sku", F.when(F.size(kinds) == F.size("stated"), F.col("earliest")))
        return agreed.select(*_OFFER_KEY, root.alias("root"), F.col("known").isNotNull().alias("stored")).where("root is not null")

    def _met(self, ask: DataFrame, blocks: DataFrame, texts: DataFrame, stored: bool) -> DataFrame:
        """The candidates among ``blocks``, whose texts are ``texts``: the offer's id and what the other states."""
        theirs = blocks.select("block_key", F.col("place").alias("o_place"), F.col("nth").alias("o_nth"), F.col("fingerprint").alias("o_fingerprint"), F.col("offer_id").alias("o_id"))
        differ = F.col("fingerprint").bitwiseXOR(F.col("o_fingerprint"))
        near = ask.join(theirs, "block_key").where((F.col("place") == F.col("o_place")) & (F.col("nth") == F.col("o_nth")) & (F.bit_count(differ) <= MOST_BITS))
        # a pair meets in every table in which it agrees; the first one counts
        near = near.where(F.col("nth") == first_table(differ)).select("offer_id", "o_id")
        if not stored:
            near = near.where("offer_id <> o_id")
        other = texts.select(*(F.col(c).alias("o_id" if c == "offer_id" else f"o_{c}") for c in _TEXT))
        return near.join(other.hint("merge"), "o_id")

    def _judged(self, met: DataFrame, mine: DataFrame) -> DataFrame:
        """The verified ones of the candidates of all parts: the offer's key, what the other states and how they agree."""
        own = mine.select(*_OFFER_KEY, "sku", "first_id")
        pairs = met.join(own.hint("merge"), "offer_id").where((F.col("shop") == F.col("o_shop")) & (F.col("condition") == F.col("o_condition")))
        equal = F.col("offer_key") == F.col("o_offer_key")
        earlier = F.col("o_first_id") < F.col("first_id")
        same_sku = F.coalesce((F.col("sku") == F.col("o_sku")) & earlier, F.lit(False))
        # an offer linked to another by its text says less than that one, so texts aren't linked through it
        agrees = _compatible(F.col("offer_key"), F.col("o_offer_key")) & ~F.col("o_linked") & earlier
        judged = pairs.select(*_OFFER_KEY, "o_offer_key", "o_first_id", equal.alias("equal"), same_sku.alias("same_sku"), agrees.alias("agrees"))
        return judged.where("equal or same_sku or agrees")


def repeats(listings: DataFrame, ref_values: DataFrame, history_batch: int = 0) -> DataFrame:
    """first_listing_id, listing_id of every listing of a new batch that repeats an offer.

    Takes the batches in order; the history enters the store once, each further
    batch is compared with the store alone.
    """
    spark = listings.sparkSession
    store = OfferStore(spark, brand_words(ref_values))
    numbered = listings.withColumn("batch_no", F.coalesce("batch_no", F.lit(history_batch)))
    numbers = sorted(r[0] for r in numbered.select("batch_no").distinct().collect())
    found = None
    for n in numbers:
        part = store.accept(numbered.where(F.col("batch_no") == n).where("listing_id is not null"))
        if n > history_batch:
            found = part if found is None else found.unionByName(part)
    store.close()
    if found is None:
        return spark.createDataFrame([], "first_listing_id long, listing_id long")
    return found


#: A reference list longer than this is not taken to the driver.
MOST_BRANDS = 100_000


def brand_words(ref_values: DataFrame) -> list[str]:
    """The folded brand names of the reference list, at most ``MOST_BRANDS``."""
    rows = ref_values.where("kind = 'brand' and value is not null").select("value").distinct().limit(MOST_BRANDS + 1).collect()
    if len(rows) > MOST_BRANDS:
        raise ValueError("the brand list is too long for a broadcast automaton")
    return sorted({fold(r[0]) for r in rows} - {""})
