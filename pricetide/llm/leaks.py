"""Evaluation texts that leaked into a corpus.

Items and documents are reduced to the same stream of lower-case letters and
digits, without mark-up, accents, punctuation or blanks.  The patterns begin at
each word of each item and are ``LENGTH`` letters long, or as long as the run of
words that every accepted stretch with single words replaced holds unbroken,
where that is shorter.  Wu-Manber
search slides over a document: a table by block of ``BLOCK`` letters tells how
far the search may jump, the patterns that end in a block with jump zero stand
in its bucket, and direct comparison confirms one.  The words of every item
with a confirmed pattern are aligned with the document's, and the
longest continuous stretch decides: it may be broken only by single words, and
must hold at least a third of the item's words.

The item set is small beside the corpus and its pattern table is held by every
task; a larger set is searched in shards of ``MOST_ITEMS`` items, one pass each, of
which the driver and the tasks hold one at a time.
Documents are never shuffled.

Defined results: null, empty and blank documents or items leak nothing; an item
shorter than a pattern is searched as a whole, at word boundaries; one of which a third is shorter must
share a whole pattern of ``LENGTH`` letters; repeated rows count once.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm.words import IGNORABLE
from pricetide.session import checkpointed

LENGTH = 20
BLOCK = 5
#: The share of an item's words that makes a leak.
LEAST_SHARE = 1 / 3
#: Words that may differ in a row (similar sentences with other content differ in runs), and the share of a stretch that must agree.
MOST_GAP, LEAST_AGREEING = 1, 0.85
MOST_ITEMS = 20_000

_TAG = re.compile(r"<[a-zA-Z/!][^<>]{0,200}>")
_MARKS = re.compile("[̀-ͯ]")
_WORD = re.compile(r"[^\W_]+")


def unmarked(text: str) -> str:
    """A text with its character references resolved and without mark-up."""
    return _TAG.sub(" ", html.unescape(text) if "&" in text else text)


def words_of(text: str) -> list[str]:
    """The words of a text without mark-up, case, accents and punctuation."""
    text = IGNORABLE.sub("", unmarked(text))
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text)).replace("œ", "oe").replace("Œ", "oe").replace("’", "'")
    return _WORD.findall(text.lower())


class WuManber:
    """Multi-pattern search for patterns of at least one length, by their first letters."""

    def __init__(self, patterns: dict[str, list[tuple[int, int]]], length: int = LENGTH, block: int = BLOCK):
        self.length, self.block, self.patterns = length, block, patterns
        self.far = length - block + 1
        self.shift: dict[str, int] = {}
        self.bucket: dict[str, dict[str, list[str]]] = {}
        for whole in patterns:
            p = whole[:length]
            for end in range(block, length + 1):
                b = p[end - block:end]
                jump = length - end
                if jump < self.shift.get(b, self.far):
                    self.shift[b] = jump
            self.bucket.setdefault(p[-block:], {}).setdefault(p, []).append(whole)

    def find(self, text: str) -> Iterator[tuple[int, str]]:
        """Begin and pattern of each occurrence."""
        length, block, far, shift, bucket = self.length, self.block, self.far, self.shift.get, self.bucket
        end, n = length, len(text)
        while end <= n:
            tail = text[end - block:end]
            jump = shift(tail, far)
            if jump:
                end += jump
                continue
            begin = end - length
            for candidate in bucket[tail].get(text[begin:end], ()):
                if text.startswith(candidate, begin):
                    yield begin, candidate
            end += 1


class Item:
    """An evaluation text: its words, and for each the token of the original it belongs to."""

    def __init__(self, item_id: int, text: str):
        self.item_id = item_id
        self.words: list[str] = []
        self.token: list[int] = []
        tokens = unmarked(text).split()
        for i, t in enumerate(tokens):
            for w in words_of(t):
                self.words.append(w)
                self.token.append(i)
        self.n_tokens = len(tokens)
        self.least = max(1, -(-self.n_tokens * LEAST_SHARE // 1))
        self.run = self._run()

    def _run(self) -> int:
        """Words in a row that a stretch long enough to be a leak must hold unbroken when only single words are replaced."""
        fewest, end = len(self.words), 0
        for begin in range(len(self.words)):
            while end < len(self.words) and self.token[end] - self.token[begin] + 1 < self.least:
                end += 1
            if end == len(self.words):
                break
            fewest = min(fewest, end - begin + 1)
        # of m words that agree but for k, the longest of the k + 1 runs between them is at least the mean
        agreed = ((m, math.ceil(LEAST_AGREEING * m)) for m in range(fewest, len(self.words) + 1))
        return min((-(-a // (m - a + 1)) for m, a in agreed), default=0)

    def may_hold(self, doc: list[str], i: int, j: int) -> bool:
        """Whether a stretch through word ``i`` here and ``j`` there can be long enough, whatever share of it agrees."""
        ends = []
        for way in (1, -1):
            seen, open_ = {(i, j)}, [(i, j)]
            while open_:
                x, y = open_.pop()
                for a in range(x + way, x + way * (MOST_GAP + 2), way):
                    for b in range(y + way, y + way * (MOST_GAP + 3), way):
                        if 0 <= a < len(self.words) and 0 <= b < len(doc) and self.words[a] == doc[b] and (a, b) not in seen:
                            seen.add((a, b))
                            open_.append((a, b))
            ends.append(max(seen)[0] if way == 1 else min(seen)[0])
        return self.token[ends[0]] - self.token[ends[1]] + 1 >= self.least

    def longest_stretch(self, doc: list[str]) -> int:
        """Tokens of the longest stretch of the item that stands in ``doc``, broken by single words at most."""
        blocks = [b for b in SequenceMatcher(None, self.words, doc, autojunk=False).get_matching_blocks() if b.size]
        best = 0
        for first in range(len(blocks)):
            begin, agreed = blocks[first].a, 0
            end_a, end_b = blocks[first].a, blocks[first].b
            for b in blocks[first:]:
                if agreed and (b.a - end_a > MOST_GAP or b.b - end_b > MOST_GAP + 1):
                    break
                agreed += b.size
                end_a, end_b = b.a + b.size, b.b + b.size
                if agreed >= LEAST_AGREEING * (end_a - begin):
                    best = max(best, self.token[end_a - 1] - self.token[begin] + 1)
        return best


class LeakFinder:
    """The pattern tables of a set of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = {i: Item(i, t) for i, t in items}
        patterns: dict[str, list[tuple[int, int]]] = {}
        runs: dict[str, list[tuple[int, int]]] = {}
        short: dict[str, list[tuple[int, int]]] = {}
        for item in self.items.values():
            stream, at = "".join(item.words), 0
            if stream and len(stream) < LENGTH:
                short.setdefault(stream, []).append((item.item_id, 0))
            for i, w in enumerate(item.words):
                run = sum(map(len, item.words[i:i + item.run]))
                if run < LENGTH and i + item.run <= len(item.words) and len(stream) * LEAST_SHARE >= LENGTH:
                    runs.setdefault(stream[at:at + run], []).append((item.item_id, i))
                elif at + LENGTH <= len(stream):
                    patterns.setdefault(stream[at:at + LENGTH], []).append((item.item_id, i))
                at += len(w)
        self.search = WuManber(patterns)
        least = min(map(len, runs), default=LENGTH)
        self.search_runs = WuManber(runs, least, min(BLOCK, least))
        least = min(map(len, short), default=LENGTH)
        self.search_short = WuManber(short, least, min(BLOCK, least))

    def leaks(self, text: str | None) -> list[int]:
        """The items of which at least a third stands in ``text``."""
        if not text or text.isspace():
            return []
        words = words_of(text)
        stream = "".join(words)
        at, starts = 0, []
        for w in words:
            starts.append(at)
            at += len(w)
        hits: dict[int, set[tuple[int, int]]] = {}
        for search in (self.search, self.search_runs):
            for begin, pattern in search.find(stream):
                for item_id, i in search.patterns[pattern]:
                    hits.setdefault(item_id, set()).add((i, begin))
        found = []
        for begin, pattern in self.search_short.find(stream):
            at = bisect_left(starts, begin)
            found += [i for i, _ in self.search_short.patterns[pattern] if words[at:at + len(self.items[i].words)] == self.items[i].words and starts[at] == begin]
        for item_id, hit in hits.items():
            item = self.items[item_id]
            # one pattern is enough where the words around it go on agreeing; many are aligned unasked
            if len({i for i, _ in hit}) < 0.2 * item.least and not any(item.may_hold(words, i, bisect_left(starts, begin)) for i, begin in hit):
                continue
            low, high = min(b for _, b in hit), max(b for _, b in hit) + LENGTH
            room = len(item.words)
            from_, to = bisect_left(starts, low), bisect_left(starts, high)
            region = words[max(0, from_ - room):to + room]
            if item.longest_stretch(region) >= item.least:
                found.append(item_id)
        return sorted(set(found))


def leaked(documents: DataFrame, items: DataFrame, most_items: int = MOST_ITEMS) -> DataFrame:
    """doc_id, item_id of every document that holds an item or a third of it."""
    spark = documents.sparkSession
    known = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    n = known.count()
    result = None
    shards = -(-n // most_items)
    for shard in range(max(1, shards)):
        part = known.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == shard) if shards > 1 else known
        held = spark.sparkContext.broadcast([(r[0], r[1]) for r in part.collect()])

        def find(frames: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            finder = LeakFinder(held.value)
            for frame in frames:
                rows = [(d, i) for d, t in zip(frame["doc_id"], frame["text"]) for i in finder.leaks(t if isinstance(t, str) else None)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id"])

        scanned = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(find, "doc_id long, item_id long")
        if shards > 1:
            scanned = checkpointed(scanned)
            held.destroy()
        result = scanned if result is None else result.unionByName(scanned)
    return result.distinct()
