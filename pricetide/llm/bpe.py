"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

The merges are compiled, in their order, into a deterministic tokenization
automaton over tokens.  It begins with one state that has every byte as a loop;
each merge (u, v) -> w adds a gadget: a new state that the arcs u lead to from
now on, a copy of the old one without the arc v, while arcs w lead to where v
led.  A state thus is a pointer to the one it was copied from and the arc it
lacks, so 50,000 gadgets are as many small entries and no arc is written twice.

A word of the public pre-splitting pattern is read byte by byte through a table
of transitions: its rows are sets of (state, prefix of the next arc's label),
made by subset construction when first met and kept.  Of every prefix of a word
exactly one token can be the last, and the table names it; the run is read off
backwards.  Decoding emits the bytes of the arc labels.

Defined results: null and empty texts give an empty list; strings of special
tokens are ordinary text; every row of the input has a row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"
#: Words whose encoding a task keeps.
MOST_WORDS = 200_000
#: Transitions of the byte table that a task keeps; beyond them it is begun anew.
MOST_ROWS = 1_000_000

# Fixed value: the pre-splitting pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in printable}
    spare = (b for b in range(256) if b not in set(printable))
    letters.update((chr(256 + i), b) for i, b in enumerate(spare))
    return letters


class Vocabulary:
    """Token ids, their bytes and the two parts each was merged from."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        letters = _byte_letters()
        as_bytes = lambda t: bytes(letters[c] for c in t)
        self.ids = {as_bytes(t): i for t, i in model["vocab"].items()}
        self.bytes = {i: b for b, i in self.ids.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            u, v = pair if isinstance(pair, (list, tuple)) else pair.split(" ")
            a, b = self.ids[as_bytes(u)], self.ids[as_bytes(v)]
            w = self.ids[self.bytes[a] + self.bytes[b]]
            self.merged.setdefault((a, b), (rank, w))
            self.parts.setdefault(w, (a, b))
        self.rank = {w: self.merged[p][0] for w, p in self.parts.items()}


class Automaton:
    """The tokenization automaton of a vocabulary.

    ``owner``, ``born`` and ``base`` are the compiled gadgets: state ``s`` is
    reached by token ``owner[s]``, lacks the arcs that ``cut[owner[s]]`` names
    up to rank ``born[s]``, and otherwise those of ``base[owner[s]]``, the state
    which the right part of the token had when the token was made.
    """

    def __init__(self, vocabulary: Vocabulary, most_rows: int = MOST_ROWS):
        self.v, self.most_rows = vocabulary, most_rows
        self.state_of: dict[int, int] = {}
        self.owner, self.born, self.base = [-1], [-1], {}
        self.cut: dict[int, dict[int, int]] = {}
        for (u, v), (rank, w) in vocabulary.merged.items():
            self._gadget(rank, u, v, w)
        self._spell()
        self.arcs: dict[tuple[int, int], bool] = {}
        self._clear()

    def _gadget(self, rank: int, u: int, v: int, w: int) -> None:
        """Merge (u, v) -> w: the arcs u lead to a new state without the arc v, and w goes where v went."""
        before = self.state_of.get(u, 0)
        self.owner.append(u)
        self.born.append(rank)
        self.base.setdefault(u, before)
        self.cut.setdefault(u, {})[v] = rank
        self.state_of[u] = len(self.owner) - 1
        # "uu" goes where u went before the gadget: three in a row are merged from the left
        made = before if u == v else self.state_of.get(v, 0)
        if w not in self.state_of:
            self.state_of[w] = self.base[w] = made

    def _spell(self) -> None:
        """The arcs spelled out in bytes: a table of prefixes, and the token that a prefix is."""
        self.goto: dict[int, int] = {}
        self.token = [-1]
        for token, label in self.v.bytes.items():
            node = 0
            for byte in label:
                key = node << 8 | byte
                node = self.goto.get(key, -1)
                if node < 0:
                    node = self.goto[key] = len(self.token)
                    self.token.append(-1)
            self.token[node] = token

    def _clear(self) -> None:
        self.rows: dict[tuple, int] = {((0, 0),): 0}
        self.places: list[tuple] = [((0, 0),)]
        self.delta: dict[int, tuple[int, int]] = {}

    def _cut_at(self, state: int, label: int) -> int:
        """The rank of the gadget that took the arc ``label`` from ``state``, or -1."""
        while state:
            u = self.owner[state]
            rank = self.cut[u].get(label, -1)
            if 0 <= rank <= self.born[state]:
                return rank
            state = self.base[u]
        return -1

    def arc(self, state: int, label: int) -> bool:
        """Whether ``state`` has the arc ``label``: it had those of the label's left parts when they were merged, and kept it."""
        key = (state, label)
        kept = self.arcs.get(key)
        if kept is None:
            if len(self.arcs) > 2_000_000:
                self.arcs.clear()
            kept, part, until = True, label, len(self.v.merged)
            while kept and part is not None:
                kept = not 0 <= self._cut_at(state, part) <= until
                until = self.v.rank.get(part, -1)
                part = self.v.parts[part][0] if part in self.v.parts else None
            self.arcs[key] = kept
        return kept

    def step(self, row: int, byte: int) -> tuple[int, int]:
        """The row after a byte and the token that ends there, -1 for none.

        A row of the byte table is the set of places that a word so far may be
        at: (state before the open token, prefix of that token).
        """
        after, ended = [], -1
        for state, node in self.places[row]:
            node = self.goto.get(node << 8 | byte, -1)
            if node < 0:
                continue
            token = self.token[node]
            if token >= 0 and self.arc(state, token):
                ended = token
            after.append((state, node))
        if ended >= 0:
            after.append((self.state_of.get(ended, 0), 0))
        key = tuple(after)
        found = self.rows.get(key)
        if found is None:
            found = self.rows[key] = len(self.places)
            self.places.append(key)
        self.delta[row << 8 | byte] = found, ended
        return found, ended

    def word(self, word: bytes) -> list[int]:
        """The labels on the one run of the automaton that reads ``word``."""
        if len(self.delta) > self.most_rows:
            self._clear()
        row, last, known = 0, [], self.delta
        for byte in word:
            row, ended = known.get(row << 8 | byte) or self.step(row, byte)
            last.append(ended)
        out, end, label = [], len(word), self.v.bytes
        while end:
            token = last[end - 1]
            out.append(token)
            end -= len(label[token])
        return out[::-1]


class Encoder:
    """Texts to ids and back."""

    def __init__(self, vocabulary: Vocabulary):
        self.automaton = Automaton(vocabulary)
        self.split = regex.compile(PATTERN).findall
        self.words: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        words, out = self.words, []
        for w in self.split(text):
            ids = words.get(w)
            if ids is None:
                ids = self.automaton.word(w.encode("utf-8", "surrogatepass"))
                if len(words) >= MOST_WORDS:
                    words.clear()
                words[w] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.automaton.v.bytes[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The compiled encoder of a vocabulary file, once per process."""
    return Encoder(Vocabulary(path))


def encoded(documents: DataFrame, path: str = f"{TOKENIZER_DIR}/{VOCABULARY}", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column`` and ids of each row; a scan without a shuffle."""

    def ids(texts: pd.Series) -> pd.Series:
        e = encoder(path)
        return pd.Series([np.asarray(e.encode(t if isinstance(t, str) else None), dtype=np.int32) for t in texts], dtype=object)

    return documents.select(F.col(id_column), F.pandas_udf(ids, "array<int>")(F.col(text_column)).alias("ids"))


def decoded(encoded_: DataFrame, path: str = f"{TOKENIZER_DIR}/{VOCABULARY}", id_column: str = "doc_id") -> DataFrame:
    """The text of each row's ids; an empty list gives the empty string."""

    def text(ids: pd.Series) -> pd.Series:
        e = encoder(path)
        return pd.Series([None if i is None else e.decode(list(map(int, i))) for i in ids])

    return encoded_.select(F.col(id_column), F.pandas_udf(text, "string")(F.col("ids")).alias("text"))
