"""Personal information in free text, found by anchors and replaced by typed placeholders.

Three Aho-Corasick passes find the anchors.  Over the characters: at-signs and
their spellings, and the schemes that begin a telephone number (plus sign, zero).
Over the shape of the text, digits and letters replaced by their kind: the
groupings in which identity numbers alone are written.  Over its words, misspelt
ones corrected: labels of telephones, identity documents and persons, kinds of
streets and estates.  From an anchor a deterministic parser of its kind expands
to both sides, validates the boundaries and the number of digits, and gives the
exact span.  Numbers whose nearest label names an order, a parcel, a serial or a
bar code are no personal data.

Defined results: null gives no findings and a null text; of overlapping
findings the earlier, then the longer one counts; a text without findings comes
out unchanged.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm.words import fold, osa

KINDS = ("email", "phone", "id_number", "address", "name")
#: Every task holds a gazetteer of up to so many places; of a longer one each document gets the places it may name, by a join.
MOST_PLACES = 200_000
#: Words of the longest place names that are told apart.
PLACE_WORDS = 6

# Cue phrases by what follows them, folded.
NAME_CUES = (
    "demandez m", "demandez mme", "demandez", "vendue par", "vendu par", "sold by", "mme", "mlle", "mr", "mrs", "ms", "monsieur", "madame", "signe", "signed",
    "regards", "cordialement", "expediteur", "destinataire", "sender", "sent by", "shipped by", "contact", "appelez", "call mr", "ask for", "remise a", "remis a",
    "البائع", "بالسيد", "السيد", "السيدة", "الأستاذ", "الاستاذ",
)
ID_CUES = (
    "nin", "piece", "piece n", "passeport", "passport", "passport number", "national id", "identite", "carte d identite", "identity", "id card", "id number", "porte le numero", "cni",
    "رقم بطاقة التعريف", "بطاقة التعريف", "جواز السفر", "رقم التعريف",
)
OTHER_NUMBER_CUES = (
    "commande", "order", "colis", "tracking", "serial", "s n", "code barres", "barcode", "suivi", "facture", "invoice", "ref", "reference", "article", "part no", "firmware", "version",
    "modele", "model", "رقم الطلب", "الطلب", "الموديل", "المرجع", "parcel", "shipment", "sn", "ean", "board", "carte mere", "barrettes", "sticks",
)
PHONE_CUES = ("joignable au", "tel", "sms", "call", "cell", "my cell is", "appelez", "telephone", "phone", "mobile", "whatsapp", "الهاتف", "على")
STREET_BEFORE = ("rue", "avenue", "av", "ave", "bd", "bld", "boulevard", "chemin", "impasse", "route", "allee", "place", "quai", "sentier", "passage", "شارع", "نهج", "حي", "طريق")
STREET_AFTER = ("close", "road", "rd", "street", "st", "lane", "avenue", "drive", "way", "court", "square", "crescent", "terrace")
ESTATES = ("cite", "lot", "lotissement", "residence", "quartier", "hai")

_LETTER = r"[^\W\d_]"
_TOKEN = rf"{_LETTER}+(?:['’-]{_LETTER}+)*"
_NAME = re.compile(rf"(?:{_LETTER}\.-?(?:{_LETTER}\.)?|{_TOKEN})\s+(?:{_LETTER}\.\s+)?(?:(?:بن|بو|آيت|ben|ait|el|al)\s+)?{_TOKEN}")
_WORDS = re.compile(r"[^\W_]+")
_LOCAL = r"[A-Za-z0-9](?:[A-Za-z0-9._+%-]*[A-Za-z0-9])?"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_EMAIL = re.compile(
    rf"(?<![A-Za-z0-9._+%-])(?:"
    rf"{_LOCAL}@{_LABEL}(?:\.{_LABEL})+"
    rf"|{_LOCAL}\s?(?:\(at\)|\[at\]|\{{at\}}|<at>|\(a\)|\[a\]|\(arobase\)|\[arobase\]|\(@\)|\[@\])\s?{_LABEL}(?:(?:\s?(?:\(dot\)|\[dot\]|\{{dot\}}|\(point\)|\[point\]|\(\.\)|\[\.\])\s?|\.|\s(?:dot|point)\s){_LABEL})+"
    rf"|{_LOCAL}\sarobase\s{_LABEL}(?:(?:\spoint\s|\sdot\s|\.){_LABEL})+"
    rf"|{_LOCAL}\sat\s{_LABEL}(?:\sdot\s{_LABEL})+"
    rf"|{_LOCAL}\s@\s{_LABEL}(?:\s?\.\s?{_LABEL})+"
    rf")", re.I)
_PHONE = re.compile(
    r"(?<![\w.,#/+-])(?<!\d[ ])(?:"
    r"(?:\+|00\s?)\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{1,4}){2,6}"
    r"|00213\d{9}"
    r"|\(0\d{2,3}\)[ .-]?(?:\d{6}|\d{3}[ .-]\d{3}|\d{2}(?:[ .-]\d{2}){2})"
    r"|0\d(?:([ .-]?)\d{2}(?:\1\d{2}){3})"
    r"|0\d{3}(?:([ .-])\d{2}(?:\2\d{2}){2})"
    r"|0\d{3}([ .-])\d{3}\3\d{3}"
    r"|0\d{2}(?:([ .-])\d{2}(?:\4\d{2}){2})"
    r"|0\d{2}([ .-])\d{3}\5\d{3}"
    r")(?![\w/])(?![.,-]\d)(?! \d)")
_ID = re.compile(
    r"(?<![\w#/+.,-])(?:"
    r"\d{18}|\d{3}(?: \d{3}){5}|\d{9} \d{9}|\d{2}(?:-\d{4}){4}|[A-Z]\d{2}/\d{6}|[A-Z]{1,2}\d{7,9}|\d{9}|\d{3} \d{3} \d{3}|\d{10}"
    r")(?![\w/])(?![.,-]\d)(?! \d{3})", re.I)
#: Forms of identity numbers that nothing else is written in.
_SURE_ID = re.compile(r"\d{3}(?: \d{3}){5}|\d{9} \d{9}|\d{2}(?:-\d{4}){4}|[A-Z]\d{2}/\d{6}", re.I)
_LABEL_REACH = 48
# Spellings of the at-sign, characters that a telephone number may follow, and shapes of identity numbers.
AT_SIGNS = ("@", "arobase", "(at)", "[at]", "{at}", "<at>", "(a)", "[a]", " at ")
BEFORE_ZERO = " ()[]{}<>@"
ID_SHAPES = ("000 000 000 000 000 000", "000000000 000000000", "00-0000-0000-0000-0000", "a00/000000")
_BETWEEN = re.compile(r"[^\w.,#/+@()\[\]{}<>-]")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._+%-")
_NUMBER = r"(?<![\w/.,-])\d{1,4}(?:\s?(?:bis|ter|quater|[a-d](?!\w)))?"
#: What stands before the kind of street, and what may stand between it or an estate and the separator before the town.
_HOUSE = re.compile(rf"(?:(?:apt|appt|appartement|bt|bat|batiment)\.?\s?\d{{1,3}}\s?,\s?)?{_NUMBER}\s?,?\s$")
_HOUSE_AND_NAME = re.compile(rf"(?:(?:flat|apartment|apt|unit)\.?\s\d{{1,4}}\s?,\s)?{_NUMBER}\s(?:[\w'’-]+\s){{1,4}}$")
_STREET_NAME = re.compile(r"\.?\s[^,،\n<>;:!?()]{2,45}?(?=\s*[,،]|\s+-)")
_BLOCKS = re.compile(r"\s[^\n<>;:!?()]{2,24}?(?:\s?,\s?(?:bt|bat|batiment|bloc|n|no|esc|porte|appt|apt)\.?\s?°?\s?\w{1,5}){1,4}")
_LOT = re.compile(r"\.?\s[^,،\n<>;:!?()]{2,40}?\sn\s?[°o]\s?\d{1,4}")
_SEPARATOR = re.compile(r"\s*(?:[,،]|\s-)\s*(?:\d{5}\s+)?")
_TWO_WORDS = re.compile(rf"{_LETTER}[\w'’-]+\s{_LETTER}[\w'’-]+")
_PLACE_GAP = re.compile(r"[\s'-]+")


def folded_same_length(text: str) -> str:
    """Lower-case and accent-free, one character for each."""
    if text.isascii():
        return text.lower()
    out = []
    for c in text:
        d = unicodedata.normalize("NFD", c)[0].lower()
        out.append(d if len(d) == 1 else c)
    return "".join(out)


class Finding(NamedTuple):
    begin: int
    end: int
    kind: str


class PersonalFinder:
    """The anchor automata and a parser for each kind; ``places`` is the gazetteer of towns."""

    def __init__(self, places: Iterable[str] = ()):
        self.places = frozenset(map(place_key, places)) - {""}
        self.marks, self.shapes = ahocorasick.Automaton(), ahocorasick.Automaton()
        for mark in AT_SIGNS:
            self.marks.add_word(mark, ("email", len(mark)))
        self.marks.add_word("+", ("phone", 1))
        for c in BEFORE_ZERO:
            self.marks.add_word(f"{c}0", ("phone", 1))
        for shape in ID_SHAPES:
            self.shapes.add_word(shape, len(shape))
        self.marks.make_automaton()
        self.shapes.make_automaton()
        self.cues = ahocorasick.Automaton()
        kinds: dict[str, list[str]] = {}
        for kind, cues in (("name", NAME_CUES), ("id", ID_CUES), ("other", OTHER_NUMBER_CUES), ("phone", PHONE_CUES),
                           ("street", STREET_BEFORE), ("estate", ESTATES), ("street_after", STREET_AFTER)):
            for cue in cues:
                kinds.setdefault(" " + " ".join(_WORDS.findall(folded_same_length(cue))) + " ", []).append(kind)
        for cue, names in kinds.items():
            self.cues.add_word(cue, (len(cue), tuple(names)))
        self.cues.make_automaton()
        self.known = {w for cue in kinds for w in cue.split() if len(w) >= 5}
        self.by_size: dict[int, list[str]] = {}
        for w in self.known:
            self.by_size.setdefault(len(w), []).append(w)
        self.near: dict[str, str] = {}

    def _correct(self, word: str) -> str:
        """A misspelt cue word, corrected."""
        if len(word) < 5 or word in self.known:
            return word
        done = self.near.get(word)
        if done is None:
            hits = [k for n in (len(word) - 1, len(word), len(word) + 1) for k in self.by_size.get(n, ()) if k[0] == word[0] and osa(word, k, 1) <= 1]
            done = hits[0] if hits else word
            if len(self.near) > 200_000:
                self.near.clear()
            self.near[word] = done
        return done

    def anchors(self, folded: str) -> dict[str, list[tuple[int, int]]]:
        """Begin and end of each cue in the text, by kind."""
        spans = [(m.start(), m.end(), self._correct(m[0])) for m in _WORDS.finditer(folded)]
        stream, starts = [" "], {}
        at = 1
        for i, (_, _, w) in enumerate(spans):
            starts[at] = i
            stream += (w, " ")
            at += len(w) + 1
        ends = {start + len(spans[i][2]): i for start, i in starts.items()}
        found: dict[str, list[tuple[int, int]]] = {}
        for last, (size, kinds) in self.cues.iter("".join(stream)):
            first, final = starts[last - size + 2], ends[last]
            for kind in kinds:
                found.setdefault(kind, []).append((spans[first][0], spans[final][1]))
        return found

    def find(self, text: str | None, places: frozenset[str] | None = None) -> list[Finding]:
        """The personal data of a text, in order and without overlaps; ``places`` stands for the own gazetteer where given."""
        if not text:
            return []
        folded = folded_same_length(text)
        anchors = self.anchors(folded)
        for last, (kind, size) in self.marks.iter(" " + _BETWEEN.sub(" ", folded) + " "):
            # begins lie one further right in the padded text; a blank or bracket before the zero is no part of the number
            anchors.setdefault(f"{kind} mark", []).append((last - size, last))
        got = self._emails(text, anchors)
        got += self._addresses(folded, anchors, self.places if places is None else places)
        got += self._numbers(text, folded, anchors, got)
        got += self._names(text, folded, anchors)
        out: list[Finding] = []
        for f in sorted(got, key=lambda f: (f.begin, -f.end)):
            if not out or f.begin >= out[-1].end:
                out.append(f)
        return out

    def _emails(self, text: str, anchors: dict) -> list[Finding]:
        """From each at-sign left to the begin of the local part, and from there right."""
        out = []
        for begin, _ in anchors.get("email mark", ()):
            at = max(begin, 0)
            while at and (text[at - 1] in "([" or text[at - 1].isspace()) and at > begin - 2:
                at -= 1
            while at and text[at - 1] in _LOCAL_CHARS:
                at -= 1
            m = _EMAIL.match(text, at)
            if m and m.end() > begin and re.search(r"[A-Za-z]{2,}$", m[0]):
                out.append(Finding(m.start(), m.end(), "email"))
        return out

    def _place_end(self, folded: str, at: int, places: frozenset[str]) -> int:
        """The end of the longest place name that begins at a position, or -1."""
        words, end, far = [], -1, at
        for m in _WORDS.finditer(folded, at):
            if len(words) == PLACE_WORDS or (m.start() != at if not words else not _PLACE_GAP.fullmatch(folded, far, m.start())):
                break
            words.append(m[0])
            far = m.end()
            if " ".join(words) in places:
                end = far
        return end

    def _town_end(self, folded: str, at: int, places: frozenset[str]) -> int:
        """The end of the town behind the separator at a position: a known place, else two words; -1 where there is none."""
        m = _SEPARATOR.match(folded, at)
        if not m:
            return -1
        end = self._place_end(folded, m.end(), places)
        if end >= 0:
            return end
        two = _TWO_WORDS.match(folded, m.end())
        if not two:
            return -1
        for w in _WORDS.finditer(folded, m.end(), min(len(folded), two.end() + 12)):
            end = self._place_end(folded, w.start(), places)
            if end >= 0:
                return end
        return two.end()

    def _addresses(self, folded: str, anchors: dict, places: frozenset[str]) -> list[Finding]:
        """From a kind of street or estate left to the house number, and right over the name to the town."""
        out = []

        def take(begin: int, at: int) -> bool:
            end = self._town_end(folded, at, places)
            if end >= 0:
                out.append(Finding(begin, end, "address"))
            return end >= 0

        for b, e in anchors.get("street", ()):
            house = _HOUSE.search(folded, max(0, b - 60), b)
            name = _STREET_NAME.match(folded, e) if house else None
            while name:  # a dash may belong to the name of the street
                if take(house.start(), name.end()):
                    break
                more = re.compile(r"[^,،\n<>;:!?()]{1,45}?(?=\s*[,،]|\s+-)").match(folded, name.end() + 2)
                name = more if more and more.end() - e <= 48 else None
        for b, e in anchors.get("street_after", ()):
            front = _HOUSE_AND_NAME.search(folded, max(0, b - 160), b)
            if front:
                take(front.start(), e + (folded[e:e + 1] == "."))
        for b, e in anchors.get("estate", ()):
            if folded[b:e] == "cite" and (m := _BLOCKS.match(folded, e)):
                take(b, m.end())
            if m := _LOT.match(folded, e):
                take(b, m.end())
        return out

    def _numbers(self, text: str, folded: str, anchors: dict, taken: list[Finding]) -> list[Finding]:
        """Identity numbers from their labels and shapes, telephones from plus signs and zeros."""
        labels = sorted((e, kind) for kind in ("id", "other", "phone") for _, e in anchors.get(kind, ()))
        ends = [e for e, _ in labels]
        covered = bytearray(len(text))

        def cover(begin: int, end: int) -> None:
            covered[begin:end] = b"\1" * (end - begin)

        for f in taken:
            cover(f.begin, f.end)

        def label(at: int) -> str | None:
            """The kind of the last label before a number in the same sentence, with no other number between."""
            k = bisect_right(ends, at) - 1
            if k < 0 or at - ends[k] > _LABEL_REACH or re.search(r"[.!?]\s|\n|\d", text[ends[k]:at]):
                return None
            return labels[k][1]

        begins = set()
        for _, e in anchors.get("id", ()):  # the first number behind the label, with the letters that begin it
            at = re.compile(r"[^\d\n]*").match(text, e, e + _LABEL_REACH + 3).end()
            while at > e and text[at - 1].isalpha():
                at -= 1
            begins.add(at)
        if any(c.isdigit() for c in text):
            shape = re.sub("[a-z]", "a", re.sub(r"\d", "0", folded))
            begins |= {last - size + 1 for last, size in self.shapes.iter(shape)}
        out = []
        for at in sorted(begins):
            m = _ID.match(text, at)
            if not m or covered.find(1, m.start(), m.end()) >= 0:
                continue
            kind = label(at)
            if kind == "id" or (_SURE_ID.fullmatch(m[0]) and kind not in ("other", "phone")):
                out.append(Finding(m.start(), m.end(), "id_number"))
                cover(m.start(), m.end())
        done = 0
        for at in sorted({x for b, _ in anchors.get("phone mark", ()) for x in (b, b - 1) if x >= 0 and (x == b or text[x] == "(")}):
            m = _PHONE.match(text, at) if at >= done else None
            if not m:
                continue
            done = m.end()
            digits = sum(c.isdigit() for c in m[0])
            if not 9 <= digits <= 15 or label(m.start()) in ("other", "id") or re.match(r"00(?!\s?[1-9])", m[0]):
                continue
            if covered.find(1, m.start(), m.end()) < 0:
                out.append(Finding(m.start(), m.end(), "phone"))
        return out

    def _names(self, text: str, folded: str, anchors: dict) -> list[Finding]:
        out = []
        for begin, end in anchors.get("name", ()):
            gap = re.compile(r"\s*[.:,]?\s*").match(text, end)
            cue = folded[begin:end]
            if cue in _TITLES and text[begin].islower():
                continue  # a misspelt "meme", not a courtesy title
            start = gap.end()
            if cue == "demandez" and re.compile(r"(?:m|mr|mme|mlle)\.?\s", re.I).match(text, start):
                continue  # the longer cue with the courtesy title reads it
            m = _NAME.match(text, start)
            if not m:
                continue
            if not self._plausible(cue, text[gap.start():gap.end()], m[0], text[m.end():m.end() + 24]):
                continue
            out.append(Finding(m.start(), m.end(), "name"))
        return out

    def _plausible(self, cue: str, gap: str, name: str, after: str) -> bool:
        words = re.split(r"\s+", name)
        if any(folded_same_length(w) in _NO_NAME for w in words if not w.endswith(".")):
            return False
        if cue == "contact":
            return after.lstrip()[:1] in ("<", "(", ":", ",") or all(w[:1].isupper() for w in words)
        if cue in ("signe", "signed", "expediteur", "destinataire", "sender"):
            return ":" in gap
        if cue in ("regards", "cordialement"):
            return "," in gap or "\n" in gap
        if cue in ("demandez", "appelez", "ask for"):
            return all(w[:1].isupper() or not w[:1].islower() for w in words) or re.match(r"\s(?:au|a|at|on)\s", after) is not None
        return True


# Courtesy titles, always written with a capital.
_TITLES = frozenset(("mme", "mlle", "mr", "mrs", "ms", "monsieur", "madame"))
# Frequent words that are part of no name.
_NO_NAME = frozenset(
    "le la les un une des du de au aux et ou pour par sur dans avec sans plus tres the a an and or of to for with from by at on in is was it this that "
    "comme neuve neuf store informatique micro pc hardware gaming composants tech shop boutique service support client votre notre nous vous me mon ma mes "
    "my your our his her their carte passeport piece commande order colis tracking ce cet cette ces tarif".split()
)


def placeholders(text: str | None, findings: list[Finding]) -> str | None:
    """The text with each finding replaced by its kind in square brackets."""
    if text is None:
        return None
    out, at = [], 0
    for f in findings:
        out += (text[at:f.begin], f"[{f.kind.upper()}]")
        at = f.end
    return "".join([*out, text[at:]])


def place_key(name: str) -> str:
    """A place name as its folded words."""
    return " ".join(_WORDS.findall(folded_same_length(fold(name))))


def place_names(tables: list[tuple[DataFrame, str]]) -> DataFrame:
    """place: the keys of all places that the given columns name."""
    named = None
    for df, column in tables:
        one = df.select(F.col(column).cast("string").alias("place")).where("place is not null").distinct()
        named = one if named is None else named.unionByName(one)
    keys = F.pandas_udf(lambda names: names.map(place_key), "string")
    return named.distinct().select(keys("place").alias("place")).where("place <> ''").distinct()


def _may_name(text: str | None) -> list[str]:
    """Keys of all word sequences that stand near behind a kind of street or estate."""
    if not text:
        return []
    folded = folded_same_length(text)
    words = list(_WORDS.finditer(folded))
    streets = [m.end() for m in words if m[0] in _STREETS or len(m[0]) >= 5]
    near = [i for i, m in enumerate(words) if (k := bisect_right(streets, m.start())) and m.start() - streets[k - 1] <= 120]
    return sorted({" ".join(w[0] for w in words[i:i + n]) for i in near for n in range(1, PLACE_WORDS + 1)})


_STREETS = frozenset(folded_same_length(s) for s in STREET_BEFORE + STREET_AFTER + ESTATES)


def _with_places(documents: DataFrame, places: DataFrame, most_places: int) -> tuple[DataFrame, list[str] | None]:
    """``documents`` (doc_id, text) with the places that each may name, or the whole gazetteer where a task can hold it."""
    rows = places.limit(most_places + 1).collect()
    if len(rows) <= most_places:
        return documents.withColumn("places", F.lit(None).cast("array<string>")), [r[0] for r in rows]
    grams = F.pandas_udf(lambda texts: texts.map(_may_name), "array<string>")
    met = documents.select("doc_id", F.explode(grams("text")).alias("place")).distinct().join(places, "place")
    return documents.join(met.groupBy("doc_id").agg(F.collect_set("place").alias("places")), "doc_id", "left").withColumn("places", F.coalesce("places", F.array().cast("array<string>"))), None


def _own(places: object) -> frozenset[str] | None:
    return None if places is None else frozenset(places)


def found(documents: DataFrame, places: DataFrame, id_column: str = "doc_id", text_column: str = "text", most_places: int = MOST_PLACES) -> DataFrame:
    """doc_id, pii_type, pii_text of every finding; a scan, then a shuffle of the findings alone."""
    chosen = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).where("doc_id is not null")
    chosen, gazetteer = _with_places(chosen, places, most_places)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = PersonalFinder(gazetteer or ())
        for frame in frames:
            rows = []
            for d, t, own in zip(frame["doc_id"], frame["text"], frame["places"]):
                if isinstance(t, str):
                    rows += sorted({(d, f.kind, t[f.begin:f.end]) for f in finder.find(t, _own(own))})
            yield pd.DataFrame(rows, columns=["doc_id", "pii_type", "pii_text"])

    return chosen.mapInPandas(scan, "doc_id long, pii_type string, pii_text string").distinct()


def redacted(documents: DataFrame, places: DataFrame, id_column: str = "doc_id", text_column: str = "text", most_places: int = MOST_PLACES) -> DataFrame:
    """Every row's id with its text in which typed placeholders stand for the findings."""
    chosen, gazetteer = _with_places(documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")), places, most_places)

    def replace(texts: pd.Series, own: pd.Series) -> pd.Series:
        finder = PersonalFinder(gazetteer or ())
        return pd.Series([placeholders(t, finder.find(t, _own(o))) if isinstance(t, str) else None for t, o in zip(texts, own)], dtype=object)

    return chosen.select(F.col("doc_id").alias(id_column), F.pandas_udf(replace, "string")("text", "places").alias("text"))
