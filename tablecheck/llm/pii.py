"""Personal data in texts, plain and disguised, with offsets into the source text.

Plain identifiers are found as the patterns below say, leftmost first and without overlap for each kind; a match whose numbers fail
its test (parts of an IP address, Luhn sum, count of digits) is dropped and the search goes on behind it. The scans are written so
that a run of a million letters or digits costs linear time.

Disguised ones are found in a normalised copy of the text. A transducer rewrites look-alike letters, full-width and other decimal
digits, zero-width characters, spelled digits in four languages and spelled "at" and "dot"; it keeps for every stretch of the copy the
stretch of the source it stands for. Identifiers found in the copy that cover at least one rewritten stretch are mapped back; those
that lie within a plain identifier of the same kind are left out. Offsets are code points, the end is exclusive.

Results: null texts are empty texts; the lists are sorted by start, then by kind as listed in KINDS.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructType

from tablecheck.llm.common import map_slices, schema_with, with_column

KINDS = ("email", "ip", "card", "phone")
SPANS = ArrayType(StructType().add("kind", StringType()).add("start", IntegerType()).add("end", IntegerType()).add("disguised", BooleanType()))
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("disguised", pa.bool_())]))

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# The second bracket keeps a match from beginning inside a run of digits.
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")

# Digits spelled in English, German, French and Spanish.
DIGIT_WORDS = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "zwo": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
AT_WORDS = ("at", "arroba", "chez")
DOT_WORDS = ("dot", "punkt", "punto", "point")
PLUS_WORDS = ("plus", "más")
# After "at" these begin a phrase and not a host name.
ARTICLES = ("the", "a", "an", "this", "that", "my", "your", "our", "his", "her", "their")
# Cyrillic and Greek letters that look like Latin ones, and the Latin ones.
LOOKALIKES = dict(
    zip(
        "аеорсухіјѕԁһӏқАВЕКМНОРСТХІЈЅαοιυνκρτΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
        "aeopcyxijsdhlkABEKMHOPCTXIJSaoiuvkptABEZHIKMNOPTYX",
        strict=True,
    )
)
INVISIBLE = "­​‌‍⁠﻿"

_word = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_ODD = re.compile(rf"[{INVISIBLE}Ͱ-ӿԀ-ԯ٠-٩۰-۹०-९　！-～｡。]")
_at, _dot, _plus, _articles = "|".join(AT_WORDS), "|".join(DOT_WORDS), "|".join(PLUS_WORDS), "|".join(ARTICLES)
_STEP = re.compile(
    rf"(?P<at>(?<=\w)\s+＠\s+(?=\w)|\s*[\[({{<]\s*(?:{_at}|@)\s*[\])}}>]\s*|(?<=\w)\s+(?:{_at})\s+(?!(?:{_articles})\b)(?=[\w-]+(?:\s*[\[({{<]\s*(?:{_dot}|\.)\s*[\])}}>]\s*|\s+(?:{_dot})\s+)\w))"
    rf"|(?P<dot>\s*[\[({{<]\s*(?:{_dot}|\.)\s*[\])}}>]\s*|(?<=\w)\s+(?:{_dot})\s+(?=\w))"
    rf"|(?P<plus>\b(?:{_plus})\s+(?=(?:{_word}|[0-9])\b))"
    rf"|(?P<digit>\b(?:{_word})\b(?:[\s,-]+(?=(?:{_word})\b))?)"
    rf"|(?P<odd>{_ODD.pattern})",
    re.I,
)
_digit_word = rf"\b(?:{_word})\b"
# What a rewritten stretch needs beside it to become part of an identifier: brackets hold their sign, a "dot" stands alone, a spelled digit has
# another digit next to it, spelled or not, and a "plus" stands before one.
_BRACKETED = re.compile(rf"[\[({{<]\s*(?:{_at}|{_dot}|[@.])\s*[\])}}>]", re.I)
_APART = re.compile(r"[^\w]+")
_DOT_WORD = re.compile(rf"\b(?:{_dot})\b", re.I)
_SPELLED = re.compile(rf"{_digit_word}[\s,.()+-]+(?:[0-9]|{_digit_word})|[0-9][\s,.()+-]+{_digit_word}", re.I)
_PLUS_WORD = re.compile(rf"\b(?:{_plus})\s+(?:{_digit_word}|[0-9]\b)", re.I)


def plain(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the identifiers that the patterns find."""
    return [("email", *m) for m in _emails(text)] + [("ip", *m) for m in _ips(text)] + [("card", *m) for m in _cards(text)] + [("phone", *m) for m in _phones(text)]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for match in _IP.finditer(text):
        if all(len(part) <= 3 and int(part or 0) <= 255 for part in (p.lstrip("0") for p in match.group().split("."))):
            yield match.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for match in _CARD.finditer(text):
        if match.end() - match.start() >= 12:
            digits = match.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                yield match.span()


def _luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for match in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGITS.sub("", match.group())) <= 15:
                yield match.span()


class Normalised:
    """A rewritten text, and which stretch of the source each rewritten stretch is."""

    def __init__(self, text: str):
        out: list[str] = []
        self.made: list[tuple[int, int]] = []  # rewritten stretches in the copy
        self.source: list[tuple[int, int]] = []  # and in the source
        done = size = 0
        for match in _STEP.finditer(text):
            start, end = match.span()
            new = _rewritten(match)
            if new == text[start:end]:
                continue
            out += (text[done:start], new)
            size += start - done
            self.made.append((size, size + len(new)))
            self.source.append((start, end))
            size += len(new)
            done = end
        out.append(text[done:])
        self.text = "".join(out)
        self._starts = [a for a, _ in self.made]
        self._ends = [b for _, b in self.made]

    def touched(self, start: int, end: int) -> bool:
        """Whether a stretch of the copy covers or encloses something rewritten."""
        k = bisect_right(self._ends, start)
        while k < len(self.made) and self.made[k][0] < end:
            if self.made[k][1] > start:
                return True
            k += 1
        return False

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The stretch of the source that a stretch of the copy stands for."""
        return self._place(start, False), self._place(end, True)

    def _place(self, at: int, is_end: bool) -> int:
        # The last rewritten stretch that begins before the place (or at it, for a start).
        k = (bisect_left(self._starts, at) if is_end else bisect_right(self._starts, at)) - 1
        if k < 0:
            return at
        (_, made_end), (source_start, source_end) = self.made[k], self.source[k]
        if at < made_end:
            return source_end if is_end else source_start
        return source_end + (at - made_end)


def _rewritten(match: re.Match) -> str:
    kind, found = match.lastgroup, match.group()
    if kind == "at":
        return "@"
    if kind == "dot":
        return "."
    if kind == "plus":
        return "+"
    if kind == "digit":
        return str(DIGIT_WORDS[re.split(r"[\s,-]", found, maxsplit=1)[0].lower()])
    if found in INVISIBLE:
        return ""
    if found in LOOKALIKES:
        return LOOKALIKES[found]
    if "！" <= found <= "～":
        return chr(ord(found) - 0xFEE0)
    if found in "｡。":
        return "."
    if found == "　":
        return " "
    return str(unicodedata.decimal(found, found))


def is_suspect(text: str) -> bool:
    """Whether the transducer may rewrite anything that an identifier could cover; texts without it need no copy.

    It leaves out only what cannot matter: a spelled digit with no digit near it, as every identifier with digits has several.
    """
    if not text.isascii() and _ODD.search(text):
        return True
    if _BRACKETED.search(text) or _DOT_WORD.search(text) or _PLUS_WORD.search(text):
        return True
    words = _APART.sub(" ", text.lower()).split()
    return not DIGIT_WORDS.keys().isdisjoint(words) and _SPELLED.search(text) is not None


def find(text: str | None) -> list[dict]:
    """Plain and disguised identifiers of one text."""
    text = text or ""
    found = [(start, KINDS.index(kind), end, False) for kind, start, end in plain(text)]
    if is_suspect(text):
        copy = Normalised(text)
        taken = {k: sorted((s, e) for s, n, e, _ in found if n == k) for k in range(len(KINDS))}
        for kind, start, end in plain(copy.text):
            if copy.touched(start, end):
                n, (a, b) = KINDS.index(kind), copy.back(start, end)
                k = bisect_right(taken[n], (a, len(text)))
                if a < b and not (k and taken[n][k - 1][1] >= b):
                    found.append((a, n, b, True))
    return [{"kind": KINDS[n], "start": s, "end": e, "disguised": d} for s, n, e, d in sorted(found)]


def mask(text: str) -> str:
    """A text without its personal data; of stretches that overlap, the first names the kind."""
    out, done = [], 0
    for span in find(text):
        if span["start"] >= done:
            out += (text[done : span["start"]], f"[{span['kind'].upper()}]")
        done = max(done, span["end"])
    return "".join([*out, text[done:]])


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): all identifiers of every text."""

    def start():
        return lambda b: pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([find(t) for t in b.column("text").to_pylist()], _ARROW_SPANS)], names=["doc_id", "spans"])

    return map_slices(docs.select("doc_id", "text"), start, StructType([docs.schema["doc_id"]]).add("spans", SPANS))


def mask_documents(docs: DataFrame) -> DataFrame:
    """The documents with each stretch of personal data replaced by its kind in brackets; a null text stays null."""

    def start():
        return lambda b: with_column(b, "text", pa.array([None if t is None else mask(t) for t in b.column("text").to_pylist()], pa.string()))

    return map_slices(docs, start, schema_with(docs, "text", StringType())).select(docs.columns)


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _is_kind(kind: str):
    return lambda span: span["kind"] == kind


def digests(found: DataFrame) -> DataFrame:
    """Counts and digest of the plain identifiers, and the list of all."""
    base = F.filter("spans", lambda s: ~s["disguised"])
    counts = [F.size(F.filter("base", _is_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.withColumn("base", base).select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
