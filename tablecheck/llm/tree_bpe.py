"""BPE with the tokenizers library: whole texts to ids and back; long texts as a tree of parts that are encoded in parallel and joined.

A text is split at special tokens and normalised, as the library does. A long one is then cut into halves, quarters and so on, wherever the cut falls,
without looking for a safe place. Its parts are encoded on their own, together with those of other texts; the parts of very long texts become rows that Spark
deals out over all tasks. Parts are joined two by two. Around each join a window is encoded anew, and grows until it agrees with both sides:

* Blanks. The window goes from a blank in the left part to one in the right part, if there are any; what lies beyond is not affected.
* Words. It begins with a word of the left part that starts no nearer to the cut than the split pattern can look ahead, so it is a word of
  the whole as well. It grows to the right until one of its words begins where a word of the right part begins. From there on the right part is right,
  as the pattern goes by what follows a place alone.
* A long word that lies across the cut. Its window has a few tokens of each side and grows until its first token is that of the left side and its last one
  that of the right side. A row of tokens is what BPE makes of its text exactly if it is so for each two neighbours: merges go by rank, so the first merge
  across a border would take place between the two alone, too. All neighbours within the window are such, and its outer tokens
  are followed by the ones they have in the parts. The left part takes its end for the end of a word; windows therefore cover it, and are encoded without a word end
  unless they reach it.

So one join costs a few hundred characters, whatever the sizes of its sides, and ids never differ from those of the whole.

What stands between two blanks is encoded the same wherever it is, and mostly has been met before: a task keeps the ids of short stretches.

Results: null texts are encoded like empty ones, to no ids. Special tokens in a text are found as the library finds them. Ids outside the vocabulary
decode to nothing, as in the library.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructType

from tablecheck.llm.common import map_slices, ship_package, shuffle_partitions, stored

#: Characters of a text, and of a part of one, that are encoded at once.
PART = 16_384
#: Characters from which on the parts of a text are dealt out over tasks.
SPREAD = 1 << 20
#: Characters of a word across a cut that is encoded whole.
SHORT_WORD = 64
#: Stretches between blanks whose ids a task keeps, and the characters of such a stretch.
KEPT, KEPT_LENGTH = 300_000, 48

# Characters whose normal form Python gives as well, if the library says so for each of them: composed already, and lower-cased on their own.
_PROBE = [chr(c) for c in (*range(0x300), *range(0x2010, 0x2028), 0x20AC)]
_OTHERS = re.compile("[^\x00-\u02ff\u2010-\u2027\u20ac]")
_BREAKS = "\t\n\x0b\x0c\r\x85\xa0"

_codecs: dict[str, "Codec"] = {}


@dataclass
class Words:
    """A stretch of normalised text, its ids, and of each word where it begins and ends and its first id."""

    text: str
    ids: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


@dataclass
class Part:
    """A stretch of normalised text and its ids; its words, if they had to be worked out for all of it."""

    text: str
    ids: np.ndarray
    words: Words | None = None


class Codec:
    """The tokenizer of a file: for whole texts, for normalised parts, and for the inside of words."""

    def __init__(self, spec: bytes):
        import regex
        from tokenizers import Tokenizer

        told = json.loads(spec)
        self.whole = Tokenizer.from_str(spec.decode())
        self.whole.no_truncation()
        self.whole.no_padding()
        self.look_ahead = _look_ahead(told)
        self.specials = {t["content"]: t["id"] for t in told["added_tokens"]}
        names = sorted(self.specials, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        plain = told | {"normalizer": None, "added_tokens": [], "truncation": None, "padding": None, "post_processor": None}
        self.plain = Tokenizer.from_str(json.dumps(plain))
        self.inner = Tokenizer.from_str(json.dumps(plain | {"model": told["model"] | {"end_of_word_suffix": None}}))
        suffix = told["model"].get("end_of_word_suffix") or ""
        self.sizes = {i: len(t.removesuffix(suffix) if suffix else t) for t, i in told["model"]["vocab"].items()}
        self.ends_word = np.zeros(1 + max(self.sizes), dtype=bool)
        self.ends_word[[i for t, i in told["model"]["vocab"].items() if suffix and t.endswith(suffix)]] = True
        self.kept: dict[str, bytes] = {"": b""}
        self.knows_normal = self.whole.normalizer is not None and _normal("a".join(_PROBE)) == self.whole.normalizer.normalize_str("a".join(_PROBE))
        self.word = self._word_pattern(_split_pattern(told)) if self.knows_normal and suffix else None

    def _word_pattern(self, pattern: str) -> re.Pattern:
        """The split pattern for plain characters, with its classes as the library has them: letters stay in one word, digits stand alone."""
        plain = [c for c in sorted(set(_normal("".join(_PROBE)))) if c != " "]
        split = self.plain.pre_tokenizer.pre_tokenize_str
        letters = [c for c in plain if len(split(f"a{c}a")) == 1]
        digits = [c for c in plain if len(split(c + c)) == 2]
        listed = {r"\p{L}": "".join(map(re.escape, letters)), r"\p{N}": "".join(map(re.escape, digits))}
        return re.compile(re.sub(r"\\p\{[LN]\}", lambda m: listed[m.group()], pattern).replace(r"\s", " "))  # no other space is left

    def decode(self, ids: list[int]) -> str:
        return self.whole.decode(ids, skip_special_tokens=False)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts as unsigned 32-bit integers, least byte first."""
        sections = [self.sections(t) for t in texts]
        parts = [p for text in sections for section in text if not isinstance(section, int) for p in section]
        encoded = iter(self.encode_parts(parts))
        made = []
        for text in sections:
            ids = [np.array([x]) if isinstance(x, int) else self.joined([next(encoded) for _ in x]) for x in text]
            made.append(b"".join([x.astype("<u4").tobytes() for x in ids]))
        return made

    # ---- parts

    def sections(self, text: str) -> list[int | list[str]]:
        """Special tokens' ids, and between them normalised text cut into halves of halves."""
        found: list[int | list[str]] = []
        at = 0
        for match in self.special.finditer(text) if self.special else ():
            found += [self._halved(text[at : match.start()]), self.specials[match.group()]]
            at = match.end()
        return [x for x in [*found, self._halved(text[at:])] if x != []]

    def _halved(self, text: str) -> list[str]:
        if not text:
            return []
        if self.knows_normal and not _OTHERS.search(text):
            text = _normal(text)
        elif self.whole.normalizer:
            text = self.whole.normalizer.normalize_str(text)
        count = 1
        while count * PART < len(text):
            count *= 2
        cuts = [len(text) * k // count for k in range(count + 1)]
        return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if a < b]

    def encode_parts(self, texts: list[str]) -> list[Part]:
        """Parts on their own, all at once. A word, or what blanks part, is encoded once for all of them."""
        pieces, words, others = [], set(), set()
        for text in texts:
            if self.word is not None and not _OTHERS.search(text):
                pieces.append(self.word.findall(text))
                words.update(pieces[-1])
            else:
                pieces.append(text.split(" "))
                others.update(pieces[-1])
        if len(self.kept) > KEPT:
            self.kept = {"": b""}
        kept = self.kept
        fresh = [w for w in words if w not in kept]
        kept.update(zip(fresh, self._encode_words(fresh), strict=True))
        more = [w for w in others if w not in kept]
        kept.update(zip(more, self._encode_each(more), strict=True))
        made = [Part(t, np.frombuffer(b"".join(map(kept.__getitem__, p)), "<u4").astype(np.int64)) for t, p in zip(texts, pieces, strict=True)]
        for piece in fresh + more:
            if len(piece) > KEPT_LENGTH:
                del kept[piece]
        return made

    def _encode_each(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.plain.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of single words: of all of them in one text, whose words end where tokens say so."""
        ids = np.array(self.plain.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = (np.flatnonzero(self.ends_word[ids]) + 1).tolist()
        if len(ends) != len(words):
            return self._encode_each(words)
        raw = ids.tobytes()
        return [raw[4 * i : 4 * j] for i, j in zip([0, *ends[:-1]], ends, strict=True)] if ends else []

    def words(self, text: str) -> Words:
        """A part's ids with its words."""
        found = self.plain.encode(text, add_special_tokens=False)
        words = np.array(found.word_ids, dtype=np.int64)
        first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]])) if len(words) else np.empty(0, np.int64)
        offsets = np.array(found.offsets, dtype=np.int64).reshape(-1, 2)
        last = np.append(first[1:], len(words))[: len(first)] - 1
        return Words(text, np.array(found.ids, dtype=np.int64), offsets[first, 0], offsets[last, 1], first)

    def joined(self, parts: list[Part]) -> np.ndarray:
        """The ids of neighbouring parts, joined two by two."""
        while len(parts) > 1:
            pairs = [self.join(*parts[k : k + 2]) for k in range(0, len(parts) - 1, 2)]
            parts = pairs + (parts[-1:] if len(parts) % 2 else [])
        return parts[0].ids

    def join(self, left: Part, right: Part) -> Part:
        """Both parts in one. Only what lies between the blanks nearest to the cut is looked at."""
        begin = left.text.rfind(" ", 0, max(0, len(left.text) - self.look_ahead)) + 1
        end = right.text.find(" ", self.look_ahead)
        end = len(right.text) if end < 0 else end
        one = left.words if left.words and not begin else self.words(left.text[begin:])
        two = right.words if right.words and end == len(right.text) else self.words(right.text[:end])
        middle = self.join_words(one, two)
        ids = np.concatenate([left.ids[: len(left.ids) - len(one.ids)], middle.ids, right.ids[len(two.ids) :]])
        return Part(left.text + right.text, ids, middle if not begin and end == len(right.text) else None)

    def join_words(self, left: Words, right: Words) -> Words:
        text, cut = left.text + right.text, len(left.text)
        # The last word of the left whose beginning does not depend on what follows the cut.
        sure = int(np.searchsorted(left.start, cut - self.look_ahead, side="right")) - 1
        begin = int(left.start[sure]) if sure >= 0 else 0
        begins = right.start + cut
        width = 2 * self.look_ahead
        while True:
            end = min(len(text), cut + width)
            words = self.plain.pre_tokenizer.pre_tokenize_str(text[begin:end])
            words = [(mapped, a + begin, b + begin) for mapped, (a, b) in words]
            meet = next((a for _, a, _ in words if a >= cut and (end == len(text) or a <= end - self.look_ahead) and _holds(begins, a)), None)
            if meet is not None or end == len(text):
                break
            width *= 2
        meet = len(text) if meet is None else meet
        words = [w for w in words if w[1] < meet]
        made = [self._word(w, left, right, sure, cut) for w in words]
        keep, rest = max(sure, 0), int(np.searchsorted(begins, meet))
        kept = int(left.first[keep]) if sure >= 0 else 0
        skipped = int(right.first[rest]) if rest < len(right.first) else len(right.ids)
        sizes = [len(m) for m in made]
        new = int(np.sum(sizes, dtype=np.int64))
        return Words(
            text,
            np.concatenate([left.ids[:kept], *made, right.ids[skipped:]]).astype(np.int64),
            np.concatenate([left.start[:keep], np.array([w[1] for w in words], np.int64), begins[rest:]]),
            np.concatenate([left.end[:keep], np.array([w[2] for w in words], np.int64), right.end[rest:] + cut]),
            np.concatenate([left.first[:keep], kept + np.cumsum([0, *sizes[:-1]])[: len(sizes)].astype(np.int64), right.first[rest:] - skipped + kept + new]),
        )

    def _word(self, word: tuple[str, int, int], left: Words, right: Words, sure: int, cut: int) -> np.ndarray:
        """Ids of a word of the window; from its two sides if it is long and lies across the cut."""
        mapped, a, b = word
        across = a < cut < b and b - a > SHORT_WORD and sure >= 0 and left.start[sure] == a and left.end[sure] == cut
        if across and len(right.start) and right.start[0] == 0 and right.end[0] + cut == b:
            stop = left.first[sure + 1] if sure + 1 < len(left.first) else len(left.ids)
            until = right.first[1] if len(right.first) > 1 else len(right.ids)
            return self._joined_word(mapped, left.ids[left.first[sure] : stop].tolist(), right.ids[:until].tolist())
        return np.array([t.id for t in self.plain.model.tokenize(mapped)], dtype=np.int64)

    def _joined_word(self, mapped: str, one: list[int], two: list[int]) -> np.ndarray:
        """Ids of a word (as mapped bytes) from those of its two sides, each encoded as a word."""
        cut = sum(self.sizes[i] for i in one)
        size = 4
        while True:
            i, j = max(0, len(one) - size), min(len(two), size)
            x, y = cut - sum(self.sizes[t] for t in one[i:]), cut + sum(self.sizes[t] for t in two[:j])
            model = self.plain.model if j == len(two) else self.inner.model
            made = [t.id for t in model.tokenize(mapped[x:y])]
            if (i == 0 or made[0] == one[i]) and (j == len(two) or made[-1] == two[j - 1]):
                return np.array([*one[:i], *made, *two[j:]], dtype=np.int64)
            size *= 2


def _normal(text: str) -> str:
    for c in _BREAKS:
        text = text.replace(c, " ")
    while "  " in text:
        text = text.replace("  ", " ")
    return text.lower()


def _holds(sorted_values: np.ndarray, value: int) -> bool:
    k = int(np.searchsorted(sorted_values, value))
    return k < len(sorted_values) and sorted_values[k] == value


def _look_ahead(told: dict) -> int:
    """How far behind a place the split pattern may look before a match is certain; an error for files whose parts could not be joined so."""
    import regex

    if told["model"]["type"] != "BPE" or told["model"].get("dropout") or told["model"].get("continuing_subword_prefix") or told["model"].get("ignore_merges"):
        raise ValueError("Parts can be joined for plain BPE models only.")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in told["added_tokens"]):
        raise ValueError("Special tokens must stand for their own text alone.")
    before = told["pre_tokenizer"]
    steps = before["pretokenizers"] if before["type"] == "Sequence" else [before]
    split, level = steps if len(steps) == 2 else ({}, {})
    if split.get("type") != "Split" or level.get("type") != "ByteLevel" or level["add_prefix_space"] or level["use_regex"] or split["behavior"] != "Removed" or not split["invert"]:
        raise ValueError("Texts must be split by one pattern and mapped to bytes.")
    pattern = _split_pattern(told)
    # Literals, and single characters of a class or stretches of them: what a match depends on is its own text and the character behind it.
    alternative = r"(?:[^\[\](){}|*+?.^$\\]|\\[^\w])+|\[(?:[^\[\]\\]|\\.)+\]\+?"
    if not regex.fullmatch(f"(?:{alternative})(?:\\|(?:{alternative}))*", pattern):
        raise ValueError("The split pattern may hold literals and classes of characters only.")
    return len(pattern)


def _split_pattern(told: dict) -> str:
    before = told["pre_tokenizer"]
    return (before["pretokenizers"][0] if before["type"] == "Sequence" else before)["pattern"]["Regex"]


def codec(spec: bytes) -> Codec:
    """One codec for each file in a Python process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a process for each core
    key = hashlib.sha256(spec).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(spec)
    return _codecs[key]


_LEAVES = StructType().add("row", LongType()).add("section", IntegerType()).add("part", IntegerType()).add("special", IntegerType()).add("text", StringType())


def _leaves(docs: DataFrame, shared) -> DataFrame:
    """A row for each part of each text, stored, as the number of a row must not change."""

    def start():
        own = codec(shared.value)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = []
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for s, section in enumerate(own.sections(text)):
                    found += [(row, s, 0, section, None)] if isinstance(section, int) else [(row, s, k, None, p) for k, p in enumerate(section)]
            columns = list(zip(*found, strict=True)) or [()] * 5
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(_positions(batch, columns[0]))), *arrays], names=["doc_id", *_LEAVES.names])

        return work

    kinds = StructType([docs.schema["doc_id"], *_LEAVES.fields])
    return stored(map_slices(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")), start, kinds))


def _positions(batch: pa.RecordBatch, rows: tuple) -> np.ndarray:
    """Where in the batch each of these row numbers stands."""
    return np.searchsorted(batch.column("row").to_numpy(), np.array(rows, dtype=np.int64))


def _encoded(leaves: DataFrame, shared) -> DataFrame:
    """The parts with their ids, each in whatever task it falls to."""

    def start():
        own = codec(shared.value)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = [p.ids.astype("<u4").tobytes() for p in own.encode_parts([t or "" for t in batch.column("text").to_pylist()])]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=[*batch.schema.names, "ids"])

        return work

    spread = leaves.repartition(shuffle_partitions(leaves.sparkSession), "row", "section", "part")
    return map_slices(spread, start, StructType([leaves.schema["doc_id"], *_LEAVES.fields]).add("ids", BinaryType()))


def _trees(leaves: DataFrame, shared) -> DataFrame:
    """(doc_id, n_tokens, packed, decoded) of each text, from its parts."""

    def join(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = codec(shared.value)
        ids: list[int] = []
        for _, section in rows.sort_values(["section", "part"]).groupby("section"):
            if pd.notna(section["special"].iloc[0]):
                ids.append(int(section["special"].iloc[0]))
            else:
                parts = [Part(text, np.frombuffer(x, "<u4").astype(np.int64)) for text, x in zip(section["text"], section["ids"], strict=True)]
                ids += own.joined(parts).tolist()
        return pd.DataFrame({"doc_id": rows["doc_id"].iloc[:1], "n_tokens": [len(ids)], "packed": [np.array(ids, "<u4").tobytes()], "decoded": [own.decode(ids)]})

    kinds = StructType([leaves.schema["doc_id"]]).add("n_tokens", LongType()).add("packed", BinaryType()).add("decoded", StringType())
    return _encoded(leaves, shared).groupBy("row").applyInPandas(join, kinds)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, packed, decoded) of every row: the ids of its text as unsigned 32-bit integers, least byte first, and what they decode to.

    ``path``: the tokenizer's file, on the driver. It has the size of the vocabulary, whatever the data, and is sent to the executors once.
    """
    with open(path, "rb") as file:
        spec = file.read()
    _look_ahead(json.loads(spec))
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    ship_package(docs.sparkSession)

    def start():
        own = codec(shared.value)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            packed = own.encode([t or "" for t in batch.column("text").to_pylist()])
            decoded = [own.decode(np.frombuffer(x, "<u4").tolist()) for x in packed]
            columns = [batch.column("doc_id"), pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array(packed, pa.binary()), pa.array(decoded, pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "packed", "decoded"])

        return work

    rows = docs.select("doc_id", "text")
    is_long = F.char_length(F.coalesce("text", F.lit(""))) > SPREAD
    kinds = StructType([docs.schema["doc_id"]]).add("n_tokens", LongType()).add("packed", BinaryType()).add("decoded", StringType())
    return map_slices(rows.filter(~is_long), start, kinds).union(_trees(_leaves(rows.filter(is_long), shared), shared))


def digests(trip: DataFrame) -> DataFrame:
    """Per document: the number of ids, and SHA-256 of the ids and of the decoded text."""
    return trip.select("doc_id", "n_tokens", F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
