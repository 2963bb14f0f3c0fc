"""Exact removal of repeated passages: suffixes of all documents, ordered only through the threshold by most-significant-digit passes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller doc_id. So suffixes need ordering through
their first ``LENGTH`` bytes and no further: equal groups are exactly the repeated windows, and the smallest doc_id of a group decides.

Three passes refine the groups, each on what the pass before left unsettled.

1. Gram. Each window belongs to the ``GRAM``-byte gram in it that comes first by a hash (the leftmost of equals). Equal windows have equal
   grams, and neighbouring windows mostly share theirs, so a text has one gram for some 18 windows. Grams that only one
   document has settle their windows: nothing repeats.
2. Stretch. The windows of one gram occurrence lie in one stretch of text. Where all occurrences of a gram have the same stretch, all
   its windows are equal and the smallest doc_id is known.
3. Windows. Where stretches of a gram differ, the windows of one document for each distinct stretch, that with the smallest doc_id, are
   ordered by eight bytes a pass, within the equal groups of the passes before, until groups are single or the threshold is reached.
   This pass compares the bytes themselves. The grams at the edges of a common passage have another stretch in every document. Windows of grams
   with more than ``CROWDED`` stretches are therefore dealt by their own hash: a block sends the hash of each distinct one, and its
   bytes only where another block has that hash, too.

Work is dealt by blocks of documents and by ranges of the gram hash (the leading digit). A block sends each range its distinct grams or
stretches once, with its smallest doc_id, so a passage that a third of all documents hold is one entry for each block and never one for each
copy; of the stretches at its edges no range gets more than ``CROWDED``. Texts are shuffled once, compressed, and stored by block; all later passes read them in place.
Where repeated grams occur a block finds out once, in the second pass, and sends it on to itself for the later ones.

Grams are told apart by 32 bits and their range, stretches by 64 bits more; a chance meeting of grams costs work and no correctness.
Results: null texts are empty; texts under ``LENGTH`` bytes lose nothing; rows with equal doc_id do not remove from each other; a null doc_id
comes after all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from tablecheck.llm.common import checkpointed, map_slices, shuffle_partitions
from tablecheck.plans.storage import scratch_folder

GRAM = 16
#: Bytes of text in a block, which bounds what a task has in hand, and in a piece that is hashed at once (places in a piece take 20 bits).
BLOCK_BYTES = 4 << 20
PIECE = 1 << 20
#: Distinct stretches of a gram that one range compares.
CROWDED = 4096

MESSAGE = "to long, sender long, kind int, a binary, b binary, c binary, d binary"
_U = np.uint64
_PLACE = _U(PIECE - 1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of the gram at each place of an array of bytes."""
    n = len(data) - GRAM + 1
    words = np.empty(n + 8, dtype=_U)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    for shift in range(8):
        part = words[shift::8]
        part[:] = np.frombuffer(padded, dtype="<u8", count=len(part), offset=shift)
    mixed = words[:n] * _U(0x9E3779B97F4A7C15)
    mixed ^= mixed >> _U(32)
    mixed += words[8 : n + 8]
    mixed *= _U(0xD6E8FEB86659FD93)
    mixed ^= mixed >> _U(32)
    mixed *= _U(0xD6E8FEB86659FD93)
    mixed ^= mixed >> _U(32)
    return mixed


def _pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (document, offset, bytes) of up to ``PIECE`` bytes; long texts are cut so that each window is in one part."""
    batch, size = [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), PIECE - length):
            part = text[at : at + PIECE - 1] if len(text) >= PIECE else text
            if len(part) < length:
                continue
            if size + len(part) >= PIECE:
                yield batch
                batch, size = [], 0
            batch.append((k, at, part))
            size += len(part)
            if len(text) < PIECE:
                break
    if batch:
        yield batch


class Block:
    """The gram occurrences of a block's texts: document, first and last window, gram hash; all places within the document."""

    def __init__(self, texts: list[bytes], length: int):
        self.texts, self.length = texts, length
        found: list[tuple[np.ndarray, ...]] = []
        for batch in _pieces(texts, length):
            sizes = np.array([len(p) for _, _, p in batch])
            ends = np.cumsum(sizes)
            hashes = gram_hashes(np.frombuffer(b"".join(p for _, _, p in batch), dtype=np.uint8))
            # The least hash of each window, with its place: the hash in the upper 44 bits.
            key = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=_U)
            width, have = length - GRAM + 1, 1
            while 2 * have <= width:
                key = np.minimum(key[:-have], key[have:])
                have *= 2
            if have < width:
                key = np.minimum(key[: len(key) - (width - have)], key[width - have :])
            place = (key & _PLACE).astype(np.int64)
            inside = np.ones(len(place), dtype=bool)
            for end in ends[:-1]:
                inside[max(0, end - length + 1) : end] = False
            windows = np.flatnonzero(inside)
            place = place[windows]
            first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (windows[1:] != windows[:-1] + 1)]))
            last = np.concatenate([first[1:], [len(windows)]]) - 1
            owner = np.searchsorted(ends, windows[first], side="right")
            shift = np.array([at for _, at, _ in batch]) - (ends - sizes)
            docs = np.array([k for k, _, _ in batch])
            found.append((docs[owner], windows[first] + shift[owner], windows[last] + shift[owner], hashes[place[first]]))
        joined = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.empty(0, np.int64)] * 3 + [np.empty(0, _U)]
        self.doc, self.first, self.last, self.hash = joined

    @classmethod
    def known(cls, texts: list[bytes], length: int, doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> Block:
        """Occurrences that were found before; without their hashes."""
        block = cls.__new__(cls)
        block.texts, block.length, block.doc, block.first, block.last, block.hash = texts, length, doc, first, last, np.empty(0, _U)
        return block

    def grams(self, ranges: int) -> np.ndarray:
        """A range and 32 bits, as one number. The hashes at hand are the least of their windows, so they are mixed once more."""
        mixed = self.hash * _U(0x9E3779B97F4A7C15)
        return (((mixed >> _U(32)) * _U(ranges)) & ~_U(0xFFFFFFFF)) | ((mixed ^ (mixed >> _U(32))) & _U(0xFFFFFFFF))

    def stretch(self, k: int) -> bytes:
        return self.texts[self.doc[k]][self.first[k] : self.last[k] + self.length]

    def select(self, chosen: np.ndarray) -> None:
        self.doc, self.first, self.last, self.hash = (x[chosen] for x in (self.doc, self.first, self.last, self.hash))


def _opened(rows: pd.DataFrame) -> tuple[np.ndarray, list[bytes]]:
    """doc_ids and texts of a block, in one order for all passes."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    opened = sorted(zip(rows["order_id"].tolist(), rows["no_id"].tolist(), map(unpack, rows["packed"]), strict=True))
    return np.array([k for k, _, _ in opened], dtype=np.int64), [text for _, _, text in opened]


def _message(to: int, sender: int, kind: int, *arrays: np.ndarray | bytes) -> tuple:
    packed = [x if isinstance(x, bytes) else x.tobytes() for x in arrays]
    return (to, sender, kind, *packed, *[b""] * (4 - len(packed)))


def _frame(messages: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(messages, columns=["to", "sender", "kind", "a", "b", "c", "d"])


def _thin(numbers: np.ndarray) -> bytes:
    """Whole numbers, packed: the first bytes of all before the second ones."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(numbers.reshape(-1).view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes())


def _thick(packed: bytes, kind: str) -> np.ndarray:
    """What ``_thin`` was given, as one row."""
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _by_range(grams: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The ranges that sorted gram numbers fall into."""
    ranges = (grams >> _U(32)).astype(np.int64)
    edges = np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1]])) if len(grams) else []
    for k, start in enumerate(edges):
        yield int(ranges[start]), slice(start, edges[k + 1] if k + 1 < len(edges) else len(grams))


def _starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where groups of equal keys begin."""
    change = np.zeros(len(sorted_keys[0]), dtype=bool)
    change[:1] = True
    for key in sorted_keys:
        change[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(change)


# ---- pass 1: grams ---------------------------------------------------------------------------------------------------------------


def _send_grams(block: int, ids: np.ndarray, texts: list[bytes], length: int, ranges: int) -> list[tuple]:
    found = Block(texts, length)
    grams, docs = found.grams(ranges), ids[found.doc]
    order = np.lexsort((docs, grams))
    grams, docs = grams[order], docs[order]
    at = _starts(grams)
    several = np.maximum.reduceat(docs, at) != np.minimum.reduceat(docs, at) if len(at) else np.empty(0, bool)
    grams = grams[at]
    return [_message(r, block, 1, grams[s].astype("<u4"), np.packbits(several[s])) for r, s in _by_range(grams)]


def _repeated_grams(key, messages: pd.DataFrame) -> pd.DataFrame:
    """To each block: its grams that more than one document has."""
    parts = [np.frombuffer(a, "<u4") for a in messages["a"]]
    several = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=len(p)) for p, b in zip(parts, messages["b"], strict=True)])
    grams = np.concatenate(parts)
    order = np.argsort(grams, kind="stable")
    at = _starts(grams[order])
    counts = np.diff(np.append(at, len(order)))
    repeated = np.empty(len(order), dtype=bool)
    repeated[order] = np.repeat((counts > 1) | (np.maximum.reduceat(several[order], at) > 0), counts)
    # The grams of a sender lie together, so each is looked at once, however many senders there are.
    ends = np.cumsum([len(p) for p in parts]).tolist()
    held = [grams[end - len(p) : end][repeated[end - len(p) : end]] for p, end in zip(parts, ends, strict=True)]
    return _frame([_message(int(sender), int(key[0]), 2, own) for sender, own in zip(messages["sender"].tolist(), held, strict=True) if len(own)])


# ---- pass 2: stretches -----------------------------------------------------------------------------------------------------------


class Stretches:
    """The distinct stretches of a block's repeated grams, sorted by gram and stretch."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], length: int, ranges: int, replies: pd.DataFrame):
        import xxhash

        told = [np.frombuffer(a, "<u4").astype(_U) | _U(int(r) << 32) for a, r in zip(replies["a"], replies["sender"], strict=True)]
        repeated = np.sort(np.concatenate(told)) if told else np.empty(0, _U)
        # Only texts that hold a repeated gram matter from here on.
        self.block = found = Block(texts, length)
        grams = found.grams(ranges)
        spot = np.minimum(np.searchsorted(repeated, grams), max(0, len(repeated) - 1))
        chosen = repeated[spot] == grams if len(repeated) else np.zeros(len(grams), bool)
        found.select(chosen)
        grams = grams[chosen]
        stretch = np.fromiter((xxhash.xxh3_64_intdigest(found.stretch(k)) for k in range(len(grams))), dtype=_U, count=len(grams))
        docs = ids[found.doc]
        order = np.lexsort((docs, stretch, grams))
        at = _starts(grams[order], stretch[order])
        self.first = order[at]  # an occurrence in the smallest document
        self.grams, self.stretch, self.least = grams[self.first], stretch[self.first], docs[self.first]
        self.group = np.empty(len(order), dtype=np.int64)  # of each occurrence
        self.group[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(order))))
        self.docs, self.ranges = docs, list(_by_range(self.grams))

    def packed(self) -> tuple[bytes, bytes]:
        """What later passes cannot tell from the texts: the occurrences and their groups, and how many stretches each range has.

        Places in a text are below 2^31.
        """
        block = self.block
        numbers = np.stack([np.diff(block.doc, prepend=0), np.diff(block.first, prepend=0), block.last - block.first, self.group]).astype("<i4")
        runs = np.array([(r, s.stop - s.start) for r, s in self.ranges], dtype="<i8")
        return _thin(numbers), runs.tobytes()

    @classmethod
    def unpacked(cls, ids: np.ndarray, texts: list[bytes], length: int, replies: pd.DataFrame) -> Stretches:
        """What ``packed`` gave, of the message that brings it; without one nothing is repeated."""
        found, told = cls.__new__(cls), replies[replies["kind"] == 11]
        numbers = (_thick(told["a"].iloc[0], "<i4") if len(told) else np.empty(0, "<i4")).reshape(4, -1).astype(np.int64)
        doc, first = np.cumsum(numbers[:2], axis=1)
        found.block, found.docs, found.group = Block.known(texts, length, doc, first, first + numbers[2]), ids[doc], numbers[3]
        order = np.lexsort((found.docs, found.group))
        found.first = order[_starts(found.group[order])]
        found.least = found.docs[found.first]
        runs = np.frombuffer(told["b"].iloc[0] if len(told) else b"", "<i8").reshape(-1, 2)
        found.ranges = [(r, slice(end - n, end)) for (r, n), end in zip(runs.tolist(), np.cumsum(runs[:, 1]).tolist(), strict=True)]
        return found


def _send_stretches(block: int, found: Stretches) -> list[tuple]:
    return [_message(r, block, 3, found.grams[s].astype("<u4"), found.stretch[s], _thin(found.least[s])) for r, s in found.ranges]


def _send_on(block: int, found: Stretches, ranges: int) -> list[tuple]:
    """The stretches themselves, for the later passes: past all ranges, each block's on its own."""
    return [_message(ranges + block, block, 11, *found.packed())]


def _least_documents(key, messages: pd.DataFrame, limit: int) -> pd.DataFrame:
    """To each block, by stretch in the order sent: the smallest document, whether the gram has other stretches, and whether more than the limit.

    What a block sends on to itself (kind 11) goes back as it is.
    """
    if messages["kind"].iloc[0] == 11:
        return messages.assign(to=messages["sender"])
    parts = [np.frombuffer(a, "<u4") for a in messages["a"]]
    grams, owner = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    stretch = np.concatenate([np.frombuffer(b, _U) for b in messages["b"]])
    docs = np.concatenate([_thick(c, "<i8") for c in messages["c"]])
    order = np.lexsort((stretch, grams))
    one, two = _starts(grams[order], stretch[order]), _starts(grams[order])
    least = np.empty(len(order), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(docs[order], one), np.diff(np.append(one, len(order))))
    kinds = np.searchsorted(one, np.append(two[1:], len(order))) - np.searchsorted(one, two)
    is_open, crowded = np.empty(len(order), bool), np.empty(len(order), bool)
    is_open[order] = np.repeat(kinds > 1, np.diff(np.append(two, len(order))))
    crowded[order] = np.repeat(kinds > limit, np.diff(np.append(two, len(order))))
    ends = np.cumsum([len(p) for p in parts]).tolist()
    out = []
    for sender, part, end in zip(messages["sender"].tolist(), parts, ends, strict=True):
        s = slice(end - len(part), end)
        # Where another block has a smaller document: it; else the largest number.
        out.append(_message(int(sender), int(key[0]), 4, np.where(least[s] < docs[s], least[s], np.iinfo(np.int64).max), np.packbits(is_open[s]), np.packbits(crowded[s]) if crowded[s].any() else b""))
    return _frame(out)


def _settle(found: Stretches, replies: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each distinct stretch: the smallest document, and whether its windows must be compared by this block, dealt by gram or by window."""
    least, is_open, crowded = found.least.copy(), np.zeros(len(found.least), dtype=bool), np.zeros(len(found.least), dtype=bool)
    answers = {int(r): told for r, *told in zip(replies["sender"], replies["a"], replies["b"], replies["c"], strict=True)}
    for r, s in found.ranges:
        told = np.frombuffer(answers[r][0], np.int64)
        is_open[s] = np.unpackbits(np.frombuffer(answers[r][1], np.uint8), count=len(told)).astype(bool) & (told >= least[s])
        if answers[r][2]:
            crowded[s] = np.unpackbits(np.frombuffer(answers[r][2], np.uint8), count=len(told)).astype(bool)
        least[s] = np.minimum(least[s], told)
    return least, is_open & ~crowded, is_open & crowded


# ---- pass 3: windows -------------------------------------------------------------------------------------------------------------


def _send_windows(block: int, found: Stretches, is_open: np.ndarray) -> list[tuple]:
    import zstandard

    out, pack = [], zstandard.ZstdCompressor(level=1).compress
    for r, s in found.ranges:
        chosen = np.flatnonzero(is_open[s]) + s.start
        if len(chosen):
            texts = [found.block.stretch(k) for k in found.first[chosen]]
            out.append(_message(r, block, 5, pack(b"".join(texts)), np.array([len(t) for t in texts], "<i4"), found.least[chosen]))
    return out


def equal_groups(rows: np.ndarray) -> np.ndarray:
    """Numbers of groups of equal rows of bytes, by passes over eight bytes each, first bytes first; -1 for rows without an equal.

    Members of a group lie together, so a pass orders only those groups anew whose eight bytes are not all equal.
    """
    n, length = rows.shape
    group, alive = np.zeros(n, dtype=np.int64), np.arange(n)
    digits = np.zeros((n, -(-length // 8) * 8), np.uint8)
    digits[:, :length] = rows
    del rows  # the caller's, if it keeps none
    for at, digit in enumerate(digits.view(_U).T):
        value = digit[alive]
        starts = _starts(group[alive])
        sizes = np.diff(np.append(starts, len(alive)))
        unlike = value != np.repeat(value[starts], sizes)
        mixed = np.flatnonzero(np.repeat(np.add.reduceat(unlike, starts, dtype=np.int64) > 0, sizes)) if len(alive) else alive
        order = mixed[np.lexsort((value[mixed], group[alive[mixed]])) if at else np.argsort(value[mixed])]
        alive[mixed], value[mixed] = alive[order], value[order]
        starts = _starts(group[alive], value)
        counts = np.diff(np.append(starts, len(alive)))
        numbers = np.repeat(np.arange(len(starts)), counts)
        keep = np.repeat(counts > 1, counts)
        group[alive[~keep]] = -1
        group[alive[keep]] = numbers[keep]
        alive = alive[keep]
        if not len(alive):
            break
    return group


class Windows:
    """The distinct windows of a block's stretches whose grams are crowded, sorted by range and hash."""

    def __init__(self, found: Stretches, crowded: np.ndarray, length: int, ranges: int):
        self.chosen = np.flatnonzero(crowded)
        texts = [found.block.stretch(k) for k in found.first[self.chosen]]
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.counts = sizes - length + 1
        starts = np.repeat(np.cumsum(sizes) - sizes - np.cumsum(self.counts) + self.counts, self.counts) + np.arange(self.counts.sum())
        rows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(b"".join(texts), np.uint8), length)[starts]
        group = equal_groups(rows)
        alone = group < 0
        group[alone] = group.max(initial=-1) + 1 + np.arange(int(alone.sum()))
        _, first, place = np.unique(group, return_index=True, return_inverse=True)
        words = np.zeros((len(first), -(-length // 8) * 8), np.uint8)
        words[:, :length] = rows[first]
        mixed = np.zeros(len(first), dtype=_U)
        for word in words.view("<u8").T:
            mixed = (mixed ^ word) * _U(0x9E3779B97F4A7C15)
            mixed ^= mixed >> _U(29)
        mixed *= _U(0xD6E8FEB86659FD93)
        mixed ^= mixed >> _U(32)
        order = np.argsort(mixed, kind="stable")
        self.hash, self.bytes = mixed[order], words[order, :length]
        self.to = ((self.hash >> _U(32)) * _U(ranges)) & ~_U(0xFFFFFFFF)  # as _by_range reads it
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.place = rank[place]  # of each window of the stretches
        self.docs = np.repeat(found.least[self.chosen], self.counts)
        self.least = np.full(len(order), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.place, self.docs)

    def met(self, replies: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
        """By range: the windows whose hash another block has as well."""
        answers = dict(zip(map(int, replies["sender"]), replies["a"], strict=True))
        for r, s in _by_range(self.to):
            bits = np.unpackbits(np.frombuffer(answers[r], np.uint8), count=s.stop - s.start)
            if bits.any():
                yield r, np.flatnonzero(bits) + s.start

    def gone(self, replies: pd.DataFrame) -> dict[int, np.ndarray]:
        """By distinct stretch: which of its windows start in a smaller document."""
        elsewhere = np.zeros(len(self.hash), dtype=bool)
        answers = dict(zip(*(replies[replies["kind"] == 10][c] for c in ("sender", "a")), strict=True))
        for r, places in self.met(replies[replies["kind"] == 8]):
            elsewhere[places] = np.unpackbits(np.frombuffer(answers[r], np.uint8), count=len(places)).astype(bool)
        gone = elsewhere[self.place] | (self.least[self.place] < self.docs)
        return dict(zip(self.chosen.tolist(), np.split(gone, np.cumsum(self.counts)[:-1]), strict=True))


def _send_hashes(block: int, windows: Windows) -> list[tuple]:
    return [_message(r, block, 7, windows.hash[s]) for r, s in _by_range(windows.to)]


def _met_hashes(key, messages: pd.DataFrame) -> pd.DataFrame:
    """To each block, by hash in the order sent: whether it was sent more than once."""
    parts = [np.frombuffer(a, _U) for a in messages["a"]]
    _, place, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    met = np.split(counts[place] > 1, np.cumsum([len(p) for p in parts])[:-1])
    return _frame([_message(int(sender), int(key[0]), 8, np.packbits(bits)) for sender, bits in zip(messages["sender"], met, strict=True)])


def _send_met(block: int, windows: Windows, replies: pd.DataFrame, length: int) -> list[tuple]:
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    return [_message(r, block, 9, pack(windows.bytes[places].tobytes()), np.full(len(places), length, "<i4"), windows.least[places]) for r, places in windows.met(replies)]


def _equal_windows(key, messages: pd.DataFrame, length: int) -> pd.DataFrame:
    """To each block: which windows of the stretches (kind 5) or single windows (kind 9) it sent start in a smaller document, as bits."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    sizes = np.concatenate([np.frombuffer(b, "<i4") for b in messages["b"]]).astype(np.int64)
    docs = np.concatenate([np.frombuffer(c, np.int64) for c in messages["c"]])
    data = np.frombuffer(b"".join(map(unpack, messages["a"])), dtype=np.uint8)
    counts = sizes - length + 1
    offsets = np.cumsum(sizes) - sizes
    bases = np.cumsum(counts) - counts
    starts = np.repeat(offsets - bases, counts) + np.arange(counts.sum())
    owner = np.repeat(docs, counts)
    group = equal_groups(np.lib.stride_tricks.sliding_window_view(data, length)[starts])
    gone = np.zeros(len(group), dtype=bool)
    held = np.flatnonzero(group >= 0)
    if len(held):
        order = held[np.argsort(group[held], kind="stable")]
        at = _starts(group[order])
        least = np.repeat(np.minimum.reduceat(owner[order], at), np.diff(np.append(at, len(order))))
        gone[order] = least < owner[order]
    out, done = [], 0
    for sender, kind, b in zip(messages["sender"], messages["kind"], messages["b"], strict=True):
        n = int((np.frombuffer(b, "<i4").astype(np.int64) - length + 1).sum())
        out.append(_message(int(sender), int(key[0]), int(kind) + 1, np.packbits(gone[done : done + n])))
        done += n
    return _frame(out)


# ---- the whole -------------------------------------------------------------------------------------------------------------------


def _finish(ids: np.ndarray, texts: list[bytes], found: Stretches, replies: pd.DataFrame, length: int, ranges: int) -> pd.DataFrame:
    """Per document: its bytes without those that repeated windows cover."""
    least, is_open, crowded = _settle(found, replies[replies["kind"] == 4])
    answers = dict(zip(*(replies[replies["kind"] == 6][c] for c in ("sender", "a")), strict=True))
    # Windows gone, by distinct stretch.
    bits: dict[int, np.ndarray] = Windows(found, crowded, length, ranges).gone(replies) if crowded.any() else {}
    compared = is_open | crowded
    for r, s in found.ranges:
        chosen = np.flatnonzero(is_open[s]) + s.start
        if len(chosen):
            counts = (found.block.last - found.block.first + 1)[found.first[chosen]]
            gone = np.unpackbits(np.frombuffer(answers[r], np.uint8), count=int(counts.sum())).astype(bool)
            bits |= dict(zip(chosen.tolist(), np.split(gone, np.cumsum(counts)[:-1]), strict=True))
    # All texts of the block in one array, each with a place behind its end.
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    base = np.cumsum(sizes + 1) - sizes - 1
    total = int((sizes + 1).sum())
    block = found.block
    whole = least[found.group] < found.docs
    k = np.flatnonzero(whole)
    at = base[block.doc[k]]
    edge = np.bincount(at + block.first[k], minlength=total) - np.bincount(at + block.last[k] + length, minlength=total)
    k = np.flatnonzero(~whole & compared[found.group])
    if len(k):
        # Windows gone, stretch after stretch, and where those of each stretch begin.
        chosen = np.flatnonzero(compared)
        ends = np.cumsum([len(bits[g]) for g in chosen.tolist()])
        flat = np.flatnonzero(np.concatenate([bits[g] for g in chosen.tolist()]))
        owner = np.searchsorted(ends, flat, side="right")
        flat -= np.append(0, ends[:-1])[owner]
        counts = np.bincount(chosen[owner], minlength=len(compared))
        begins = np.cumsum(counts) - counts
        group = found.group[k]
        many = counts[group]
        within = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        starts = np.repeat(base[block.doc[k]] + block.first[k], many) + flat[np.repeat(begins[group], many) + within]
        edge += np.bincount(starts, minlength=total) - np.bincount(starts + length, minlength=total)
    covered = np.cumsum(edge) > 0
    gone = np.concatenate([[0], np.cumsum(covered)])
    rows = []
    for doc_id, text, first, size in zip(ids.tolist(), texts, base.tolist(), sizes.tolist(), strict=True):
        removed = int(gone[first + size] - gone[first])
        if not removed:
            rows.append((doc_id, size, 0, 0, text))
            continue
        mine = covered[first : first + size]
        spans = int(mine[0]) + int((mine[1:] & ~mine[:-1]).sum())
        rows.append((doc_id, size, removed, spans, np.frombuffer(text, np.uint8)[~mine].tobytes()))
    return pd.DataFrame(rows, columns=["order_id", "n_bytes", "n_removed", "n_spans", "kept"])


def _spans(rows: pd.DataFrame) -> pd.DataFrame:
    rows["kept_sha256"] = [hashlib.sha256(k).hexdigest() for k in rows.pop("kept")]
    return rows


def _packed(docs: DataFrame, blocks: int, buckets: int) -> DataFrame:
    """(block, order_id, packed): compressed texts, stored by block in the shared folder.

    The files are those of a bucketed table, so that every pass reads a block in place and only what is sent to it moves. The table's
    name is given up at once; its files stay with the other checkpoints of the application.
    """

    def start():
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [pack((t or "").encode("utf-8", "replace")) for t in batch.column("text").to_pylist()]
            kept = ["block", "order_id", "no_id"]
            return pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(texts, pa.binary())], names=[*kept, "packed"])

        return work

    order_id = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    # Dealt by id and text, as many rows may have no id or the same one.
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))
    rows = docs.select(block.alias("block"), order_id.alias("order_id"), F.col("doc_id").isNull().alias("no_id"), "text")
    packed = map_slices(rows, start, StructType().add("block", "long").add("order_id", "long").add("no_id", "boolean").add("packed", BinaryType()))
    spark, folder = docs.sparkSession, scratch_folder(docs.sparkSession)
    name = "llm_blocks_" + folder.rsplit("/", 1)[-1]
    packed.repartition(buckets, "block").write.bucketBy(buckets, "block").option("path", folder).option("compression", "none").saveAsTable(name)
    stored = spark.table(name)
    stored.schema  # noqa: B018 - resolves the files before the name goes
    spark.sql(f"DROP TABLE {name}")
    return stored


def remove_repeats(docs: DataFrame, length: int = 50, texts_out: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row, or ``kept`` (binary) instead of its digest."""
    if length < 2 * GRAM:
        raise ValueError(f"Windows have {2 * GRAM} bytes at least.")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = shuffle_partitions(docs.sparkSession)
    blocks = max(partitions, -(-total // BLOCK_BYTES))
    # Several blocks to a task and several ranges, so that tasks are even although both are dealt by a hash.
    ranges = max(partitions, -(-blocks // 2))
    packed = _packed(docs, blocks, max(partitions, -(-blocks // 4)))

    def grams_out(key, rows: pd.DataFrame) -> pd.DataFrame:
        return _frame(_send_grams(int(key[0]), *_opened(rows), length, ranges))

    def stretches_out(key, rows: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(replies):
            return _frame([])
        found = Stretches(*_opened(rows), length, ranges, replies)
        return _frame(_send_stretches(int(key[0]), found) + _send_on(int(key[0]), found, ranges))

    def hashes_out(key, rows: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not replies["c"].str.len().any():
            return _frame([])
        found = Stretches.unpacked(*_opened(rows), length, replies)
        crowded = _settle(found, replies[replies["kind"] == 4])[2]
        return _frame(_send_hashes(int(key[0]), Windows(found, crowded, length, ranges)) if crowded.any() else [])

    def windows_out(key, rows: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(replies):
            return _frame([])
        found = Stretches.unpacked(*_opened(rows), length, replies)
        _, is_open, crowded = _settle(found, replies[replies["kind"] == 4])
        sent = _send_windows(int(key[0]), found, is_open)
        if crowded.any():
            sent += _send_met(int(key[0]), Windows(found, crowded, length, ranges), replies[replies["kind"] == 8], length)
        return _frame(sent)

    def results(key, rows: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"order_id": [], "no_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept" if texts_out else "kept_sha256": []})
        ids, texts = _opened(rows)
        found = Stretches.unpacked(ids, texts, length, replies)
        made = _finish(ids, texts, found, replies, length, ranges)
        made.insert(1, "no_id", [none for _, none in sorted(zip(rows["order_id"].tolist(), rows["no_id"].tolist(), strict=True))])
        return made if texts_out else _spans(made)

    def by_block(told: DataFrame, use, schema: str) -> DataFrame:
        return packed.groupBy("block").cogroup(told.withColumnRenamed("to", "block").groupBy("block")).applyInPandas(use, schema)

    def by_range(sent: DataFrame, use) -> DataFrame:
        return checkpointed(sent.groupBy("to").applyInPandas(use, MESSAGE))

    repeated = by_range(packed.groupBy("block").applyInPandas(grams_out, MESSAGE), _repeated_grams)
    limit = CROWDED
    settled = by_range(by_block(repeated, stretches_out, MESSAGE), lambda key, rows: _least_documents(key, rows, limit))
    told = settled
    if not settled.filter("length(c) > 0").isEmpty():
        told = told.union(by_range(by_block(told, hashes_out, MESSAGE), _met_hashes))
    compared = by_range(by_block(told, windows_out, MESSAGE), lambda key, rows: _equal_windows(key, rows, length))
    last = "kept binary" if texts_out else "kept_sha256 string"
    done = by_block(told.union(compared), results, f"order_id long, no_id boolean, n_bytes long, n_removed long, n_spans long, {last}")
    doc_id = F.when(~F.col("no_id"), F.col("order_id")).cast(docs.schema["doc_id"].dataType).alias("doc_id")
    return done.select(doc_id, *done.columns[2:])
