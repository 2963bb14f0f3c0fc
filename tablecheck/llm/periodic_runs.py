"""Stretches of a text that repeat with a period: seeds of equal word grams, extended along diagonals.

A run is a stretch of words with smallest period q that goes on for at least ``exponent`` times q (and ``min_length`` words), and that no neighbouring word
extends. Inside it every word equals the one q words later, so on the diagonal of lag q lies a match of length - q words.

Periods are taken in classes from ``low`` to ``high``, and every run of a class holds a match of at least k words, the guaranteed overlap: the grams of k words are
indexed, and a gram that comes again q words later within the same document is a seed. ``high`` is chosen such that k is 2 * high - 2 or
more. Then the next occurrence of a gram of a run is exactly one period away (a nearer one would give the gram two periods, and with
them their greatest common divisor, which would be a smaller period of the run). So each occurrence is paired with the next one alone, and pairs
grow with the words, even where one word fills a document.

Seeds are extended to both sides. For each lag a table holds how far its diagonal is covered; seeds before that place are in a run that
is already known. Grams get exact numbers, by pairing those of half their length; grams that a document has only once drop out and are never
looked at again. Many documents are worked on as one array, in which words of unlike documents have unlike numbers.

Results: null and blank texts have no words and no runs. Words are compared by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from tablecheck.llm.common import map_slices

#: Words that are worked on at once, but for single texts that are longer.
BATCH_WORDS = 400_000

RUN = StructType().add("start", LongType()).add("length", LongType()).add("period", LongType())


def period_classes(longest: int, min_length: int, exponent: int) -> Iterator[tuple[int, int, int]]:
    """(low, high, k): classes of periods that runs of up to so many words can have, and the words that their matches have at least."""

    def overlap(q: int) -> int:
        return max(min_length, exponent * q) - q

    low = 1
    while max(min_length, exponent * low) <= longest:
        high, k = low, overlap(low)
        if exponent * low >= min_length:  # longer periods overlap more
            high = max(high, (k + 2) // 2)
        else:
            while (least := min(k, overlap(high + 1))) >= 2 * high:
                high, k = high + 1, least
        yield low, high, k
        low = high + 1


class Grams:
    """Numbers of the grams of 1, 2, 4, ... words at each place; -1 for grams that come only once."""

    def __init__(self, words: np.ndarray):
        self.size = len(words)
        _, place, counts = np.unique(words, return_inverse=True, return_counts=True)
        self.names = [np.where(counts[place] > 1, place, -1)]
        self.alive = np.flatnonzero(self.names[0] >= 0)

    def _double(self) -> None:
        names, half = self.names[-1], 1 << (len(self.names) - 1)
        at = self.alive[self.alive + half < self.size]
        at = at[names[at + half] >= 0]
        made = np.full(self.size, -1, dtype=np.int64)
        _, place, counts = np.unique(names[at] * self.size + names[at + half], return_inverse=True, return_counts=True)
        again = counts[place] > 1
        self.alive = at[again]
        made[self.alive] = place[again]
        self.names.append(made)

    def next_ones(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places whose gram of k words comes again, and the lag to its next occurrence. ``k`` must not fall from call to call."""
        while 2 << (len(self.names) - 1) <= k:
            self._double()
        names, rest = self.names[-1], k - (1 << (len(self.names) - 1))
        at = self.alive[self.alive + rest < self.size]
        at = at[names[at + rest] >= 0]
        key = names[at] * self.size + names[at + rest]
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        same = np.flatnonzero(key[1:] == key[:-1])
        return at[same], at[same + 1] - at[same]


def _match(words: np.ndarray, left: int, right: int, lag: int) -> tuple[int, int]:
    """The whole match on the diagonal around places left to right, which are known to match."""
    step, limit = 16, len(words) - lag
    while right < limit:
        other = words[right : min(right + step, limit)] != words[right + lag : min(right + step, limit) + lag]
        if other.any():
            right += int(other.argmax())
            break
        right, step = right + len(other), 2 * step
    step = 16
    while left > 0:
        first = max(0, left - step)
        other = words[first:left] != words[first + lag : left + lag]
        if other.any():
            left -= int(other[::-1].argmax())
            break
        left, step = first, 2 * step
    return left, right


def runs_of(words: np.ndarray, longest: int, min_length: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in an array of word numbers; ``longest`` bounds the length of a run."""
    if exponent < 3 or min_length < 2:
        raise ValueError("Runs go on for at least three periods and two words.")
    found, grams, covered = [], Grams(words), {}
    for low, high, k in sorted(period_classes(longest, min_length, exponent), key=lambda c: c[2]):
        at, lag = grams.next_ones(k)
        if not len(grams.alive):
            break
        fits = (lag >= low) & (lag <= high)
        at, lag = at[fits], lag[fits]
        order = np.lexsort((at, lag))
        at, lag = at[order], lag[order]
        # A seed right behind another one of its lag is in the same match.
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = (lag[1:] != lag[:-1]) | (at[1:] != at[:-1] + 1)
        for place, q in zip(at[fresh].tolist(), lag[fresh].tolist(), strict=True):
            if place < covered.get(q, 0):
                continue
            left, right = _match(words, place, place + k, q)
            covered[q] = right
            if right - left + q >= max(min_length, exponent * q):
                found.append((left, right - left + q, q))
    return sorted(found)


def _batches(texts: list[str | None]) -> Iterator[list[list[bytes]]]:
    batch, size = [], 0
    for text in texts:
        words = (text or "").encode("utf-8", "replace").split()
        if batch and size + len(words) > BATCH_WORDS:
            yield batch
            batch, size = [], 0
        batch.append(words)
        size += len(words)
    if batch:
        yield batch


def runs_of_texts(texts: list[str | None], min_length: int, exponent: int) -> Iterator[tuple[int, list[tuple[int, int, int]], str]]:
    """Of each text: the number of words, its runs, and the words that stay if only the first period of each run does."""
    for batch in _batches(texts):
        sizes = np.array([len(words) for words in batch], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        numbers: list[int] = []
        for k, words in enumerate(batch):
            known: dict[bytes, int] = {}
            base = int(starts[k])  # numbers are below the next text's
            numbers.extend([base + known.setdefault(w, len(known)) for w in words])
        runs = runs_of(np.array(numbers, dtype=np.int64), int(sizes.max()), min_length, exponent)
        owner = np.searchsorted(starts + sizes, [r[0] for r in runs], side="right")
        own: dict[int, list[tuple[int, int, int]]] = {}
        for k, (start, length, period) in zip(owner.tolist(), runs, strict=True):
            own.setdefault(k, []).append((start - int(starts[k]), length, period))
        for k, words in enumerate(batch):
            mine = own.get(k, [])
            yield len(words), mine, b" ".join(collapsed(words, mine) if mine else words).decode("utf-8")


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def find_runs(docs: DataFrame, min_length: int = 6, exponent: int = 4) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: runs as (start, length, period) by start, then period, and the text
    with one period of each run left, its words joined by blanks."""

    def start():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = list(runs_of_texts(batch.column("text").to_pylist(), min_length, exponent))
            kinds = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
            sizes = np.cumsum([0, *[len(runs) for _, runs, _ in made]])
            flat = np.array([r for _, runs, _ in made for r in runs], dtype=np.int64).reshape(-1, 3)
            items = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(kinds))
            columns = [batch.column("doc_id"), pa.array([n for n, _, _ in made], pa.int64()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), items), pa.array([c for _, _, c in made], pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

        return work

    kinds = StructType([docs.schema["doc_id"]]).add("n_words", LongType()).add("runs", ArrayType(RUN)).add("collapsed", StringType())
    return map_slices(docs.select("doc_id", "text"), start, kinds)
