"""Byte-level BPE with the tiktoken library: whole texts to ids, ids to raw bytes.

The rank file is read once on the driver and broadcast: its size is that of the vocabulary (under 1 MB for 50,000 ids), whatever the
data. Every match of the split pattern is merged on its own, so a long text may be cut wherever no match can reach across. A blank
after a visible character is such a place: no alternative of the pattern continues from visible characters into blanks, and what
follows the blank does not look back. Texts are encoded in pieces that end there, which bounds the memory and the stack that the
library's own pattern matcher needs. A run without any such place is split by the ``regex`` module instead, and a single match that is
very long is merged with a heap, in n log n steps.

Results: null text has no ids (an empty array) in ``encode``; null ids decode to null, and so do ids outside the vocabulary.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructType

from tablecheck.llm.common import map_slices, schema_with, with_column

#: Characters of a piece that is given to the library at once.
PIECE = 16_384
#: Bytes of a single match from which on it is merged with a heap.
LONG_MATCH = 2_000

_codecs: dict[str, "Codec"] = {}


class Codec:
    """Ranks and pattern, ready to encode and decode."""

    def __init__(self, ranks_file: bytes, pattern: str):
        import regex
        import tiktoken

        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks_file.splitlines()) if token}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.matches = regex.compile(pattern)
        self.tokens = {rank: token for token, rank in self.ranks.items()}

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= PIECE:
            return np.asarray(self.encoding.encode_ordinary(text), dtype=np.int32)
        ids: list[int] = []
        for piece in pieces(text):
            if len(piece) <= PIECE:
                ids.extend(self.encoding.encode_ordinary(piece))
            else:
                for match in self.matches.finditer(piece):
                    ids.extend(self.merge(match.group().encode("utf-8", "replace")))
        return np.asarray(ids, dtype=np.int32)

    def merge(self, match: bytes) -> list[int]:
        """Ids of one match: always the pair of least rank first, the leftmost of equals."""
        if match in self.ranks:
            return [self.ranks[match]]
        if len(match) < LONG_MATCH:
            return self.encoding._encode_single_piece(match)
        size, rank_of = len(match), self.ranks.get
        end = list(range(1, size + 1))  # where the part that starts at i ends
        before = list(range(-1, size - 1))
        alive = [True] * size
        heap = [(r, i, i + 2) for i in range(size - 1) if (r := rank_of(match[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not alive[i] or j >= size or end[j] != stop:
                continue
            alive[j], end[i] = False, stop
            if stop < size:
                before[stop] = i
                if (r := rank_of(match[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (k := before[i]) >= 0 and (r := rank_of(match[k:stop])) is not None:
                heapq.heappush(heap, (r, k, stop))
        return [self.ranks[match[i : end[i]]] for i in range(size) if alive[i]]

    def decode(self, ids: list[int]) -> bytes | None:
        try:
            return b"".join([self.tokens[i] for i in ids])
        except KeyError:
            return None


def pieces(text: str) -> Iterator[str]:
    """Parts of a text that end before a blank which follows a visible character."""
    start, size = 0, len(text)
    while size - start > PIECE:
        cut = start + PIECE
        while cut > start and not (text[cut] in " \n" and not text[cut - 1].isspace()):
            cut -= 1
        if cut <= start:
            cut = start + PIECE + 1
            while cut < size and not (text[cut] in " \n" and not text[cut - 1].isspace()):
                cut += 1
        yield text[start:cut]
        start = cut
    if start < size:
        yield text[start:]


def codec(ranks_file: bytes, pattern: str) -> Codec:
    """One codec for each rank file and pattern in a Python process."""
    key = hashlib.sha256(ranks_file + pattern.encode()).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(ranks_file, pattern)
    return _codecs[key]


def _shared_codec(spark: SparkSession, path: str, pattern: str):
    """The rank file's bytes and the pattern, sent to the executors once."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast((file.read(), pattern))


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of the documents, and the ids of the text in ``ids`` (which replaces a column of that name).

    ``path``: the rank file, on the driver.
    """
    shared = _shared_codec(docs.sparkSession, path, pattern)

    def start():
        encode = codec(*shared.value).encode
        return lambda b: with_column(b, ids, pa.array([encode(t or "") for t in b.column(text).to_pylist()], pa.list_(pa.int32())))

    return map_slices(docs, start, schema_with(docs, ids, ArrayType(IntegerType())))


def decode_documents(rows: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """All columns of the rows, and the bytes that the ids stand for in ``decoded``."""
    shared = _shared_codec(rows.sparkSession, path, pattern)

    def start():
        decode = codec(*shared.value).decode
        return lambda b: with_column(b, decoded, pa.array([None if x is None else decode(x) for x in b.column(ids).to_pylist()], pa.binary()))

    return map_slices(rows, start, schema_with(rows, decoded, BinaryType()))


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, packed, decoded): the ids of every text as unsigned 32-bit integers, least byte first, and the bytes that
    they decode to. One pass, so that no second Python process holds the same texts."""
    shared = _shared_codec(docs.sparkSession, path, pattern)

    def start():
        own = codec(*shared.value)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [own.encode(t or "") for t in batch.column("text").to_pylist()]
            columns = [batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64())]
            columns += [pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array([own.decode(x.tolist()) for x in ids], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "packed", "decoded"])

        return work

    kinds = StructType([docs.schema["doc_id"]]).add("n_tokens", LongType()).add("packed", BinaryType()).add("decoded", BinaryType())
    return map_slices(docs.select("doc_id", "text"), start, kinds)


def digests(trip: DataFrame) -> DataFrame:
    """Per document: the number of ids, and SHA-256 of the ids and of the decoded bytes."""
    return trip.select("doc_id", "n_tokens", F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
