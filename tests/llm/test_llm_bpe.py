import hashlib
import random

import numpy as np
import pytest
from fixtures import clashing, collected, empty_documents, odd_documents, odd_rows
from pyspark.sql import functions as F

from tablecheck.llm import bpe
from tablecheck.llm.queries import rank_file


@pytest.fixture(scope="module")
def codec():
    path, pattern = rank_file()
    with open(path, "rb") as file:
        return bpe.Codec(file.read(), pattern)


def test_pieces_change_no_ids(codec, monkeypatch):
    rng = random.Random(1)
    parts = ["a", " ", "\n", "  ", "'s", "é", "中", "1", "!", "\t", "\x85", "\x1c", "😀", "'", "Z9", " x", "don't"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 50)))
        monkeypatch.setattr(bpe, "PIECE", rng.choice([1, 2, 5, 9]))
        assert codec.encode(text).tolist() == codec.encoding.encode_ordinary(text), repr(text)


def test_heap_merges_like_the_library(codec, monkeypatch):
    monkeypatch.setattr(bpe, "LONG_MATCH", 2)
    for text in ("abcdefghijklmnop" * 20, "a" * 401, "ß中文字符" * 30, " the" * 9, "x"):
        assert codec.merge(text.encode()) == codec.encoding._encode_single_piece(text.encode())


@pytest.mark.parametrize("text", ["a" * 200_000, " " * 200_000, "中" * 50_000, " " * 90_000 + "x", "ab1!" * 40_000])
def test_long_runs_come_back(codec, text):
    assert codec.decode(codec.encode(text).tolist()) == text.encode()


def test_unknown_ids_decode_to_null(codec):
    assert codec.decode([0, 10**6]) is None
    assert codec.decode([]) == b""


@pytest.mark.parametrize("change", [lambda d: d, clashing])
def test_round_trip(spark, codec, change):
    found = collected(bpe.digests(bpe.round_trip(change(odd_documents(spark)), *rank_file())))
    expected = []
    for doc_id, text, *_ in odd_rows():
        ids = codec.encoding.encode_ordinary(text or "")
        expected.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert found == sorted(expected, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_columns_stay_and_empty_tables_pass(spark):
    docs = clashing(odd_documents(spark))
    encoded = bpe.encode_documents(docs, *rank_file())
    assert sorted(encoded.columns) == sorted(docs.columns)  # "ids" takes the place of the column of that name
    decoded = bpe.decode_documents(encoded, *rank_file())
    assert decoded.filter(F.coalesce("text", F.lit("")) != F.col("decoded").cast("string")).isEmpty()
    assert bpe.round_trip(empty_documents(spark), *rank_file()).isEmpty()
