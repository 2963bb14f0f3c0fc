import hashlib
import random
import zlib

import numpy as np
import pytest
from fixtures import clashing, empty_documents, odd_documents, odd_rows

from tablecheck.llm import periodic_runs, queries


def brute_runs(words, min_length=6, exponent=4):
    """Every lag's matches by comparison of all words; a run counts once, by its smallest period."""
    found, n = {}, len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i) + 1
    return sorted((s, n, q) for (s, n), q in found.items())


@pytest.mark.parametrize("letters", [1, 2, 3])
def test_runs_of_random_words(letters):
    rng = random.Random(letters)
    for _ in range(700):
        words = []
        while len(words) < rng.randint(0, 150):
            block = [rng.randrange(letters) for _ in range(rng.randint(1, 25))]
            words += (block * rng.randint(1, 7))[: rng.randint(1, 90)]
        words = np.array(words, dtype=np.int64)
        assert periodic_runs.runs_of(words, len(words)) == brute_runs(words.tolist()), words.tolist()


@pytest.mark.parametrize("min_length, exponent", [(2, 3), (20, 4), (6, 5), (13, 3)])
def test_other_lengths_and_exponents(min_length, exponent):
    rng = random.Random(min_length)
    for _ in range(300):
        block = [rng.randrange(2) for _ in range(rng.randint(1, 12))]
        words = np.array([*(block * rng.randint(2, 8)), *[rng.randrange(2) for _ in range(30)]], dtype=np.int64)
        assert periodic_runs.runs_of(words, len(words), min_length, exponent) == brute_runs(words.tolist(), min_length, exponent)


def test_classes_hold_every_period_once():
    for min_length, exponent in ((6, 4), (2, 3), (40, 4)):
        classes = list(periodic_runs.period_classes(5000, min_length, exponent))
        assert [q for low, high, _ in classes for q in range(low, high + 1)][: 5000 // exponent] == list(range(1, 5000 // exponent + 1))[: sum(h - l + 1 for l, h, _ in classes)]
        for low, high, k in classes:
            assert k >= 2 * high - 2 and all(k <= max(min_length, exponent * q) - q for q in range(low, high + 1))


def test_pairs_grow_with_the_words_alone():
    words = np.zeros(200_000, dtype=np.int64)
    at, lag = periodic_runs.Grams(words).next_ones(5)
    assert len(at) == 200_000 - 5 and set(lag.tolist()) == {1}
    assert periodic_runs.runs_of(words, len(words)) == [(0, 200_000, 1)]


def expected(rows):
    for doc_id, text, *_ in rows:
        words, h = (text or "").encode().split(), zlib.crc32(str(doc_id).encode())
        if doc_id is not None and h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute_runs(words)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        told = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        yield (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(), len(words))


def key(row):
    return tuple((v is None, str(v)) for v in row)


@pytest.mark.parametrize("change", [lambda d: d, clashing])
def test_query(spark, change, monkeypatch):
    rng = random.Random(9)
    rows = [r for r in odd_rows() if len(r[1] or "") < 10_000 or r[1][1] == "a"]
    rows += [(100 + k, " ".join(rng.choice("ab") for _ in range(rng.randint(1, 120))) + "\n\n é", "en", "s", 0) for k in range(120)]
    rows += [(100 + k, " ".join(str(i) for i in range(k)), "en", "s", 0) for k in range(120)]
    rows += [(None, "a b " * 9, "en", "s", 0), (7, "x " * 700, "en", "s", 0)]
    monkeypatch.setattr(queries, "load", lambda *_: change(spark.createDataFrame(rows, odd_documents(spark).schema)))
    assert sorted((tuple(r) for r in queries.op13_diagonal_runs(spark, "").collect()), key=key) == sorted(expected(rows), key=key)


def test_batches_of_many_texts(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "BATCH_WORDS", 50)
    texts = ["a b c " * n for n in range(30)] + [None, "", "z " * 400]
    for (n, runs, left), text in zip(periodic_runs.runs_of_texts(texts, 6, 4), texts, strict=True):
        words = (text or "").split()
        assert n == len(words) and runs == brute_runs(words) and len(left.split()) == n - sum(m - q for _, m, q in runs)
    assert periodic_runs.find_runs(empty_documents(spark)).isEmpty()
