import hashlib
import json
import random

import numpy as np
import pytest
from fixtures import clashing, collected, empty_documents, odd_documents, odd_rows

from tablecheck.llm import tree_bpe


@pytest.fixture(scope="module")
def spec():
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as file:
        return file.read()


@pytest.fixture(scope="module")
def own(spec):
    return tree_bpe.codec(spec)


def joined(own, text):
    return np.frombuffer(own.encode([text])[0], "<u4").tolist()


def plain(own, text):
    return own.whole.encode(text, add_special_tokens=False).ids


UNITS = ["a", "b", "the ", " ", "\n", "'s", "'", "ll", "'LL", "é", "e", "́", "中", "1", "!", "\t", "\x85", "\x1c", "😀", "<|endoftext|>", "<|", "STARTOFTEXT|>", "<|STARTOFTEXT|>", "ing"]
UNITS += ["İ", "ß", "한국", "ᄒ", "ᅡ", "ṣ", "̇", "!!!!!!", "aaaaaaaaaaaaaa", "   "]


@pytest.mark.parametrize("part", [3, 40, 400])
def test_joins_change_no_ids(own, part, monkeypatch):
    rng = random.Random(part)
    for n in range(500):
        few = rng.sample(UNITS, rng.randint(1, 6)) if n % 2 else UNITS
        text = "".join(rng.choice(few) for _ in range(rng.randint(0, 60 * (1 + n % 7))))
        monkeypatch.setattr(tree_bpe, "PART", part)
        monkeypatch.setattr(tree_bpe, "SHORT_WORD", rng.choice([0, 8, 64]))
        assert joined(own, text) == plain(own, text), repr(text)


def test_long_words_are_joined_from_their_sides(own, monkeypatch):
    rng = random.Random(2)
    for text in ("a" * 70_000, "abcdefghij" * 7_000, "".join(rng.choice("etaoinshr") for _ in range(70_000)), "!" * 70_001, "中文字符" * 17_000, " " * 70_000 + "x"):
        sizes = []
        inner = own._joined_word
        with monkeypatch.context() as patch:
            patch.setattr(own, "_joined_word", lambda mapped, one, two, use=inner: sizes.append(len(mapped)) or use(mapped, one, two))
            assert joined(own, text) == plain(own, text)
        assert (len(sizes) == 7) == (" " not in text)  # eight parts


def expected(own, rows):
    for doc_id, text, *_ in rows:
        ids = plain(own, text or "")
        yield doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest()


@pytest.mark.parametrize("change", [lambda d: d, clashing])
@pytest.mark.parametrize("spread", [10, 1 << 20])
def test_round_trip(spark, own, spread, change, monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(tree_bpe, "SPREAD", spread)
    rows = [*odd_rows(), (None, "a " * 20_000 + "<|endoftext|>", "en", "s", 1), (None, "a " * 20_000 + "<|endoftext|>", "en", "s", 1), (3, "b" * 40_000, None, None, None)]
    docs = change(spark.createDataFrame(rows, odd_documents(spark).schema))
    found = collected(tree_bpe.digests(tree_bpe.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))))
    assert found == sorted(expected(own, rows), key=lambda r: tuple((v is None, str(v)) for v in r))


def test_plain_characters_are_normalised_as_by_the_library(own):
    assert own.knows_normal
    rng = random.Random(7)
    units = [chr(c) for c in range(0x300)] + ["  ", "\r\n", "Straße", "\u2026", "€"]
    for _ in range(300):
        text = "".join(rng.choice(units) for _ in range(80))
        assert tree_bpe._normal(text) == own.whole.normalizer.normalize_str(text)


def test_kept_stretches_are_given_up(own, monkeypatch):
    monkeypatch.setattr(tree_bpe, "KEPT", 5)
    for k in range(20):
        texts = [f"w{k} w{k + 1} {'long' * 40} x", f"w{k}"]
        assert [joined(own, t) for t in texts] == [plain(own, t) for t in texts]
    assert len(own.kept) < 20


def test_empty_table(spark):
    import public_tokenizers

    assert tree_bpe.round_trip(empty_documents(spark), public_tokenizers.path("word_bpe_49k.json")).isEmpty()


@pytest.mark.parametrize("change", [{"model": {"type": "Unigram"}}, {"split": r"\S+(?!x)"}, {"split": r"\s+\d"}, {"level": {"add_prefix_space": True}}, {"token": {"lstrip": True}}])
def test_files_that_cannot_be_joined_are_refused(spec, change):
    told = json.loads(spec)
    told["model"] |= change.get("model", {})
    split, level = told["pre_tokenizer"]["pretokenizers"]
    split["pattern"]["Regex"] = change.get("split", split["pattern"]["Regex"])
    level |= change.get("level", {})
    told["added_tokens"][0] |= change.get("token", {})
    with pytest.raises(ValueError):
        tree_bpe._look_ahead(told)
