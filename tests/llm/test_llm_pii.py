import random
import re

import pytest
from fixtures import clashing, empty_documents, odd_documents
from pyspark.sql import functions as F

from tablecheck.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def by_patterns(text):
    for kind, pattern in PATTERNS.items():
        for match in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", match.group())
            fits = {
                "email": True,
                "ip": kind != "ip" or all(int(p) <= 255 for p in match.group().split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }
            if fits[kind]:
                yield kind, *match.span()


def test_plain_is_what_the_patterns_say():
    rng = random.Random(2)
    parts = [*"ab.@%+- ()0123456789\n", "@x.y", "192.168.1.1", "4111111111111111", "+1 555 123 4567", "0999", "é"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert sorted(pii.plain(text)) == sorted(by_patterns(text)), repr(text)


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail joe [at] example [dot] com now", "email", "joe [at] example [dot] com"),
        ("write joe at example dot com please", "email", "joe at example dot com"),
        ("john dot smith at mail dot example dot org!", "email", "john dot smith at mail dot example dot org"),
        ("jоe@example.com", "email", "jоe@example.com"),
        ("joe＠example．com", "email", "joe＠example．com"),
        ("joe(at)ex.com", "email", "joe(at)ex.com"),
        ("plus one two one two five five five one two one two", "phone", "plus one two one two five five five one two one two"),
        ("ip １９２.168.0.1 x", "ip", "１９２.168.0.1"),
        ("one nine two dot one six eight dot zero dot one", "ip", "one nine two dot one six eight dot zero dot one"),
        ("card 41​11111111111111 x", "card", "41​11111111111111"),
        ("vier eins eins eins eins eins eins eins eins eins eins eins eins eins eins eins", "card", "vier" + " eins" * 15),
    ],
)
def test_disguises(text, kind, found):
    spans = [(s["kind"], text[s["start"] : s["end"]]) for s in pii.find(text) if s["disguised"]]
    assert spans == [(kind, found)]


@pytest.mark.parametrize("text", ["look at the dot com era", "we met at noon", "one two three go", "point de vue", "the house (at) night"])
def test_plain_prose_is_left_alone(text):
    assert pii.find(text) == []


def test_mask():
    assert pii.mask("a joe@x.org, 10.0.0.1 b") == "a [EMAIL], [IP] b"
    assert pii.mask("jоe@example.com!") == "[EMAIL]!"


@pytest.mark.parametrize("text", ["1" * 300_000, "a" * 300_000 + "@", "1." * 100_000, "@" * 100_000, "one two " * 30_000, "+" + " " * 200_000, "[ at " * 30_000])
def test_long_runs_end(text):
    pii.find(text)


def test_documents(spark):
    docs = clashing(odd_documents(spark)).withColumn("text", F.concat(F.lit("x@y.org 😀 "), "text"))
    found = {(r["doc_id"], r["n_email"], r["spans"]) for r in pii.digests(pii.find_personal_data(docs)).collect()}
    assert (0, 0, "") in found and (3, 1, "email:0:7") in found
    masked = pii.mask_documents(docs)
    assert masked.columns == docs.columns and masked.filter("text LIKE '%@%'").isEmpty()
    assert masked.filter("text IS NULL").count() == 1
    assert pii.find_personal_data(empty_documents(spark)).isEmpty()


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("bob [  at  ] example.com", "email"),
        ("bob (chez) example.com", "email"),
        ("bob<@>example.com", "email"),
        ("bob[ @ ]example.com", "email"),
        ("bob ＠ example.com", "email"),
        ("4111 1111 1111 111 one", "card"),
        ("4111 1111 one 111 1111", "card"),
        ("+1 five 5 5 five 1 2 3 4 5 6", "phone"),
        ("plus 4 9 1 2 3 4 5 6 7 8", "phone"),
        ("192.168.one.1", "ip"),
    ],
)
def test_single_disguises_are_found(text, kind):
    found = [(x["kind"], x["start"], x["end"]) for x in pii.find(f"see {text}, please")]
    assert (kind, 4, 4 + len(text)) in found


def test_the_filter_drops_no_spans(monkeypatch):
    rng = random.Random(12)
    units = ["one", "un", "5", "12", "4111 1111 1111 111", "1", "+", ".", ",", "-", "(", ")", "[", "]", "@", "at", "dot", "plus", "point", "bob", "example.com", "＠", "о", "​", "the", "<", ">"]
    texts = ["".join(rng.choice(units) + rng.choice(["", " ", " ", "  ", "\n"]) for _ in range(rng.randint(3, 25))) for _ in range(4000)]
    found = [pii.find(t) for t in texts]
    assert 50 < sum(any(x["disguised"] for x in f) for f in found)
    monkeypatch.setattr(pii, "is_suspect", lambda _: True)
    for text, f in zip(texts, found, strict=True):
        assert pii.find(text) == f, repr(text)
