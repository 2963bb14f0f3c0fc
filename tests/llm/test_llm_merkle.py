import hashlib
import zlib

import pytest
from fixtures import clashing, empty_documents, odd_documents, odd_rows
from pyspark.sql import functions as F

from tablecheck.llm import merkle, queries


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    doc_id, text, lang, source, n_chars = row
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def levels_of(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest("".join(last[i : i + fanout])) for i in range(0, len(last), fanout)])
    return levels


def sides(levels, place, fanout):
    for level in levels[:-1]:
        first = place // fanout * fanout
        yield "".join(level[first:place]), "".join(level[place + 1 : first + fanout])
        place //= fanout


def brute(rows, fanout=8):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of every row."""
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    names = sorted(trees, key=lambda v: (v is not None, (v or "").encode()))
    for name in names:
        trees[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    grown = {name: levels_of([leaf_of(r) for r in trees[name]], fanout) for name in names}
    above = levels_of([grown[name][-1][0] for name in names], fanout)
    out = []
    for k, name in enumerate(names):
        for place, row in enumerate(trees[name]):
            path = [*sides(grown[name], place, fanout), *sides(above, k, fanout)]
            changed = list(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[1] is not None:
                changed[1] = row[1].translate({c: c + 32 for c in range(65, 91)})
            folded = leaf_of(changed)
            for left, right in path:
                folded = digest(left + folded + right)
            root = above[-1][0]
            out.append((row[0], leaf_of(row), grown[name][-1][0], root, digest("".join(a + b for a, b in path)), folded, folded == root))
    return sorted(out, key=str)


def found(spark, docs, monkeypatch):
    monkeypatch.setattr(queries, "load", lambda *_: docs)
    rows = queries.op11_slot_merkle(spark, "")
    assert rows.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in rows.collect()), key=str)


@pytest.mark.parametrize("change", [lambda d: d, clashing])
def test_odd_rows(spark, change, monkeypatch):
    rows = [*odd_rows(), (None, "No id", "en", "s", 1), (None, None, None, None, None), (5, "Another TEXT of an id", "de", "s", None)]
    docs = change(spark.createDataFrame(rows, odd_documents(spark).schema))
    assert found(spark, docs, monkeypatch) == brute(rows)


@pytest.mark.parametrize("sizes", [[1], [1, 1], [8, 1], [9, 64], [65, 3, 1] + [1] * 9, [520]])
def test_trees_of_all_heights(spark, sizes, monkeypatch):
    rows = [(1000 * k + i, f"Text {i}", f"l{k}" if k else None, "s", i) for k, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, odd_documents(spark).schema).repartition(3)
    assert found(spark, docs, monkeypatch) == brute(rows)


def test_other_fanouts_and_an_empty_table(spark):
    rows = [(i, f"t{i}", "abc"[i % 3], "s", i) for i in range(40)]
    docs = spark.createDataFrame(rows, odd_documents(spark).schema)
    for fanout in (2, 5):
        made = merkle.manifest(docs, fanout=fanout)
        checked = made.filter(merkle.fold(F.col("leaf"), F.col("path")) == F.col("root"))
        expected = {(d, s, r, p) for d, _, s, r, p, _, _ in brute(rows, fanout)}
        assert {tuple(r) for r in checked.select("doc_id", "subroot", "root", merkle.proof(F.col("path"))).collect()} == expected
    assert merkle.manifest(empty_documents(spark)).isEmpty()
    with pytest.raises(ValueError, match="two children"):
        merkle.manifest(docs, fanout=1)
