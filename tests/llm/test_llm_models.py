import zlib
from collections import defaultdict

import numpy as np
import pytest
from fixtures import clashing, empty_documents, odd_documents, odd_rows

import __spark_entry__ as entry
import corpus_pipeline
from tablecheck.llm import bpe, mixing, near_duplicates, pii, quality_model, toxicity

BIG = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_gradients():
    """Back-propagation against small steps of every parameter."""
    net = toxicity.Network({"a": 1}, seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(3)
    steps = rng.normal(size=(3, 5, 6 * toxicity.HIDDEN))
    mask = np.array([[1, 1, 1, 1, 1], [1, 1, 0, 0, 0], [1, 1, 1, 1, 0]], dtype=bool)
    kept = {}
    net.logits(steps, mask, kept)
    slope = np.array([0.3, -0.2, 0.5])
    grads, d_steps = net.gradients(slope, kept)
    for name, grad in grads.items():
        flat = net.p[name].reshape(-1)
        for place in rng.integers(0, flat.size, 3):
            old, h = flat[place], 1e-3
            flat[place] = old + h
            up = float(slope @ net.logits(steps, mask))
            flat[place] = old - h
            down = float(slope @ net.logits(steps, mask))
            flat[place] = old
            assert grad.reshape(-1)[place] == pytest.approx((up - down) / (2 * h), rel=3e-2, abs=1e-3), name
    moved = steps.copy()
    moved[0, 2, 7] += 1e-2
    assert d_steps[0, 2, 7] == pytest.approx(float(slope @ (net.logits(moved, mask) - net.logits(steps, mask))) / 1e-2, rel=5e-2, abs=1e-3)


def test_windows_cover_all_words():
    for n in (0, 1, 31, 32, 33, 56, 57, 500):
        found = toxicity.windows(np.arange(1, n + 1))
        assert set(found.ravel()) - {0} == set(range(1, n + 1)) and len(found) >= 1


def test_toxicity_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    found = {r["doc_id"]: r for r in toxicity.score_documents(docs, labels).collect()}
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found.values())
    assert all(r["held_out"] == held_out(d) for d, r in found.items())
    test = [(found[r["doc_id"]]["score"], r["toxic"]) for r in labels.collect() if held_out(r["doc_id"])]
    toxic, clean = [s for s, y in test if y], [s for s, y in test if not y]
    ranked = np.mean([a > b for a in toxic for b in clean])
    assert ranked > 0.85 and np.mean([s < 0.5 for s in clean]) > 0.9


def test_toxicity_without_labels_and_of_odd_rows(spark):
    none = spark.createDataFrame([], LABELS)
    assert {r["score"] for r in toxicity.score_documents(odd_documents(spark), none).collect()} == {0.0}
    labels = spark.createDataFrame([(k, 1, int(k % 2)) for k in range(30)] + [(None, None, None)], LABELS)
    found = toxicity.score_documents(clashing(odd_documents(spark)), labels).collect()
    assert len(found) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in found)
    assert toxicity.score_documents(empty_documents(spark), labels).isEmpty()


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    found = {r["doc_id"]: r for r in quality_model.score_documents(docs, labels).collect()}
    assert len(found) == docs.count()
    test = [(found[r["doc_id"]]["kept"], r["quality"]) for r in labels.collect() if held_out(r["doc_id"])]
    assert np.mean([k == bool(y) for k, y in test]) > 0.95 and np.mean([k for k, y in test if y]) > 0.97


def test_sites_move_what_the_text_leaves_open(spark):
    """Two hosts of equal open texts; the rest of one host is good, of the other bad."""
    rng = np.random.default_rng(1)
    good = lambda: " ".join(rng.choice("the of and house river garden people with water stone".split(), 40))
    rows, labels = [], []
    for k in range(600):
        bad = k % 2
        rows.append((k, "$$$ *** " * 20 + good() if bad else good() + ".", "en", "low" if bad else "high", 0))
        labels.append((k, 1 - bad, 0))
    rows.append((9000, "the of", "en", "sole", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = {r["doc_id"]: r for r in quality_model.score_documents(docs, spark.createDataFrame(labels, LABELS)).collect()}
    assert found[0]["site_share"] > 0.9 and found[1]["site_share"] < 0.1
    assert 0.05 < found[9000]["site_share"] < 0.95  # one document: near the share of all


def test_quality_of_odd_rows(spark):
    none = spark.createDataFrame([], LABELS)
    docs = clashing(odd_documents(spark))
    assert quality_model.keep_good(docs, none).count() == len(odd_rows())  # no labels: nothing is rejected
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(30)] + [(None, None, None)], LABELS)
    assert quality_model.keep_good(docs, labels).columns == docs.columns
    assert quality_model.score_documents(docs, labels).count() == len(odd_rows())
    assert quality_model.score_documents(empty_documents(spark), labels).isEmpty()


def test_pipeline_against_a_plain_version(spark):
    """Each stage against what a plain loop over the same rows makes of them."""
    docs = spark.read.parquet(f"{BIG}/documents.parquet").filter("doc_id < 400")  # a small fixture: brute force is slow
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    good = corpus_pipeline.quality(spark, docs, BIG)
    kept = {r["doc_id"] for r in quality_model.score_documents(docs, labels).filter("kept").collect()}
    assert {tuple(r) for r in good.collect()} == {tuple(rows[d]) for d in kept} and good.columns == docs.columns

    single = corpus_pipeline.one_of_each(spark, good, BIG)
    ids = sorted(kept)
    sets = {d: near_duplicates.Shingler(5).hashes(rows[d]["text"]) for d in ids}
    root = {d: d for d in ids}
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            met = len(np.intersect1d(sets[a], sets[b]))
            if met and 100 * met >= 80 * (len(sets[a]) + len(sets[b]) - met):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {d: new if r == old else r for d, r in root.items()}
    left = {r["doc_id"] for r in single.collect()}
    assert left == {d for d in ids if root[d] == d}

    masked = {r["doc_id"]: r for r in corpus_pipeline.without_personal_data(spark, single, BIG).collect()}
    assert masked.keys() == left and all(r["text"] == pii.mask(rows[d]["text"]) and r["n_chars"] == len(r["text"]) for d, r in masked.items())

    table = spark.createDataFrame(list(masked.values()), docs.schema)
    mix = corpus_pipeline.mixed(spark, table, BIG)
    copies = defaultdict(int)
    for r in mix.collect():
        copies[r["doc_id"]] += 1
        assert tuple(r) == tuple(masked[r["doc_id"]])
    sizes = {d: len(r["text"].encode().split()) for d, r in masked.items()}
    source = {d: r["source"] for d, r in masked.items()}
    weight = mixing.cycle_weights(list(set(source.values())))
    of_source = {s: sum(n for d, n in sizes.items() if source[d] == s) for s in set(source.values())}
    wanted = mixing.targets(of_source, sum(sizes.values()), weight, 3)
    for s in of_source:
        taken = sum(copies[d] * n for d, n in sizes.items() if source[d] == s)
        assert abs(taken - wanted[s]) <= max(n for d, n in sizes.items() if source[d] == s)
    assert max(copies.values()) <= 3

    with open(corpus_pipeline.rank_file()[0], "rb") as file:
        codec = bpe.Codec(file.read(), corpus_pipeline.rank_file()[1])
    for r in corpus_pipeline.tokens(spark, mix, BIG).collect():
        assert codec.decode(r["ids"]) == masked[r["doc_id"]]["text"].encode() and r["n_tokens"] == len(r["ids"])


def test_stages_take_odd_rows(spark, tmp_path):
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(30)], LABELS)
    for name, docs in (("odd", odd_documents(spark)), ("empty", empty_documents(spark))):
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, f"{tmp_path}/{name}").columns == docs.columns
        corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()


def test_names():
    names = [n.split("_")[0] for n in entry.queries() if n.startswith("op")]
    assert sorted(names) == sorted(f"op{n}" for n in range(1, 11)) and "pipeline" in entry.queries()
