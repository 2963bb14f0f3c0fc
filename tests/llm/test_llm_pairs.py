import hashlib
import random
import tracemalloc

import numpy as np
import pytest
from fixtures import clashing, empty_documents, odd_documents, odd_rows
from pyspark.sql import functions as F

from tablecheck.llm import near_duplicates, nearest, queries, repeated_passages

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def edited(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def near_rows():
    """Families of near copies around the threshold, a line in all documents, many copies, unrelated texts of few words."""
    rng = random.Random(8)
    vocabulary = [f"v{k}" for k in range(60)]
    texts = []
    for size in (8, 30, 120, 400, 1500):
        base = [rng.choice(vocabulary) for _ in range(size)]
        texts += [edited(rng, base, rng.randrange(0, max(2, size // 9))) for _ in range(25)]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    base = [f"h{k}" for k in range(140)]
    texts += [edited(rng, base, rng.randrange(0, 14)) for _ in range(300)]  # one long list, links at the threshold
    texts = ["all documents begin with these words here " * (k % 2) + t for k, t in enumerate(texts)]
    texts += [texts[3]] * 50 + [texts[3].upper(), None, "", " "]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return [(d, t, "en", "s", 0) for d, t in zip(ids, texts, strict=True)]


def brute_components(rows, shingle):
    sets = {}
    for doc_id, text, *_ in rows:
        words = (text or "").encode().lower().split()
        sets[doc_id] = {tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            one, two = sets[a], sets[b]
            if one and two and min(len(one), len(two)) >= 0.8 * max(len(one), len(two)) and 100 * len(one & two) >= 80 * len(one | two):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {(d, len(sets[d]), root(d)) for d in ids}


@pytest.mark.parametrize("shingle", [2, 5])
def test_near_duplicates(spark, shingle, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 64)
    rows = near_rows()
    docs = clashing(spark.createDataFrame(rows, DOCS))
    found = near_duplicates.near_duplicates(docs, shingle, 80).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in found} == brute_components(rows, shingle) and len(found) == len(rows)


def test_near_duplicates_of_odd_rows(spark):
    docs = odd_documents(spark)
    found = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates.near_duplicates(docs, 2, 80).collect()}
    assert found == brute_components(odd_rows(), 2)
    kept = near_duplicates.keep_first(clashing(docs), 2, 80)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in found})
    assert near_duplicates.near_duplicates(empty_documents(spark), 2, 80).isEmpty() and near_duplicates.keep_first(empty_documents(spark)).isEmpty()


def copies_without_ids():
    """Copies and near copies of which some or all have no id, or an id that another text has as well."""
    words = {t: [f"{t}{k}" for k in range(300)] for t in "abcde"}
    text = {t: " ".join(w) for t, w in words.items()}
    near = {t: " ".join([*w[:-3], "x", "y", "z"]) for t, w in words.items()}
    rows = [(None, text["a"]), (7, text["a"]), (None, near["a"]), (9, near["a"])]  # component 7
    rows += [(None, text["b"]), (None, text["b"].upper()), (None, near["b"])]  # no id at all
    rows += [(None, text["c"]), (20, near["c"])]  # component 20
    rows += [(30, text["d"]), (30, text["e"]), (31, near["d"]), (32, near["e"])]  # two components of one name
    rows += [(None, None), (None, " "), (40, "")]
    return [(d, t, "en", "s", 0) for d, t in rows]


@pytest.mark.parametrize("few", [100_000, 0])
def test_near_duplicates_without_ids(spark, few, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BROADCAST_IDS", few)
    found = near_duplicates.near_duplicates(spark.createDataFrame(copies_without_ids(), DOCS), 5, 80).collect()
    pairs = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in found if r["n_shingles"])
    named = [("20", "20", True), ("30", "30", True), ("30", "30", True), ("31", "30", False), ("32", "30", False), ("7", "7", True), ("9", "7", False)]
    assert pairs == sorted([*named, *[("None", "7", False)] * 2, ("None", "20", False), ("None", "None", True), *[("None", "None", False)] * 2])
    blank = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in found if not r["n_shingles"])
    assert blank == [("40", "40", True), ("None", "None", True), ("None", "None", True)]


def test_repeated_ids_go_only_with_equal_or_linked_texts(spark):
    rows = copies_without_ids()
    more = [(7, rows[0][1]), (50, "one text"), (50, "another text"), (50, "One  text"), (40, " "), (None, "third text"), (None, "fourth text")]
    rows += [(d, t, "en", "s", 0) for d, t in more]
    kept = near_duplicates.keep_first(clashing(spark.createDataFrame(rows, DOCS)), 5, 80).select("doc_id", "text").collect()
    a, b, c, d, e = rows[0][1], rows[5][1], rows[8][1], rows[9][1], rows[10][1]
    expected = [(7, a), (20, c), (30, d), (30, e), (None, None), (None, " "), (40, ""), (50, "One  text"), (50, "another text"), (None, "third text"), (None, "fourth text")]
    found = [tuple(r) for r in kept]
    own = [r for r in found if r[0] is None and r[1] in (b, rows[4][1], rows[6][1])]  # no id at all
    assert len(own) == 1 and sorted(map(str, found)) == sorted(map(str, [*expected, *own]))
    if own[0][1] != rows[6][1]:
        assert own == [(None, b)]  # the first text of the class


@pytest.mark.parametrize("percent, shared", [(55, 284), (95, 390)])
def test_large_sets_at_other_thresholds(spark, percent, shared):
    rows = []
    for k in range(40):
        words = [f"{k}w{i}" for i in range(shared)]
        for side in "ab":
            rows.append((len(rows), " ".join([*words, *[f"{k}{side}{i}" for i in range(400 - shared)]]), "en", "s", 0))
    found = near_duplicates.near_duplicates(spark.createDataFrame(rows, DOCS), 1, percent).collect()
    assert 100 * shared >= percent * (800 - shared)
    assert {r["doc_id"]: r["component_id"] for r in found} == {r[0]: r[0] // 2 * 2 for r in rows}


def test_least_shared_values():
    assert [near_duplicates.least_shared(p) for p in (51, 80, 99)] == [15, 36, 58]


def test_kept_of_the_query_is_that_of_the_contract(spark, monkeypatch):
    rows = [(1, "same text", "en", "s", 0), (1, "same text", "en", "s", 0), (2, " ", "en", "s", 0), (2, "", "en", "s", 0), (3, "Same Text", "en", "s", 0), (None, None, "en", "s", 0)]
    monkeypatch.setattr(queries, "load", lambda *_: spark.createDataFrame(rows, DOCS))
    found = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in queries.op7_bottom_k_near_duplicates(spark, "").collect())
    assert found == sorted([("1", "1", True)] * 2 + [("2", "2", True)] * 2 + [("3", "1", False), ("None", "None", True)])


def test_components_of_a_long_path(spark):
    path = [(k, k + 1) for k in range(200)] + [(500, 501), (501, 500)]
    found = near_duplicates.components(spark.createDataFrame(path, "a long, b long")).collect()
    assert len({r["label"] for r in found if r["node"] <= 200}) == 1 and len({r["label"] for r in found}) == 2 and len(found) == 203


def brute_repeats(rows, length):
    out = {}
    seen, ids = set(), sorted({r[0] for r in rows}, key=lambda d: (d is None, d))
    for doc_id in ids:
        mine = set()
        for _, text, *_ in (r for r in rows if r[0] == doc_id):
            data = (text or "").encode()
            gone = np.zeros(len(data), bool)
            for i in range(len(data) - length + 1):
                window = data[i : i + length]
                mine.add(window)
                if window in seen:
                    gone[i : i + length] = True
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
            out[doc_id] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
        seen |= mine
    return out


def passage_rows():
    rng = random.Random(4)
    letters = "abcdeé 中\n"
    passages = ["".join(rng.choice(letters) for _ in range(n)) for n in (30, 49, 50, 51, 80, 300)]
    rows = []
    for k in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.4 else "".join(rng.choice(letters) for _ in range(rng.randrange(0, 90))) for _ in range(rng.randrange(1, 9))]
        rows.append((k * 7 % 120, "".join(parts), "en", "s", 0))
    rows += [(500 + k, rows[5][1], "en", "s", 0) for k in range(40)]
    rows += [(600, "ab" * 400, "en", "s", 0), (601, "ab" * 90 + "c" + "ba" * 60, "en", "s", 0), (602, "z" * 5000, "en", "s", 0), (603, "z" * 49, "en", "s", 0), (604, "z" * 60, "en", "s", 0)]
    return rows


@pytest.mark.parametrize("piece", [1 << 20, 1 << 8])
def test_repeats(spark, monkeypatch, piece):
    rows = [*passage_rows(), *[(1000 + r[0], *r[1:]) for r in odd_rows()]]
    docs = clashing(spark.createDataFrame(rows, DOCS))
    monkeypatch.setattr(repeated_passages, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(repeated_passages, "PIECE", piece)
    monkeypatch.setattr(repeated_passages, "_PLACE", np.uint64(piece - 1))
    if piece < 1 << 20:  # here, as workers have their own module: long texts in many pieces
        found = repeated_passages.Block([r[1].encode() for r in rows if r[1]], 50)
        covered = sum(int(x) for x in found.last - found.first + 1)
        assert covered == sum(max(0, len(r[1].encode()) - 49) for r in rows if r[1])
        return
    found = repeated_passages.remove_repeats(docs, 50).collect()
    expected = brute_repeats(rows, 50)
    assert len(found) == len(rows)
    for r in found:
        assert tuple(r)[1:] == expected[r["doc_id"]], r["doc_id"]


@pytest.mark.parametrize("limit", [1, 3])
def test_repeats_dealt_by_window(spark, monkeypatch, limit):
    rows = [*passage_rows(), *[(1000 + r[0], *r[1:]) for r in odd_rows()]]
    monkeypatch.setattr(repeated_passages, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(repeated_passages, "CROWDED", limit)
    found = repeated_passages.remove_repeats(spark.createDataFrame(rows, DOCS), 50).collect()
    expected = brute_repeats(rows, 50)
    assert len(found) == len(rows)
    for r in found:
        assert tuple(r)[1:] == expected[r["doc_id"]], r["doc_id"]


def test_edges_of_a_common_passage_do_not_meet_in_one_range(spark, monkeypatch):
    rng = random.Random(6)
    words = lambda n: " ".join(f"{rng.randrange(10**9):x}" for _ in range(n))
    passage = words(30)
    rows = [(k, f"{words(20)} {passage} {words(20)}", "en", "s", 0) for k in range(2000)]
    monkeypatch.setattr(repeated_passages, "BLOCK_BYTES", 1 << 16)
    monkeypatch.setattr(repeated_passages, "CROWDED", 100)
    sent = []
    checkpoint = repeated_passages.checkpointed

    def watched(df):
        kept = checkpoint(df)
        sent.append(kept.groupBy("sender", "kind").agg(F.sum(F.length("a")).alias("bits")).filter("kind in (6, 10)").collect())
        return kept

    monkeypatch.setattr(repeated_passages, "checkpointed", watched)
    found = repeated_passages.remove_repeats(spark.createDataFrame(rows, DOCS), 50).collect()
    expected = brute_repeats(rows, 50)
    assert all(tuple(r)[1:] == expected[r["doc_id"]] for r in found) and len(found) == len(rows)
    # Replies are bits of windows; before, each edge gram had those of 2000 stretches in its one range.
    assert sum(r["bits"] for r in sent[-1]) < 2000


def test_repeats_of_missing_repeated_and_largest_ids(spark, monkeypatch):
    monkeypatch.setattr(repeated_passages, "BLOCK_BYTES", 2000)
    rng = random.Random(3)
    words = lambda n: " ".join(f"{rng.randrange(10**9):x}" for _ in range(n))
    one, two = words(20), words(20)
    rows = [(5, f"{one} a"), (5, f"{one} b"), (2**63 - 2, f"x {two} y"), (2**63 - 1, f"q {two}"), (-7, words(9)), *[(None, f"{words(5)} {one} {k}") for k in range(60)], (None, two)]
    found = repeated_passages.remove_repeats(spark.createDataFrame([(*r, "en", "s", 0) for r in rows], DOCS), 50).collect()
    by_id = {k: sorted(r["n_removed"] for r in found if r["doc_id"] == k) for k in (5, 2**63 - 2, 2**63 - 1, -7)}
    assert by_id == {5: [0, 0], 2**63 - 2: [0], 2**63 - 1: [len(two) + 1], -7: [0]}  # rows of an id do not take from each other
    none = sorted(r["n_removed"] for r in found if r["doc_id"] is None)
    assert len(found) == len(rows) and none == sorted([len(two), *[len(one) + 1] * 60])


def test_repeats_of_empty_tables(spark):
    assert repeated_passages.remove_repeats(empty_documents(spark)).isEmpty()


def test_equal_groups():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 2, (400, 11)).astype(np.uint8)
    groups = repeated_passages.equal_groups(rows)
    kinds = {}
    for row, group in zip(rows, groups, strict=True):
        kinds.setdefault(row.tobytes(), []).append(group)
    for found in kinds.values():
        assert (found == [-1]) if len(found) == 1 else (len(set(found)) == 1 and found[0] >= 0)
    assert len({g for g in groups if g >= 0}) == sum(len(v) > 1 for v in kinds.values())


VECTORS = "vec_id long, embedding array<float>, label int, vector string, score double, rank int, members long"


def vector_rows(n=600, width=24):
    rng = np.random.default_rng(2)
    rows = [(int(k), [float(x) for x in rng.normal(size=width).astype(np.float32)], 0) for k in range(n)]
    rows += [(n + k, rows[n // 2][1], 0) for k in range(80)]  # one common vector
    rows += [(5000, None, 0), (5100, [0.0] * width, 0), (5200, [float("nan")] * width, 0), (5300, [1.0] * (width - 1) + [None], 0), (5400, [float("inf")] * width, 0), (5500, [1.0], 0)]
    return [(*r, None, None, None, None) for r in rows]


def brute_nearest(rows, k=10):
    good = [(r[0], np.array(r[1], dtype=float)) for r in rows if r[1] is not None and len(r[1]) > 1 and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    ids, x = np.array([g[0] for g in good]), np.stack([g[1] for g in good])
    out = {}
    for place, (query, vector) in enumerate(good):
        if query % 100 == 0:
            d = np.sqrt(((x - vector) ** 2).sum(axis=1))
            order = [j for j in np.lexsort((ids, d)) if j != place][:k]
            out[int(query)] = [(int(ids[j]), d[j]) for j in order]
    return out


def test_nearest(spark):
    rows = vector_rows()
    found = nearest.search(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 100 == 0).collect()
    expected = brute_nearest(rows)
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got.keys() == expected.keys() and all(len(v) == 10 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) for q in got)
    assert hits >= 0.9 * 10 * len(got)
    exact = {q: dict(v) for q, v in brute_nearest(rows, 10_000).items()}
    assert all(score == pytest.approx(exact[q][i], rel=1e-14) for q, v in got.items() for i, score in v)
    assert all([(s, i) for i, s in v] == sorted((s, i) for i, s in v) for v in got.values())


def test_few_vectors_are_all_found(spark):
    rows = vector_rows(4)[:4]
    found = nearest.search(spark.createDataFrame(rows, VECTORS), F.col("vec_id") == 0).collect()
    assert sorted(r["vec_id"] for r in found) == [1, 2, 3]
    only = nearest.search(spark.createDataFrame(rows[:1], VECTORS), F.col("vec_id") == 0)
    assert only.isEmpty()
    assert nearest.search(spark.createDataFrame([], VECTORS), F.col("vec_id") == 0).isEmpty()


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(nearest.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(nearest.hadamard(nearest.hadamard(x)), x)


def test_common_values_of_two_full_blocks_in_little_memory():
    nd = near_duplicates
    rng = np.random.default_rng(3)
    few = [np.unique(rng.integers(0, 40, rng.integers(1, 30))) for _ in range(50)]
    assert nd._common(few).tolist() == [[len(np.intersect1d(a, b)) for b in few] for a in few]
    half = [np.sort(rng.integers(-(2**62), 2**62, nd.WHOLE)) for _ in range(nd.BLOCK)]
    tracemalloc.start()
    met = nd._common([*half, *half])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (met[: nd.BLOCK, nd.BLOCK :].diagonal() == nd.WHOLE).all() and most < 40e6


def family(rng, copies, least, most, size=400):
    """Copies of one text with many edits, whose similarities lie around the threshold and below it."""
    base = [f"b{k}" for k in range(size)]
    texts = []
    for _ in range(copies):
        words = list(base)
        for place in rng.sample(range(size), rng.randrange(least, most)):
            words[place] = f"w{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    return [(k * 11 % copies, t, "en", "s", 0) for k, t in enumerate(texts)]


def test_pairs_near_the_threshold_are_no_rows(spark, monkeypatch):
    rows = family(random.Random(5), 300, 14, 34)  # similarities of two to each other: 0.5 to 0.8
    made, store = [], near_duplicates.stored

    def watched(df):
        kept = store(df)
        if kept.columns[:2] == ["a", "b"]:
            made.append(kept.count())
        return kept

    monkeypatch.setattr(near_duplicates, "stored", watched)
    found = near_duplicates.near_duplicates(spark.createDataFrame(rows, DOCS), 1, 80).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in found} == brute_components(rows, 1)
    # Of 44,850 pairs more than half were likely by their sketches, and rows, before.
    assert max(made) < 4 * len(rows)


@pytest.mark.parametrize("block, values", [(20, 1 << 19), (512, 8000)])
def test_families_in_several_blocks(spark, monkeypatch, block, values):
    rng = random.Random(7)
    rows = family(rng, 160, 2, 30) + [(1000 + d, "other " + t.replace("b", "c"), *more) for d, t, *more in family(rng, 60, 10, 40)]
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    monkeypatch.setattr(near_duplicates, "BLOCK_VALUES", values)
    seen, place = [], near_duplicates._placed
    monkeypatch.setattr(near_duplicates, "_placed", lambda members: seen.append(place(members)) or seen[-1])
    found = near_duplicates.near_duplicates(spark.createDataFrame(rows, DOCS), 2, 80).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in found} == brute_components(rows, 2)
    placed = seen[0].toPandas()
    assert placed["own"].max() > 2 and not placed.duplicated(["hub", "i", "j", "own", "node"]).any()
    # Each pair of different components of a group meets once.
    own = placed.drop_duplicates(["hub", "node"])
    for hub, members in own.groupby("hub"):
        met = placed[placed["hub"] == hub].merge(placed[placed["hub"] == hub], on=["i", "j"])
        met = met[(met["node_x"] < met["node_y"]) & ((met["own_x"] != met["own_y"]) | (met["i"] == met["j"]))]
        assert not met.duplicated(["node_x", "node_y"]).any()
        pairs = members.merge(members, how="cross")
        pairs = pairs[(pairs["node_x"] < pairs["node_y"]) & (pairs["part_x"] != pairs["part_y"])]
        assert set(zip(pairs["node_x"], pairs["node_y"])) <= set(zip(met["node_x"], met["node_y"]))


def test_common_values_of_two_lists(monkeypatch):
    nd, rng = near_duplicates, np.random.default_rng(4)
    some = lambda n, most: [np.unique(rng.integers(0, most, rng.integers(0, 40))) for _ in range(n)]
    for rare, at_once in ((1, 10), (30, 7), (10**6, 2048)):
        monkeypatch.setattr(nd, "RARE", rare)
        monkeypatch.setattr(nd, "PAIRS_AT_ONCE", at_once)
        monkeypatch.setattr(nd, "VALUES_AT_ONCE", at_once)
        one, two = some(23, 60), some(31, 90)
        assert nd._common(one).tolist() == [[len(np.intersect1d(a, b)) for b in one] for a in one]
        assert nd._common(one, two).tolist() == [[len(np.intersect1d(a, b)) for b in two] for a in one]


def test_spanning_edges():
    near = np.zeros((7, 7), dtype=bool)
    for a, b in ((0, 1), (1, 2), (0, 2), (4, 6), (5, 6), (4, 5)):
        near[a, b] = near[b, a] = True
    edges = near_duplicates.spanning_edges(near).tolist()
    assert len(edges) == 4 and {frozenset(e) for e in edges} <= {frozenset(e) for e in np.argwhere(near).tolist()}
    assert near_duplicates.spanning_edges(np.zeros((3, 3), dtype=bool)).shape == (0, 2)


def test_grams_of_a_sender_are_told_apart_once():
    rng = np.random.default_rng(6)
    frames, expected = [], {}
    sent = {k: np.unique(rng.integers(0, 300, rng.integers(0, 60)).astype("<u4")) for k in (4, 9, 2, 30)}
    for k, grams in sent.items():
        bits = rng.integers(0, 2, len(grams)).astype(bool)
        frames.append(repeated_passages._message(7, k, 1, grams, np.packbits(bits)))
        others = np.concatenate([g for j, g in sent.items() if j != k])
        several = {int(g) for j, f in zip(sent, frames) for g, b in zip(sent[j], np.unpackbits(np.frombuffer(f[4], np.uint8), count=len(sent[j]))) if b}
        expected[k] = others
    replies = repeated_passages._repeated_grams((7,), repeated_passages._frame(frames))
    got = {int(s): np.frombuffer(a, "<u4").tolist() for s, a in zip(replies["sender"], replies["a"])}
    told = {int(t): np.frombuffer(a, "<u4").tolist() for t, a in zip(replies["to"], replies["a"])}
    wanted = {k: [int(g) for g in grams if g in set(expected[k].tolist()) or int(g) in several] for k, grams in sent.items()}
    assert set(got) == {7} and told == {k: v for k, v in wanted.items() if v}


def test_stretches_are_made_once(spark, monkeypatch, tmp_path):
    log = tmp_path / "made"
    log.mkdir()
    make = repeated_passages.Block.__init__

    def logged(self, texts, length):
        (log / f"{random.SystemRandom().getrandbits(60)}").touch()
        make(self, texts, length)

    monkeypatch.setattr(repeated_passages.Block, "__init__", logged)
    ids, texts = np.array([1, 2, 5]), [r[1].encode() for r in passage_rows()[:3]]
    grams = repeated_passages._send_grams(0, ids, texts, 50, 1)
    replies = repeated_passages._repeated_grams((0,), repeated_passages._frame(grams))
    found = repeated_passages.Stretches(ids, texts, 50, 1, replies)
    on = repeated_passages._frame(repeated_passages._send_on(0, found, 1))
    assert on["to"].tolist() == [1] and len(list(log.iterdir())) == 2
    back = repeated_passages.Stretches.unpacked(ids, texts, 50, repeated_passages._least_documents((1,), on, 1))
    assert len(list(log.iterdir())) == 2  # later passes hash no grams
    for one, two in ((found, back), (found.block, back.block)):
        assert all(np.array_equal(getattr(one, c), getattr(two, c)) for c in ("doc", "first", "last", "least", "group", "docs") if hasattr(two, c))
    assert found.ranges == back.ranges
    assert [found.block.stretch(k) for k in range(len(found.group))] == [back.block.stretch(k) for k in range(len(back.group))]
    none = repeated_passages.Stretches.unpacked(ids, texts, 50, replies[:0])
    assert len(none.least) == len(none.group) == len(none.block.doc) == len(none.ranges) == 0


def test_stage_of_the_pipeline_makes_no_rows_of_pairs(spark, monkeypatch):
    import corpus_pipeline

    rows = family(random.Random(9), 240, 4, 11)
    made, store = [], near_duplicates.stored

    def watched(df):
        kept = store(df)
        if kept.columns[:2] == ["a", "b"]:
            made.append(kept.count())
        return kept

    monkeypatch.setattr(near_duplicates, "stored", watched)
    kept = corpus_pipeline.one_of_each(spark, spark.createDataFrame(rows, DOCS), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in brute_components(rows, 5)})
    assert max(made) < 4 * len(rows)
