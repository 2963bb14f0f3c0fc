import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from fixtures import clashing, empty_documents, odd_documents, odd_rows
from pyspark.sql import functions as F

from tablecheck.llm import mixing, quality_rules, sharding


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("change", [lambda d: d, clashing])
def test_base_counts(spark, change):
    found = {(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality_rules.judge(change(odd_documents(spark))).collect()}
    assert found == {(r[0], *counts(r[1])) for r in odd_rows()}


def test_distance(spark):
    row = spark.range(1).select(
        quality_rules.distance(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))).alias("far"),
        quality_rules.distance(F.array(F.lit(0.5), F.lit(0.5)), F.array(F.lit(0.5), F.lit(0.5))).alias("same"),
        quality_rules.distance(F.array(F.lit(0.5), F.lit(0.5)), F.array(F.lit(1.0), F.lit(0.0))).alias("half"),
    ).first()
    expected = math.sqrt((0.5 * math.log2(0.5 / 0.75) + 0.5 * math.log2(0.5 / 0.25) + math.log2(1 / 0.75)) / 2)
    assert row["far"] == 1.0 and row["same"] == 0.0 and row["half"] == pytest.approx(expected)


def test_shouting_and_tables_fail_and_prose_passes(spark, tables):
    labelled = quality_rules.judge(tables["documents"]).join(tables["labels"], "doc_id").filter("NOT base_failed")
    kept = {r["quality"]: r["share"] for r in labelled.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert kept[1] > 0.97 and kept.get(0, 0) < 0.4


def test_rules_use_no_python(spark):
    text = quality_rules.measure(odd_documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text


def test_empty_tables(spark):
    docs = empty_documents(spark)
    assert quality_rules.judge(docs).isEmpty() and sharding.shard_documents(docs).isEmpty() and mixing.mix_documents(docs).isEmpty()


@pytest.mark.parametrize("shards", [1, 5, 24, 100])
def test_shards(spark, shards):
    docs = clashing(odd_documents(spark))
    placed = sharding.shard_documents(docs, shards).collect()
    rows = odd_rows()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in placed) == sorted((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    by_shard = defaultdict(list)
    for r in placed:
        by_shard[r["shard"]].append(r["slot"])
    sizes = [len(by_shard[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by_shard.values())


def test_shards_match_the_mixture_and_rerun(spark, tables):
    placed = sharding.shard_documents(tables["documents"], 4)
    whole = {r["source"]: r["count"] for r in placed.groupBy("source").count().collect()}
    for r in placed.groupBy("source", "shard").count().collect():
        assert abs(r["count"] - whole[r["source"]] / 4) <= 1
    again = sharding.shard_documents(tables["documents"].repartition(7), 4)
    assert placed.exceptAll(again).isEmpty()


def test_targets():
    weights = mixing.cycle_weights(["b", None, "a"])
    assert weights == {"a": 1, "b": 2, None: 3}
    # None may give 30 at most; the rest goes to the others by weight until b is full as well.
    found = mixing.targets({"a": 1000, "b": 20, None: 10}, 1030, weights, 3)
    assert found == {"a": 940.0, "b": 60.0, None: 30.0}
    assert mixing.targets({"a": 0}, 0, {"a": 1}, 3) == {"a": 0.0}


def test_route_prefers_fresh_words():
    flow = mixing.route({("a",): 100, ("a", "b"): 100, ("b",): 10}, {"a": 120, "b": 90}, 3)
    assert sum(flow[p, "a"] for p in [("a",), ("a", "b")]) == 120 and sum(flow[p, "b"] for p in [("a", "b"), ("b",)]) == 90
    assert flow[("a",), "a"] == 100 and flow[("a", "b"), "a"] + flow[("a", "b"), "b"] == 100  # nothing twice
    assert mixing.route({("a",): 10}, {"a": 25}, 3)[("a",), "a"] == 25


def test_overlapping_sources(spark):
    rows = spark.createDataFrame([(k, 5 + k % 7, ["a"] if k % 3 else ["a", "b"]) for k in range(3000)] + [(9000, 4, None)], "doc_id long, size long, at array<string>")
    mixed = mixing.mix(rows, F.col("at"), lambda s: {"a": 1.0, "b": 3.0}).collect()
    assert len(mixed) == 3001
    both = sum(r["mix_copies"] * r["size"] for r in mixed if r["at"] == ["a", "b"])
    alone = sum(r["mix_copies"] * r["size"] for r in mixed if r["at"] == ["a"])
    total = sum(r["size"] for r in mixed)
    b = sum(r["size"] for r in mixed if r["at"] == ["a", "b"])
    assert abs(both + alone - total) <= 12 and abs(both - min(3 * b, 0.75 * total)) <= 12


@pytest.mark.parametrize("change", [lambda d: d, clashing])
def test_mix(spark, tables, change):
    docs = change(tables["documents"])
    found = mixing.mix_documents(docs).join(tables["documents"].select("doc_id", "source"), "doc_id").collect()
    sizes = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in tables["documents"].collect()}
    by_source = defaultdict(list)
    for r in found:
        assert r["size"] == sizes[r["doc_id"]] and r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        by_source[r["source"]].append(r)
    order = sorted(by_source)
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    for s, rows in by_source.items():
        assert rows[0]["source_size"] == sum(r["size"] for r in rows)
        assert rows[0]["target"] <= 3 * rows[0]["source_size"]
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= max(r["size"] for r in rows)
    if all(rows[0]["target"] < 3 * rows[0]["source_size"] for rows in by_source.values()):
        total = sum(sizes.values())
        assert all(by_source[s][0]["target"] == pytest.approx(total * weight[s] / sum(weight.values())) for s in order)
    again = mixing.mix_documents(docs.repartition(5)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in found)


def test_mix_of_odd_rows(spark):
    found = mixing.mix_documents(odd_documents(spark)).collect()
    assert len(found) == len(odd_rows()) and all(r["taken"] == 0 for r in found if r["size"] == 0)
