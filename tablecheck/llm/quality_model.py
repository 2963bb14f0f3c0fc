"""Quality of documents by hierarchical empirical Bayes: the text's own evidence, and what is known of its host and path.

A logistic model over simple text statistics gives each document its evidence. Grouped sums of the evidence give each host a posterior
share of good documents, shrunk towards the share of all documents, and each path of a host one shrunk towards its host. How strongly
is estimated from the data: from how much the shares of sites differ beyond what their counts explain. A site with few documents says next to nothing;
a site with many may turn a document whose text leaves it open. The document's log odds are its evidence, with the
prior share it was fitted under replaced by the posterior share of its path.

The logistic model is fitted on the driver from at most ``SAMPLE`` labelled rows, the first by a seeded hash; only their statistics are collected. Sums and
shares cover all documents. Sites are one row per path: they are broadcast after a check of their number, and joined by shuffle beyond it.

Results: null texts are empty texts; null hosts and paths are sites of their own; without labels of both kinds the evidence is 0 for all
and every document is kept.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tablecheck.llm.common import checkpointed, map_slices, schema_with, seeded_hash, with_column

SAMPLE = 20_000
RIDGE = 1.0
#: Sites that may be broadcast: under 10 MB.
BROADCAST_SITES = 100_000
FEATURES = "llm_features"

# Function words of four languages.
FUNCTION_WORDS = frozenset(
    w.encode()
    for w in (
        "the of and to in a is that for with was are be it on as by this from "
        "der die und das von den mit ist im nicht eine auf zu ein "
        "le la les et des du une dans que est pour qui un de en "
        "el los las y del por con no se su como más"
    ).split()
)
_CLASS_OF = np.full(256, 0)  # letters and all that is not named below
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>", b"|", b"!?", b".,;:'\"()-", b" \t\r\x0b\x0c", b"\n", bytes(range(128, 256))), 1):
    _CLASS_OF[list(_chars)] = _k
_CLASSES = 10
NAMES = ("log_words", "word_length", "distinct", "function_words", "adjacent_repeats", "repeated_lines", "longest_word", *(f"class_{k}" for k in range(1, _CLASSES)))


def statistics(text: str | None) -> list[float]:
    """Numbers that tell prose from junk, whatever it says."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    n, size = max(1, len(words)), max(1, len(data))
    shares = np.bincount(_CLASS_OF[np.frombuffer(data, dtype=np.uint8)], minlength=_CLASSES) / size
    lines = [line for line in data.split(b"\n") if line.strip()]
    return [
        float(np.log1p(len(words))),
        sum(map(len, words)) / n,
        len(set(words)) / n * float(np.log1p(n)) ** 0.5,
        sum(map(FUNCTION_WORDS.__contains__, words)) / n,
        sum(map(eq, words, words[1:])) / n,
        1 - len(set(lines)) / max(1, len(lines)) if lines else 0.0,
        float(np.log1p(max(map(len, words), default=0))),
        *shares[1:].tolist(),
    ]


def add_statistics(docs: DataFrame) -> DataFrame:
    """All columns, and the statistics of the text in ``FEATURES``."""

    def start():
        return lambda b: with_column(b, FEATURES, pa.array([statistics(t) for t in b.column("text").to_pylist()], pa.list_(pa.float64())))

    return map_slices(docs, start, schema_with(docs, FEATURES, ArrayType(DoubleType())))


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and constant on the given scale, by Newton steps with a ridge."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.hstack([np.clip((x - mean) / spread, -8, 8), np.ones((len(x), 1))])
    ridge = np.full(z.shape[1], RIDGE)
    ridge[-1] = 1e-6
    w = np.zeros(z.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / spread, float(w[-1] - (w[:-1] * mean / spread).sum())


@dataclass
class Model:
    """Weights of the statistics, the share they were fitted under, and the sites' posterior shares."""

    weights: list[float]
    constant: float
    share: float
    sites: DataFrame
    few_sites: bool


def _logit(share: Column) -> Column:
    p = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), share))
    return F.log(p / (1 - p))


def _evidence(weights: list[float], constant: float) -> Column:
    total = F.lit(constant)
    for k, w in enumerate(weights):
        total = total + F.col(FEATURES)[k] * F.lit(w)
    return F.greatest(F.lit(-12.0), F.least(F.lit(12.0), total))


def _site(column: str) -> Column:
    """A site's name that is never null."""
    return F.when(F.col(column).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(column).cast("string")))


def _strength(n: Column, good: Column, share: Column) -> Column:
    """Documents that the prior of a level counts for: method of moments over its sites.

    The spread of the sites' shares beyond their sampling error is the variance of a beta distribution with that many prior documents.
    """
    sampling = F.sum(share * (1 - share)) / F.sum(n)  # each site's is share * (1 - share) / n, weighed by n
    spread = F.sum(n * F.pow(good / n - share, 2)) / F.sum(n)
    between = F.greatest(spread - sampling, F.lit(1e-6))
    return F.greatest(F.lit(1.0), F.least(F.lit(1e6), F.avg(share * (1 - share)) / between - 1))


def fit(rows: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", seed: str = "quality") -> Model:
    """From rows with statistics and labels (doc_id, quality 0 or 1); rows held out of learning are those of ``is_held_out``."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("label")).filter(F.col("label").isin(0, 1) & ~is_held_out())
    sample = known.orderBy(seeded_hash(seed, "doc_id"), "doc_id", "label").limit(SAMPLE)
    # At most SAMPLE rows on this side.
    found = rows.select("doc_id", FEATURES).join(F.broadcast(sample), "doc_id").limit(2 * SAMPLE).collect()
    y = np.array([r["label"] for r in found], dtype=float)
    if 0 < y.sum() < len(y):
        order = np.lexsort((y, [r["doc_id"] for r in found]))
        weights, constant = fit_logistic(np.array([found[k][FEATURES] for k in order]), y[order])
        share = float(y.mean())
    else:
        weights, constant, share = np.zeros(len(NAMES)), 0.0, 0.5

    good = 1 / (1 + F.exp(-_evidence(weights.tolist(), constant)))
    paths = rows.groupBy(_site(host).alias("host"), _site(path).alias("path")).agg(F.count("*").alias("n"), F.sum(good).alias("good"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    whole = hosts.agg(F.sum("host_n").alias("all_n"), F.sum("host_good").alias("all_good"))
    everywhere = whole.select((F.col("all_good") / F.col("all_n")).alias("global_share"))
    hosts = hosts.join(F.broadcast(everywhere))  # one row
    host_prior = hosts.agg(_strength(F.col("host_n"), F.col("host_good"), F.col("global_share")).alias("host_prior"))
    hosts = hosts.join(F.broadcast(host_prior)).withColumn(
        "host_share", (F.col("host_good") + F.col("host_prior") * F.col("global_share")) / (F.col("host_n") + F.col("host_prior"))
    )
    paths = paths.join(hosts.select("host", "host_share"), "host")
    path_prior = paths.agg(_strength(F.col("n"), F.col("good"), F.col("host_share")).alias("path_prior"))
    sites = paths.join(F.broadcast(path_prior)).select(
        "host", "path", ((F.col("good") + F.col("path_prior") * F.col("host_share")) / (F.col("n") + F.col("path_prior"))).alias("site_share")
    )
    sites = checkpointed(sites)
    return Model(weights.tolist(), constant, share, sites, sites.limit(BROADCAST_SITES + 1).count() <= BROADCAST_SITES)


def is_held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def judge(rows: DataFrame, model: Model, host: str = "source", path: str = "lang") -> DataFrame:
    """The rows with ``quality_evidence`` (log odds), ``quality_site`` (share) and ``quality_score`` (0 to 1)."""
    sites = model.sites.select(F.col("host").alias("llm_host"), F.col("path").alias("llm_path"), F.col("site_share").alias("quality_site"))
    known = rows.withColumns({"llm_host": _site(host), "llm_path": _site(path)})
    joined = known.join(F.broadcast(sites) if model.few_sites else sites, ["llm_host", "llm_path"], "left")
    if any(model.weights):
        odds = _evidence(model.weights, model.constant) - _logit(F.lit(model.share)) + _logit(F.coalesce("quality_site", F.lit(model.share)))
    else:
        odds = F.lit(0.0)
    return joined.withColumns({"quality_evidence": _evidence(model.weights, model.constant), "quality_score": 1 / (1 + F.exp(-odds))}).drop("llm_host", "llm_path", FEATURES)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, evidence, site_share, score, kept) of every document."""
    rows = checkpointed(add_statistics(docs.select("doc_id", "text", "source", "lang")).drop("text"))
    judged = judge(rows, fit(rows, labels))
    return judged.select(
        "doc_id",
        is_held_out().alias("held_out"),
        F.col("quality_evidence").alias("evidence"),
        F.col("quality_site").alias("site_share"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.5).alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns, whose score is 0.5 or more. Texts are read twice and never shuffled."""
    narrow = checkpointed(add_statistics(docs.select("doc_id", "text", "source", "lang")).drop("text"))
    model = fit(narrow, labels)
    return judge(add_statistics(docs), model).filter(F.col("quality_score") >= 0.5).select(docs.columns)
