"""Toxicity of documents: a bidirectional gated recurrent network with attention pooling over word and character inputs.

A word's input is its own vector (words of the training vocabulary) beside the scaled sum of the vectors of its hashed
runs of three to five bytes (any word, so that stems count in forms never seen). Two
gated recurrent layers read a window of ``WINDOW`` words in both directions, attention pools their states, and a logistic unit scores the
window. Windows overlap and cover the whole text; a document's score is that of its most toxic window.

The network is trained on the driver, in numpy, on a bounded sample: for each label the ``SAMPLE_DOCS`` labelled documents that come first by
a seeded hash, of at most ``SAMPLE_CHARS`` characters each. Only whole documents are labelled, so training picks the window of each
document that scores highest, learns from it, and picks again. Word and run vectors start from the log odds of
occurring in toxic documents, so that the first picks are good. At last the threshold is set between the two classes of the sample.

Scoring is a narrow pass over the documents: the network (under 1 MB, whatever the data) is broadcast, windows of a slice of documents are scored together, and
inputs of words that were seen before in the task are kept, up to ``KEPT_WORDS``.

Results: null and blank texts have one window without words; without a labelled document of both labels every score is the share of
label 1 in the sample (0 without labels). Rows with equal doc_id are scored each on its own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from tablecheck.llm.common import map_slices, seeded_hash

WINDOW, STRIDE = 32, 24
HIDDEN, WORD_DIM, CHAR_DIM = 8, 8, 8
GRAMS = 16_384
VOCABULARY = 8_000
SAMPLE_DOCS = 1_500
SAMPLE_CHARS = 20_000
ROUNDS, BATCH, RATE = 4, 128, 0.01
LEAST_STEPS = 40  # of each round
KEPT_WORDS = 200_000
BATCH_WINDOWS = 4_096

_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def grams(forms: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed runs of three to five bytes of all words in one row, and where each word's begin. No word may be empty."""
    marked = [b"<" + w.encode() + b">>>" for w in forms]
    lengths = np.array([len(m) for m in marked], dtype=np.int64)
    data = np.frombuffer(b"".join(marked) + b"\0\0\0\0", dtype=np.uint8).astype(np.uint32)
    n = len(data) - 4
    run = (data[:n] * np.uint32(0x9E3779B1)) ^ (data[1 : n + 1] * np.uint32(0x85EBCA77)) ^ (data[2 : n + 2] * np.uint32(0xC2B2AE3D))
    runs = [run]
    for k in (3, 4):
        run = (run ^ (run >> np.uint32(13))) * np.uint32(0x27D4EB2F) + data[k : n + k]
        runs.append(run)
    hashed = np.stack(runs, axis=1)
    hashed = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    hashed = (hashed ^ (hashed >> np.uint32(12))) % np.uint32(GRAMS)
    ends = np.cumsum(lengths)
    inside = np.ones(n, dtype=bool)
    for k in range(1, 5):
        inside[ends - k] = False
    starts = 3 * np.concatenate([[0], np.cumsum(lengths - 4)[:-1]])
    return hashed[inside].ravel().astype(np.int64), starts.astype(np.int64)


def windows(ids: np.ndarray) -> np.ndarray:
    """Overlapping windows over a text's word ids, padded with 0; at least one."""
    count = 1 if len(ids) <= WINDOW else 1 + -(-(len(ids) - WINDOW) // STRIDE)
    padded = np.zeros((count - 1) * STRIDE + WINDOW, dtype=np.int64)
    padded[: len(ids)] = ids
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """The parameters; ``inputs`` make a word's input of both layers, ``score`` reads windows of such inputs."""

    def __init__(self, vocabulary: dict[str, int], seed: int = 7):
        draw = np.random.default_rng(seed).normal
        near = lambda *shape: draw(0, 0.3, shape).astype(np.float32)
        self.vocabulary = vocabulary  # word: row of "word", from 1; row 0 is for all others
        self.p = {
            "word": near(len(vocabulary) + 1, WORD_DIM) * 0.3,
            "char": near(GRAMS, CHAR_DIM) * 0.3,
            "in": near(WORD_DIM + CHAR_DIM, 6 * HIDDEN),
            "in_bias": np.zeros(6 * HIDDEN, np.float32),
            "forward": near(HIDDEN, 3 * HIDDEN),
            "backward": near(HIDDEN, 3 * HIDDEN),
            "look": near(2 * HIDDEN, HIDDEN),
            "look_bias": np.zeros(HIDDEN, np.float32),
            "weigh": near(HIDDEN),
            "out": near(2 * HIDDEN),
            "out_bias": np.zeros(1, np.float32),
        }
        self.cut = 0.0

    def features(self, forms: Sequence[str]) -> np.ndarray:
        """Word and character vectors of words."""
        own = np.fromiter((self.vocabulary.get(w, 0) for w in forms), dtype=np.int64, count=len(forms))
        tri, starts = grams(forms)
        counts = np.diff(np.append(starts, len(tri)))
        chars = np.add.reduceat(self.p["char"][tri], starts, axis=0) / np.sqrt(counts)[:, None]
        return np.concatenate([self.p["word"][own], chars], axis=1).astype(np.float32)

    def inputs(self, features: np.ndarray) -> np.ndarray:
        return features @ self.p["in"] + self.p["in_bias"]

    def _layer(self, steps: np.ndarray, mask: np.ndarray, weights: np.ndarray, keep: list | None) -> np.ndarray:
        """States after each step; steps: (window, time, 3 * hidden) in the order of reading."""
        n, time = mask.shape
        h, states = np.zeros((n, HIDDEN), np.float32), np.empty((n, time, HIDDEN), np.float32)
        for t in range(time):
            x, a = steps[:, t], h @ weights
            gates = sigmoid(x[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            new = np.tanh(x[:, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
            m = mask[:, t, None]
            after = np.where(m, new + z * (h - new), h)
            if keep is not None:
                keep.append((h, z, r, new, a[:, 2 * HIDDEN :], m))
            h = after
            states[:, t] = h
        return states

    def logits(self, steps: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Scores of windows before the logistic function; steps: (window, time, 6 * hidden)."""
        logs: tuple = ([], []) if keep is not None else (None, None)
        there = self._layer(steps[:, :, : 3 * HIDDEN], mask, self.p["forward"], logs[0])
        back = self._layer(steps[:, ::-1, 3 * HIDDEN :], mask[:, ::-1], self.p["backward"], logs[1])[:, ::-1]
        states = np.concatenate([there, back], axis=2)
        seen = np.tanh(states @ self.p["look"] + self.p["look_bias"])
        weight = np.where(mask, seen @ self.p["weigh"], -1e9)
        weight = np.exp(weight - weight.max(axis=1, keepdims=True)) * mask
        weight /= np.maximum(weight.sum(axis=1, keepdims=True), 1e-9)
        pooled = (weight[:, :, None] * states).sum(axis=1)
        if keep is not None:
            keep |= {"logs": logs, "states": states, "seen": seen, "weight": weight, "pooled": pooled, "mask": mask}
        return pooled @ self.p["out"] + self.p["out_bias"][0]

    def gradients(self, slope: np.ndarray, kept: dict) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the loss by each parameter above the inputs, and by the inputs; slope: by the logits."""
        p, states, seen, weight = self.p, kept["states"], kept["seen"], kept["weight"]
        g = {"out": kept["pooled"].T @ slope, "out_bias": np.array([slope.sum()], np.float32)}
        d_pooled = slope[:, None] * p["out"]
        d_states = weight[:, :, None] * d_pooled[:, None, :]
        d_weight = (states * d_pooled[:, None, :]).sum(axis=2)
        d_weight = weight * (d_weight - (weight * d_weight).sum(axis=1, keepdims=True))
        g["weigh"] = np.einsum("nt,nth->h", d_weight, seen)
        d_seen = d_weight[:, :, None] * p["weigh"] * (1 - seen**2)
        g["look"] = np.einsum("nts,nth->sh", states, d_seen)
        g["look_bias"] = d_seen.sum(axis=(0, 1))
        d_states = d_states + d_seen @ p["look"].T
        d_steps = np.empty((*weight.shape, 6 * HIDDEN), np.float32)
        d_steps[:, :, : 3 * HIDDEN], g["forward"] = self._layer_back(d_states[:, :, :HIDDEN], p["forward"], kept["logs"][0])
        turned, g["backward"] = self._layer_back(d_states[:, ::-1, HIDDEN:], p["backward"], kept["logs"][1])
        d_steps[:, :, 3 * HIDDEN :] = turned[:, ::-1]
        return g, d_steps

    @staticmethod
    def _layer_back(d_states: np.ndarray, weights: np.ndarray, log: list) -> tuple[np.ndarray, np.ndarray]:
        d_steps = np.empty((*d_states.shape[:2], 3 * HIDDEN), np.float32)
        d_weights, d_h = np.zeros_like(weights), np.zeros_like(d_states[:, 0])
        for t in reversed(range(len(log))):
            h, z, r, new, a_new, m = log[t]
            d_after = d_h + d_states[:, t]
            d_new = np.where(m, d_after * (1 - z), 0) * (1 - new**2)
            d_z = np.where(m, d_after * (h - new), 0) * z * (1 - z)
            d_r = d_new * a_new * r * (1 - r)
            d_a = np.concatenate([d_z, d_r, d_new * r], axis=1)
            d_steps[:, t] = np.concatenate([d_z, d_r, d_new], axis=1)
            d_weights += h.T @ d_a
            d_h = np.where(m, d_after * z, d_after) + d_a @ weights.T
        return d_steps, d_weights

    def best(self, steps_of: np.ndarray, wins: np.ndarray) -> np.ndarray:
        """Logits of windows of word rows, in batches; row 0 of the inputs is padding."""
        return np.concatenate([self.logits(steps_of[w], w > 0) for w in (wins[k : k + BATCH_WINDOWS] for k in range(0, len(wins), BATCH_WINDOWS))])


def train(texts: Sequence[str | None], labels: Sequence[int]) -> Network:
    """A network for documents of both labels."""
    y = np.asarray(labels, dtype=np.float32)
    docs = [words(t) for t in texts]
    in_docs = [Counter(), Counter()]
    for doc, label in zip(docs, labels, strict=True):
        in_docs[int(label)].update(set(doc))
    n = [max(1, int((y == k).sum())) for k in (0, 1)]
    frequent = sorted((w for w in in_docs[0].keys() | in_docs[1].keys() if in_docs[0][w] + in_docs[1][w] >= 3), key=lambda w: (-in_docs[0][w] - in_docs[1][w], w))
    net = Network({w: i + 1 for i, w in enumerate(frequent[:VOCABULARY])})
    p = net.p

    forms = list(dict.fromkeys(w for doc in docs for w in doc))
    row = {w: i + 1 for i, w in enumerate(forms)}  # 0: padding
    own = np.array([0, *(net.vocabulary.get(w, 0) for w in forms)])
    tri, starts = grams(["padding", *forms])
    counts = np.diff(np.append(starts, len(tri)))
    owner = np.repeat(np.arange(len(starts)), counts)

    # Start from the log odds of words and of runs, in the first place of their vectors.
    odds = np.zeros(len(forms) + 1, np.float32)
    for w, i in row.items():
        odds[i] = np.log((in_docs[1][w] + 0.5) / (n[1] + 1)) - np.log((in_docs[0][w] + 0.5) / (n[0] + 1))
    sure = np.array([0, *(min(1.0, (in_docs[0][w] + in_docs[1][w]) / 20) for w in forms)], np.float32)
    p["word"][own[own > 0], 0] = (odds * sure)[own > 0] * 0.5
    weight = np.bincount(tri, weights=sure[owner], minlength=GRAMS)
    p["char"][:, 0] = np.bincount(tri, weights=(odds * sure)[owner], minlength=GRAMS) / np.maximum(weight, 1) * 0.5

    per_doc = [windows(np.array([row[w] for w in doc], dtype=np.int64)) for doc in docs]
    all_windows, first = np.concatenate(per_doc), np.concatenate([[0], np.cumsum([len(w) for w in per_doc])])
    of_doc = np.repeat(np.arange(len(docs)), np.diff(first))
    rng, moments, step = np.random.default_rng(11), {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}, 0

    def features() -> np.ndarray:
        chars = np.add.reduceat(p["char"][tri], starts, axis=0) / np.sqrt(counts)[:, None]
        return np.concatenate([p["word"][own], chars], axis=1).astype(np.float32)

    def top() -> tuple[np.ndarray, np.ndarray]:
        """The highest window of each document, and its logit."""
        scored = net.best(net.inputs(features()), all_windows)
        order = np.lexsort((-scored, of_doc))
        chosen = order[first[:-1]]
        return chosen, scored[chosen]

    for turn in range(ROUNDS):
        if turn:
            chosen = top()[0]
        else:  # no training yet: the window with the highest odds of a word
            scored = np.where(all_windows > 0, (odds * sure)[all_windows], -9).max(axis=1)
            chosen = np.lexsort((-scored, of_doc))[first[:-1]]
        for _ in range(max(2, LEAST_STEPS * BATCH // len(docs))):
            shuffled = rng.permutation(len(docs))
            for k in range(0, len(shuffled), BATCH):
                part = shuffled[k : k + BATCH]
                # Beside the highest window of a clean document, any other of it is clean as well.
                other = [rng.integers(first[d], first[d + 1]) for d in part if y[d] == 0]
                picked = np.concatenate([chosen[part], np.array(other, dtype=np.int64)])
                target = np.concatenate([y[part], np.zeros(len(other), np.float32)])
                wins = all_windows[picked]
                used, place = np.unique(wins, return_inverse=True)
                place = place.reshape(wins.shape)
                hidden = (rng.random(len(used)) < 0.25) | (own[used] == 0)  # learn words by their letters, too
                ids = np.where(hidden, 0, own[used])
                spots = np.concatenate([np.arange(starts[u], starts[u] + counts[u]) for u in used])
                holder = np.repeat(np.arange(len(used)), counts[used])
                chars = np.zeros((len(used), CHAR_DIM), np.float32)
                np.add.at(chars, holder, p["char"][tri[spots]])
                chars /= np.sqrt(counts[used])[:, None]
                x = np.concatenate([p["word"][ids], chars], axis=1)
                kept: dict = {}
                logit = net.logits(net.inputs(x)[place], wins > 0, kept)
                slope = ((sigmoid(logit) - target) / len(target)).astype(np.float32)
                g, d_steps = net.gradients(slope, kept)
                d_in = np.zeros((len(used), 6 * HIDDEN), np.float32)
                np.add.at(d_in, place.ravel(), (d_steps * (wins > 0)[:, :, None]).reshape(-1, 6 * HIDDEN))
                g["in"], g["in_bias"] = x.T @ d_in, d_in.sum(axis=0)
                d_x = d_in @ p["in"].T
                g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
                np.add.at(g["word"], ids, d_x[:, :WORD_DIM])
                np.add.at(g["char"], tri[spots], (d_x[:, WORD_DIM:] / np.sqrt(counts[used])[:, None])[holder])
                step += 1
                for name, slope_of in g.items():
                    one, two = moments[name]
                    one += 0.1 * (slope_of - one)
                    two += 0.001 * (slope_of**2 - two)
                    p[name] -= RATE * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-8)
    scored = top()[1]
    # The cut that separates the sample best, both labels weighing the same; in the middle of the gap.
    order = np.argsort(scored)
    ranked, toxic = scored[order], y[order]
    wrong = np.cumsum(toxic) / n[1] + (1 - np.cumsum(1 - toxic) / n[0])
    k = int(np.argmin(wrong))
    net.cut = float((ranked[k] + ranked[min(k + 1, len(ranked) - 1)]) / 2)
    return net


class Scorer:
    """Scores texts; keeps the inputs of words it has met."""

    def __init__(self, net: Network):
        self.net = net
        self._forget()

    def _forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1, 6 * HIDDEN), np.float32)

    def _ids(self, docs: list[list[str]]) -> list[np.ndarray]:
        rows = self.rows
        new = sorted(set().union(*docs).difference(rows))
        if new:
            if len(rows) + len(new) > KEPT_WORDS:
                self._forget()
                rows = self.rows
                new = sorted(set().union(*docs))
            base = len(rows) + 1
            rows.update(zip(new, range(base, base + len(new)), strict=True))
            needed = base + len(new)
            if needed > len(self.table):
                table = np.zeros((max(needed, 2 * len(self.table)), 6 * HIDDEN), np.float32)
                table[: len(self.table)] = self.table
                self.table = table
            self.table[base:needed] = self.net.inputs(self.net.features(new))
        return [np.fromiter(map(rows.__getitem__, doc), dtype=np.int64, count=len(doc)) for doc in docs]

    def scores(self, texts: Sequence[str | None]) -> list[float]:
        per_doc = [windows(ids) for ids in self._ids([words(t) for t in texts])]
        logits = self.net.best(self.table, np.concatenate(per_doc))
        first = np.concatenate([[0], np.cumsum([len(w) for w in per_doc])[:-1]])
        return sigmoid(np.maximum.reduceat(logits, first).astype(np.float64) - self.net.cut).tolist()



def sample(docs: DataFrame, labels: DataFrame, seed: str = "toxicity") -> Iterator[tuple[str | None, int]]:
    """The bounded training sample: (text, label) of documents that are not held out."""
    learn = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).filter(F.col("label").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    drawn = seeded_hash(seed, "doc_id")
    for label in (0, 1):
        # At most SAMPLE_DOCS ids, so they may be broadcast.
        chosen = learn.filter(F.col("label") == label).orderBy(drawn, "doc_id").limit(SAMPLE_DOCS).select("doc_id").distinct()
        found = docs.filter(F.char_length("text") <= SAMPLE_CHARS).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
        for row in found.orderBy("doc_id", "text").limit(2 * SAMPLE_DOCS).collect():
            yield row["text"], label


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    spark = docs.sparkSession
    learned = list(sample(docs, labels))
    texts, known = [text for text, _ in learned], [label for _, label in learned]
    rate = sum(known) / len(known) if known else 0.0
    shared = spark.sparkContext.broadcast(train(texts, known) if 0 < rate < 1 else None)

    def start():
        scorer = Scorer(shared.value) if shared.value else None

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column("text").to_pylist()
            scores = scorer.scores(texts) if scorer else [rate] * len(texts)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

        return work

    scored = map_slices(docs.select("doc_id", "text"), start, StructType([docs.schema["doc_id"]]).add("score", DoubleType()))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
