"""Quality by attention-based multiple-instance learning.

A document is a bag of passages; only the bag has a label. Every passage of the whole text is encoded as a vector of
word shapes and surface counts, a hidden layer represents it, gated attention (a tanh branch times a sigmoid branch)
weighs it against the document's other passages, and a logistic unit scores the weighted sum. The network is fitted with
Adam on a bounded sample of labelled documents; every document is then scored where it lies.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import crc_remainder, map_rows
from .toxicity import sampled

#: Words of a passage; buckets of word shapes; width of the hidden layer and of the attention branches.
PASSAGE, SHAPES, HIDDEN, GATE = 40, 64, 32, 16
#: Bounds of what is learned from: labelled documents, and passages of all of them together.
MAX_DOCUMENTS, MAX_PASSAGES = 6_000, 150_000
#: Words that are encoded together, and a longer text alone.
SLICE_WORDS = 200_000
EPOCHS, BATCH, RATE, DECAY, SEED = 30, 64, 0.01, 1e-4, 7
FEATURES = SHAPES + 9

_runs = re.compile(r"(.)\1+")


def shape(word: str) -> str:
    """Classes of all of a word's characters, runs as one: X upper, x lower, 9 digit, other signs themselves."""
    return _runs.sub(r"\1", "".join("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in word))


@lru_cache(100_000)
def bucket(text: str) -> int:
    h = 2166136261
    for b in text.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 15) % SHAPES


class Encoder:
    """Vectors of passages. A worker numbers the words it sees, up to a bound, and keeps a row of counts for each."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.rows: list[tuple] = []
        self.table = np.zeros((0, 6), np.int64)

    def add(self, w: str) -> int:
        """Numbers a word: (shape bucket, letters, upper, digits, signs, length)."""
        letters, digits = sum(map(str.isalpha, w)), sum(map(str.isdigit, w))
        self.rows.append((bucket(shape(w)), letters, sum(map(str.isupper, w)), digits, len(w) - letters - digits, len(w)))
        n = self.number[w] = len(self.number)
        return n

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(passages as rows, number of the text of each). A text without words has one passage of zeros."""
        split = [t.split() if t else [] for t in texts]
        out, owners, begin, size = [], [], 0, 0
        for k, words in enumerate([*split, None]):
            if words is None or size > SLICE_WORDS:
                x, owner = self.slice(split[begin:k])
                out.append(x)
                owners.append(owner + begin)
                begin, size = k, 0
            size += len(words or ())
        return np.concatenate(out), np.concatenate(owners)

    def slice(self, split: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.number) > 400_000:
            self.__init__()
        get, add = self.number.get, self.add
        ids = np.fromiter((n if (n := get(w)) is not None else add(w) for words in split for w in words), np.int64)
        if self.rows:
            self.table = np.concatenate([self.table, np.array(self.rows, np.int64)])
            self.rows.clear()
        lengths = np.array([len(w) for w in split], np.int64)
        passages = np.maximum(1, -(-lengths // PASSAGE))
        first = np.cumsum(passages) - passages
        doc = np.repeat(np.arange(len(split)), lengths)
        place = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        at, m = first[doc] + place // PASSAGE, int(passages.sum())
        owner = np.repeat(np.arange(len(split)), passages)
        x = np.zeros((m, FEATURES), np.float32)
        if not len(ids):
            return x, owner
        rows = self.table[ids]
        count = np.bincount(at, minlength=m).astype(np.float32)
        size = np.maximum(count, 1)
        x[:, :SHAPES] = np.bincount(at * SHAPES + rows[:, 0], minlength=m * SHAPES).reshape(m, SHAPES) / size[:, None]
        letters, upper, digits, signs, chars = (np.bincount(at, rows[:, c], m).astype(np.float32) for c in range(1, 6))
        inside = np.flatnonzero(doc[1:] == doc[:-1])  # word pairs of a text; the first of each kind is fresh
        pair = (doc[inside] * 0x9E3779B97F4A7C + ids[inside]) * 0x2545F4914F6CDD + ids[inside + 1]
        _, seen = np.unique(pair, return_index=True)
        fresh = np.bincount(at[inside[seen]], minlength=m)
        distinct = np.bincount(np.unique(at << 32 | ids) >> 32, minlength=m)
        chars_ = np.maximum(chars, 1)
        x[:, SHAPES:] = np.stack([letters / chars_, upper / np.maximum(letters, 1), digits / chars_, signs / chars_, chars / size / 10, fresh / size, distinct / size, np.log1p(count) / 4, np.log1p(lengths[owner]) / 10], 1)
        return x, owner


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Gated attention over the passages of a bag. Rows of a bag are together; starts has the first row of each."""

    def __init__(self, features: int = FEATURES, seed: int = SEED):
        r = np.random.default_rng(seed)
        draw = lambda a, b: (r.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.w = {
            "mean": np.zeros(features, np.float32),
            "scale": np.ones(features, np.float32),
            "W": draw(features, HIDDEN),
            "b": np.zeros(HIDDEN, np.float32),
            "V": draw(HIDDEN, GATE),
            "U": draw(HIDDEN, GATE),
            "a": draw(GATE, 1)[:, 0],
            "c": draw(HIDDEN, 1)[:, 0],
            "d": np.zeros(1, np.float32),
        }

    def forward(self, x: np.ndarray, starts: np.ndarray):
        w = self.w
        x = (x - w["mean"]) / w["scale"]
        h = np.maximum(x @ w["W"] + w["b"], 0)
        t, g = np.tanh(h @ w["V"]), sigmoid(h @ w["U"])
        e = (t * g) @ w["a"]
        sizes = np.diff([*starts, len(x)])
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        attention = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(h * attention[:, None], starts, axis=0)
        return x, h, t, g, attention, z, sizes, sigmoid(z @ w["c"] + w["d"])

    def gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        x, h, t, g, attention, z, sizes, p = self.forward(x, starts)
        slope = (p - y) / len(y)
        dz = np.repeat(slope[:, None] * w["c"], sizes, axis=0)
        da = (h * dz).sum(1)
        de = attention * (da - np.repeat(np.add.reduceat(attention * da, starts), sizes))
        dtg = de[:, None] * w["a"]
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh = (attention[:, None] * dz + dt @ w["V"].T + dg @ w["U"].T) * (h > 0)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "a": (t * g).T @ de, "c": z.T @ slope, "d": slope.sum(keepdims=True)}

    def fit(self, x: np.ndarray, owner: np.ndarray, y: np.ndarray) -> Network:
        """x: passages, owner: their bag (0 to len(y) - 1, in order), y: labels."""
        self.w["mean"], self.w["scale"] = x.mean(0), x.std(0) + 0.05
        starts = np.searchsorted(owner, np.arange(len(y)))
        ends = np.append(starts[1:], len(x))
        r = np.random.default_rng(SEED)
        m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items() if k not in ("mean", "scale")}
        step = 0
        for epoch in range(EPOCHS):
            order = r.permutation(len(y))
            for begin in range(0, len(y), BATCH):
                bags = order[begin : begin + BATCH]
                rows = np.concatenate([np.arange(starts[b], ends[b]) for b in bags])
                own = np.concatenate([[0], np.cumsum(ends[bags] - starts[bags])[:-1]])
                step += 1
                rate = RATE * (1 - epoch / EPOCHS)
                for k, grad in self.gradients(x[rows], own, y[bags]).items():
                    grad = grad + DECAY * self.w[k]
                    first, second = m[k]
                    first += 0.1 * (grad - first)
                    second += 0.001 * (grad * grad - second)
                    self.w[k] = (self.w[k] - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def training_passages(docs: DataFrame, train: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passages, bag of each, labels) of a bounded sample: at most MAX_DOCUMENTS documents and MAX_PASSAGES passages."""

    def make():
        encoder = Encoder()

        def work(b):
            x, owner = encoder.encode(b["t"])
            return {"doc_id": b["i"], "label": b["label"], "x": [x[owner == k].astype(np.float16).tobytes() for k in range(len(b["t"]))]}

        return work

    rows = docs.select("doc_id", F.col("text").alias("t")).join(F.broadcast(train), "doc_id").select(F.col("doc_id").alias("i"), "label", "t")
    encoded = map_rows(rows, make, "doc_id long, label long, x binary")
    picked = encoded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_DOCUMENTS).toArrow().sort_by("doc_id").to_pydict()
    bags, labels, total = [], [], 0
    for label, data in zip(picked["label"], picked["x"]):
        bag = np.frombuffer(data, np.float16).reshape(-1, FEATURES).astype(np.float32)
        if total + len(bag) <= MAX_PASSAGES:
            bags.append(bag)
            labels.append(label)
            total += len(bag)
    if not bags:
        return np.zeros((0, FEATURES), np.float32), np.zeros(0, np.int64), np.zeros(0, np.float32)
    return np.concatenate(bags), np.repeat(np.arange(len(bags)), [len(b) for b in bags]), np.array(labels, np.float32)


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted, passages, focus), one row per document.

    passages is their number in the text, focus the one with the most attention. Learns from labelled documents outside
    the held fold only; without any, every score is the untrained network's. Null and empty texts are one passage of
    zeros. Repeated rows repeat; extra columns are ignored.
    """
    fold = crc_remainder("doc_id", folds)
    train = sampled(labels, "quality", crc_remainder("doc_id", folds) != held, MAX_DOCUMENTS)
    x, owner, y = training_passages(docs, train)
    network = Network()
    if len(y) and 0 < y.sum() < len(y):
        network.fit(x, owner, y)
    shared = docs.sparkSession.sparkContext.broadcast(network.w)

    def make():
        encoder, net = Encoder(), Network()
        net.w = shared.value

        def work(b):
            x, owner = encoder.encode(b["t"])
            starts = np.searchsorted(owner, np.arange(len(b["t"])))
            *_, attention, _, sizes, p = net.forward(x, starts)
            focus = [int(attention[s : s + n].argmax()) for s, n in zip(starts, sizes)]
            return {"doc_id": b["i"], "score": p.astype(float).tolist(), "passages": sizes.tolist(), "focus": focus}

        return work

    out = map_rows(docs.select(F.col("doc_id").cast("long").alias("i"), F.col("text").alias("t")), make, "doc_id long, score double, passages long, focus long")
    return out.select("doc_id", (fold == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages", "focus")
