"""Toxicity by maximum-scoring segments.

Tokens get log-odds between toxic and other training documents with an informative Dirichlet prior, the pooled corpus;
only tokens with a significant z-score and a large effect keep theirs, and every token costs a little, so a segment of
neutral text loses. A linear scan finds all maximal scoring segments of a document (the disjoint passages none of which can be
extended with gain). By extreme-value theory the best segment score S among n neutral tokens has tail K n exp(-lambda S):
lambda solves the moment equation over the tokens of other documents and K comes from those documents' best segments.
A document's evidence is the sum of its significant segments' lambda S - ln(K n); a logistic curve over its logarithm,
fitted on the training documents' histogram, gives the score.

Tokens of five letters or more also stand for the family of words that begin alike (four and five letters): a word that
is too rare to judge takes the log-odds of its family.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import crc_remainder, map_rows, materialize

#: Bounded sample of labelled rows to learn from, and most tokens that keep a weight.
MAX_LABELLED, MAX_WEIGHTS = 200_000, 65_536
#: Prior weight as a share of all tokens; times that a token counts in one document; least |z| and least |log-odds|; range of a weight.
PRIOR, REPEATS, LEAST_Z, LEAST_ODDS, WEIGHT_RANGE = 0.02, 3, 3.0, 1.0, (-1.0, 8.0)
#: Tokens within which one token gains REPEATS times at most.
NEARBY = 100
#: Tokens whose weight a worker remembers.
REMEMBERED = 1 << 17
#: What every token costs; the score of one without a weight.
NEUTRAL = -0.25
#: Segments count while their expected number by chance is under this.
SIGNIFICANT = 0.05
#: Bins of the histogram for each unit of ln(1 + evidence).
BINS = 8
FLUSH = 100_000

_token = re.compile(r"[^\W_]+")


def tokens_of(text: str | None) -> list[str]:
    return _token.findall(text.lower()) if text else []


def families(token: str) -> list[str]:
    """The families of a token, the narrower one first."""
    return [f"^{token[:n]}" for n in (5, 4) if len(token) > n]


def counted(rows: DataFrame) -> DataFrame:
    """(token, toxic, other) over a table (label, t): tokens and families, at most REPEATS for each document."""

    def run(batches):
        counts = (Counter(), Counter())

        def flush():
            names = list(counts[0].keys() | counts[1].keys())
            batch = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[1][n] for n in names], pa.int64()), pa.array([counts[0][n] for n in names], pa.int64())], names=["token", "toxic", "other"])
            counts[0].clear()
            counts[1].clear()
            return batch

        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = Counter(tokens_of(text))
                wide = Counter()
                for token, n in own.items():
                    for f in families(token):
                        wide[f] += n
                own.update(wide)
                target = counts[1 if label else 0]
                for token, n in own.items():
                    target[token] += n if n < REPEATS else REPEATS
            if len(counts[0]) + len(counts[1]) > FLUSH:
                yield flush()
        yield flush()

    return rows.select("label", "t").mapInArrow(run, "token string, toxic long, other long").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def weighted(counts: DataFrame) -> tuple[dict[str, float], list[tuple[float, int]]]:
    """(token weights, their counts in other documents with the neutral rest as the last): at most MAX_WEIGHTS tokens."""
    counts = materialize(counts, "token-counts")
    words = counts.where(~F.col("token").startswith("^"))
    n1, n0 = (float(x or 0) for x in words.agg(F.sum("toxic"), F.sum("other")).first())
    if not n1 or not n0:
        return {}, [(NEUTRAL, 1)]
    prior = PRIOR * (n1 + n0)
    a = F.lit(prior / (n1 + n0)) * (F.col("toxic") + F.col("other"))
    odds = lambda y, n: F.log((y + a) / (F.lit(n + prior) - y - a))
    delta = odds(F.col("toxic"), n1) - odds(F.col("other"), n0)
    z = delta / F.sqrt(1 / (F.col("toxic") + a) + 1 / (F.col("other") + a))
    kept = counts.select("token", "other", delta.alias("weight"), z.alias("z")).where((F.abs("z") >= LEAST_Z) & (F.abs("weight") >= LEAST_ODDS)).orderBy(F.abs("z").desc(), "token").limit(MAX_WEIGHTS).collect()
    low, high = WEIGHT_RANGE
    weights = {r.token: min(high, max(low, r.weight)) + NEUTRAL for r in kept}
    seen = [(weights[r.token], r.other) for r in kept if not r.token.startswith("^")]
    return weights, [*seen, (NEUTRAL, max(1, int(n0) - sum(n for _, n in seen)))]


def decay(spread: list[tuple[float, int]]) -> float:
    """lambda > 0 with mean exp(lambda * score) = 1 over the scores of neutral text; 1 at most, the scale of log-odds."""
    scores = np.array([s for s, _ in spread])
    share = np.array([n for _, n in spread], float)
    share /= share.sum()
    low, high = 0.0, 1.0
    moment = lambda x: float((share * np.exp(np.minimum(x * scores, 700))).sum()) - 1
    if moment(high) <= 0:
        return high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if moment(middle) <= 0 else (low, middle)
    return max(low, 0.05)


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, token after the last, score) of a list of scores, in linear time."""
    found: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, earlier one with a lower sum before
    total = 0.0
    for at, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, end, left, right = at, at + 1, before, total
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= right:
                found.append((start, end, left, right, j))
                break
            start, left = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, r - l) for a, b, l, r, _ in found]


class Scorer:
    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.known: dict[str, float] = {}

    def weight(self, token: str) -> float:
        w = self.weights
        for name in (token, *families(token)):
            if name in w:
                return w[name]
        return NEUTRAL

    def scores(self, tokens: list[str]) -> list[float]:
        """A token that gains does so REPEATS times within NEARBY tokens; more uses are neutral there, and not further on."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        out, gains = [], {}
        for at, t in enumerate(tokens):
            s = known.get(t)
            if s is None:
                s = known[t] = self.weight(t)
            if s > 0:
                places = gains.setdefault(t, deque(maxlen=REPEATS))
                if len(places) == REPEATS and at - places[0] < NEARBY:
                    s = NEUTRAL
                else:
                    places.append(at)
            out.append(s)
        return out

    def passages(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """(tokens, maximal segments)."""
        scores = self.scores(tokens_of(text))
        return len(scores), segments(scores) if any(s > 0 for s in scores) else []


def passages(docs: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, starts, ends, gains): tokens of each document and all its maximal segments, by token number."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def make():
        scorer = Scorer(shared.value)

        def work(b):
            got = [scorer.passages(t) for t in b["t"]]
            return {"doc_id": b["i"], "n": [g[0] for g in got], "starts": [[s[0] for s in g[1]] for g in got], "ends": [[s[1] for s in g[1]] for g in got], "gains": [[s[2] for s in g[1]] for g in got]}

        return work

    return map_rows(docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")), make, "doc_id long, n long, starts array<long>, ends array<long>, gains array<double>")


def logistic(histogram: list[tuple[float, int, int]]) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a + b x))) fitted to rows (x, label, count) by Newton's method with a weak ridge; b >= 0."""
    x = np.array([h[0] for h in histogram], float)
    y = np.array([h[1] for h in histogram], float)
    n = np.array([h[2] for h in histogram], float)
    if not len(x) or not (n * y).sum() or not (n * (1 - y)).sum():
        return -4.0, 1.0
    design, beta, ridge = np.stack([np.ones_like(x), x], 1), np.zeros(2), np.array([1e-3, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (n * (y - p)) - ridge * beta
        step = np.linalg.solve((design * (n * p * (1 - p))[:, None]).T @ design + np.diag(ridge) + 1e-9 * np.eye(2), gradient)
        beta += np.clip(step, -2, 2)
    return float(beta[0]), max(0.0, float(beta[1]))


def sampled(labels: DataFrame, column: str, condition, limit: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, label) of the labelled rows to learn from: all, or about `limit` of them by a hash, so that they can be broadcast."""
    rows = labels.where(condition & F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    n = rows.count()
    if n > limit:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < int(1_000_000 * limit / n))
    return rows


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted, passages, first_token, last_token, evidence), one row per document.

    passages is the number of significant segments, first_token and last_token bound the best of them (null if there is
    none). Learns from labelled rows outside the held fold only; with no such rows, or of one label only, every score is
    the neutral one. Null and empty texts have no tokens and get the score of no evidence. A document that is labelled
    twice counts as toxic if one label says so; repeated rows of documents repeat.
    """
    fold = crc_remainder("doc_id", folds)
    train = sampled(labels, "toxic", crc_remainder("doc_id", folds) != held)
    texts = docs.select("doc_id", "text").join(F.broadcast(train), "doc_id").select("label", F.col("text").alias("t"))
    weights, spread = weighted(counted(texts))
    lam = decay(spread)
    found = materialize(passages(docs, weights), "segments")
    top = F.coalesce(F.array_max("gains"), F.lit(0.0))
    seen = found.select("doc_id", "n", top.alias("top")).join(F.broadcast(train), "doc_id")
    calm = seen.where("label = 0 and n > 0").agg(F.count("*"), F.sum(F.col("n") * F.exp(-lam * F.col("top")))).first()
    k = (calm[0] + 1.0) / ((calm[1] or 0.0) + 1.0)
    noise = F.log(F.lit(k) * F.greatest("n", F.lit(1)))
    worth = F.filter(F.transform("gains", lambda g: g * lam - noise), lambda e: e > -math.log(SIGNIFICANT))
    scored = found.select("doc_id", "starts", "ends", "gains", F.size(worth).alias("passages"), F.aggregate(worth, F.lit(0.0), lambda s, e: s + e).alias("evidence"))
    x = F.log(1 + F.col("evidence"))
    histogram = scored.select("doc_id", F.ceil(x * BINS).alias("bin")).join(F.broadcast(train), "doc_id").groupBy("bin", "label").count().collect()  # logarithmic in the evidence: some hundred rows at most
    a, b = logistic([(r.bin / BINS, r.label, r["count"]) for r in histogram])
    score = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * x)))
    best = F.array_position("gains", F.array_max("gains")).cast("int")
    place = lambda c: F.when(F.col("passages") > 0, F.try_element_at(c, best))
    return scored.select(
        "doc_id",
        (fold == held).alias("held_out"),
        score.alias("score"),
        (score >= threshold).cast("int").alias("predicted"),
        F.col("passages").cast("int").alias("passages"),
        place(F.col("starts")).alias("first_token"),
        place(F.col("ends")).alias("last_token"),
        "evidence",
    )
