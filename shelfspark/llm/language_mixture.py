"""Language identification by multilingual mixture inference.

Each language has a distribution over hashed character trigrams, counted over all training documents. A document is a
mixture: expectation-maximisation estimates the proportions of the languages behind its trigrams. Which languages are
in it at all is chosen by penalised likelihood: starting from the single best language, the next candidate by
proportion joins if the likelihood it adds exceeds its penalty, until none does. Everything is done for many documents at once with
sparse (document, trigram) counts.
"""

from __future__ import annotations

import sys
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import crc_remainder, map_rows

BUCKETS = 1 << 15
#: Smoothing of the trigram distributions; EM rounds; penalty per language in units of ln(trigrams).
SMOOTHING, ROUNDS, PENALTY = 0.5, 12, 3.0
#: Characters of text whose counts are worked on together.
GROUP_CHARS = 1 << 17
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, bucket) of all character trigrams: lower case, every run of other than letters is one space."""
    lowered = [t.lower() if t else "" for t in texts]
    lengths = np.array([len(t) for t in lowered], np.int64)
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    of = np.repeat(np.arange(len(texts)), lengths)
    letter = letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1] & (of[1:] == of[:-1])
    points, of, letter = points[keep], of[keep], letter[keep]
    points = np.where(letter, points, 32)
    if len(points) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    same = (of[2:] == of[:-2]) & (letter[2:] | letter[1:-1])
    mixed = (points[:-2] * 0x9E3779B1 + points[1:-1] * 0x85EBCA77 + points[2:] * 0xC2B2AE3D) & 0xFFFFFFFF
    mixed ^= mixed >> 15
    return of[2:][same], (mixed * 0x2C1B3C6D >> 12 & BUCKETS - 1)[same]


def sparse(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, bucket, count), each pair once, in order of the texts."""
    of, bucket = trigrams(texts)
    if len(texts) * BUCKETS > 64 * max(1, len(of)):
        cells, counts = np.unique(of * BUCKETS + bucket, return_counts=True)
    else:
        table = np.bincount(of * BUCKETS + bucket, minlength=0)
        cells = np.flatnonzero(table)
        counts = table[cells]
    return cells // BUCKETS, cells % BUCKETS, counts


def groups(texts: list[str | None]):
    """Slices of a list of texts of about GROUP_CHARS characters, a longer text alone."""
    begin, size = 0, 0
    for k, t in enumerate(texts):
        n = len(t or "")
        if k > begin and size + n > GROUP_CHARS:
            yield begin, k
            begin, size = k, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def trained(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, counts of shape (languages, BUCKETS)) over all rows where the condition holds.

    Tasks count their own documents; Spark adds up. What comes to the driver has a cell for each language and bucket,
    whatever the number of documents.
    """

    def run(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                counts = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for a, b in groups(texts):
                    counts += np.bincount(trigrams(texts[a:b])[1], minlength=BUCKETS)
        for lang, counts in totals.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at])], names=["lang", "bucket", "n"])

    rows = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("t"))
    summed = rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(summed.column("lang").to_pylist()))
    out = np.zeros((len(names), BUCKETS), np.int64)
    code = {n: k for k, n in enumerate(names)}
    lang = np.array([code[x] for x in summed.column("lang").to_pylist()], np.int64)
    out[lang, summed.column("bucket").to_numpy()] = summed.column("n").to_numpy()
    return names, out


class Mixture:
    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        smooth = counts + SMOOTHING
        self.p = np.ascontiguousarray((smooth / smooth.sum(1, keepdims=True)).T.astype(np.float32))  # (buckets, languages)

    def fitted(self, p: np.ndarray, n: np.ndarray, of: np.ndarray, starts: np.ndarray, start_share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions after EM from start_share (zeros stay zero), and the log-likelihood of each document."""
        share = start_share.astype(np.float32)
        total = np.add.reduceat(n, starts)
        for _ in range(ROUNDS):
            w = p * share[of]
            w *= (n / w.sum(1))[:, None]
            share = np.add.reduceat(w, starts, axis=0) / total[:, None]
        return share, np.add.reduceat(n * np.log((p * share[of]).sum(1, dtype=np.float64)), starts)

    def infer(self, texts: list[str | None]) -> list[dict[str, float]]:
        """Proportions of the chosen languages of each text, the largest first; none without letters."""
        out: list[dict[str, float]] = [{} for _ in texts]
        for a, b in groups(texts):
            of, bucket, count = sparse(texts[a:b])
            if not len(of) or not self.names:
                continue
            docs, starts = np.unique(of, return_index=True)
            at = np.repeat(np.arange(len(docs)), np.diff([*starts, len(of)]))
            p, n = self.p[bucket], count.astype(np.float32)
            single = np.add.reduceat(n[:, None] * np.log(p), starts, axis=0, dtype=np.float64)
            everything, _ = self.fitted(p, n, at, starts, np.full((len(docs), len(self.names)), 1 / len(self.names)))
            best = single.argmax(1)
            chosen = np.zeros((len(docs), len(self.names)), bool)
            chosen[np.arange(len(docs)), best] = True
            share, score = chosen.astype(np.float32), single.max(1)
            penalty = PENALTY * np.log(np.add.reduceat(n, starts) + 1)
            going = np.ones(len(docs), bool)
            for _ in range(len(self.names) - 1):
                wider = chosen.copy()
                wider[np.arange(len(docs)), np.where(chosen, -1, everything).argmax(1)] = True
                new, likelihood = self.fitted(p, n, at, starts, wider / wider.sum(1, keepdims=True))
                better = going & (likelihood - score > penalty)
                if not better.any():
                    break
                chosen[better], share[better], score[better], going = wider[better], new[better], likelihood[better], better
            for row, doc in enumerate(docs.tolist()):
                order = np.argsort(-share[row], kind="stable")
                out[a + doc] = {self.names[k]: float(share[row, k]) for k in order if share[row, k] > 0}
        return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def identify(docs: DataFrame, names: list[str], counts: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, languages, proportions).

    lang_pred is the language of the largest proportion, score that proportion. A null text, one without a letter, and
    any text if no language was learned, is `und` with score 0 and no languages. Texts of one or two letters still get
    the trigrams with their neighbouring spaces if there are any; else the most frequent language in training.
    """
    model = docs.sparkSession.sparkContext.broadcast((names, counts))
    usual = names[int(counts.sum(1).argmax())] if names else UNKNOWN

    def make():
        mixture = Mixture(*model.value)

        def work(b):
            found = mixture.infer(b["t"])
            for k, (f, t) in enumerate(zip(found, b["t"])):
                if not f and mixture.names and has_letter(t):
                    found[k] = {usual: 1.0 / len(mixture.names)}
            return {
                "doc_id": b["i"],
                "lang_pred": [next(iter(f), UNKNOWN) for f in found],
                "score": [min(1.0, next(iter(f.values()), 0.0)) for f in found],
                "languages": [list(f) for f in found],
                "proportions": [list(f.values()) for f in found],
            }

        return work

    return map_rows(docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")), make, "doc_id long, lang_pred string, score double, languages array<string>, proportions array<double>")


def predict(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """Learns from the folds other than `held` and gives every document its language: adds held_out."""
    fold = crc_remainder("doc_id", folds)
    names, counts = trained(docs, fold != held)
    out = identify(docs, names, counts)
    return out.select("doc_id", (fold == held).alias("held_out"), "lang_pred", "score", "languages", "proportions")
