"""BM25 from the posting index against a plain recipe."""

import math
import random
from collections import Counter

import pytest

from shelfspark.operators import posting_index

NOISE = {"a", "an", "and", "for", "in", "of", "on", "the", "to", "with"}


def plain(docs, queries, k):
    tokens = {i: [t for t in (x or "").split(" ") if len(t) > 1 and t not in NOISE] for i, x in docs}
    n, mean = len(docs), max(1.0, sum(map(len, tokens.values())) / len(docs))
    counts = {i: Counter(t) for i, t in tokens.items()}
    out = []
    for q, text in queries:
        terms = dict.fromkeys(t for t in text.split(" ") if len(t) > 1 and t not in NOISE)
        score = Counter()
        for t in terms:
            forms = {t, t + "s"} | ({t[:-1]} if t.endswith("s") else set())
            tf = {i: sum(c[f] for f in forms) for i, c in counts.items() if any(f in c for f in forms)}
            idf = math.log(1 + (n - len(tf) + 0.5) / (len(tf) + 0.5))
            for i, x in tf.items():
                score[i] += idf * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * len(tokens[i]) / mean))
        whole = dict(docs)
        best = sorted((-round(s + 0.75 * (text in (whole[i] or "")), 6), i) for i, s in score.items())
        out += [(q, i, -s, r) for r, (s, i) in enumerate(best[:k], 1)]
    return out


@pytest.mark.parametrize("size", [256, 8])
def test_index_against_plain_scores(spark, monkeypatch, size):
    monkeypatch.setattr(posting_index, "SLICE", size)
    r = random.Random(size)
    word = lambda: f"w{min(int(r.expovariate(0.08)), 120)}" + "s" * (r.random() < 0.2)
    docs = [(i, " ".join(word() for _ in range(r.choice([3, 10, 60])))) for i in range(500)] + [(900, None), (901, ""), (902, "zz w1 w2 w3 w4s yy")]
    queries = [(i, " ".join(word() for _ in range(r.randrange(1, 6)))) for i in range(12)] + [(50, "w1 w2 w3 w4"), (51, "nowhere"), (52, "w70s")]
    index = posting_index.build(spark.createDataFrame(docs, "doc_id long, text string"))
    asked = spark.createDataFrame(queries, "query_id long, query string")
    got, want = sorted(map(tuple, posting_index.search(index, asked, 5).collect())), sorted(plain(docs, queries, 5))
    assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=2e-6)
    if size == 8:
        monkeypatch.setattr(posting_index, "FIRST", 2)
        read = posting_index.slices_read(index, asked, 1).collect()
        assert sum(x.slices_read for x in read) < 0.8 * sum(x.slices for x in read)


def test_empty(spark):
    index = posting_index.build(spark.createDataFrame([], "doc_id long, text string"))
    assert posting_index.search(index, spark.createDataFrame([(1, "a query")], "query_id long, query string")).count() == 0
    some = posting_index.build(spark.createDataFrame([(1, "some words")], "doc_id long, text string"))
    assert posting_index.search(some, spark.createDataFrame([], "query_id long, query string")).count() == 0
