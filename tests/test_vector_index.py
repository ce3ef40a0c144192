"""The vector index against all pairs."""

import numpy as np
import pytest

from shelfspark.operators import entity, vector_index


def table(spark, rows, names="vec_id long, embedding array<double>"):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], names)


def all_pairs(vectors, queries, k, floor):
    unit = lambda v: np.asarray(v, float) / np.linalg.norm(v)
    out = []
    for q, x in queries:
        s = [(-round(float(np.clip(unit(v) @ unit(x), 0, 1)), 6), i) for i, v in vectors]
        out += [(q, i, -c, r) for r, (c, i) in enumerate(sorted(x for x in s if -x[0] > floor)[:k], 1)]
    return out


@pytest.mark.parametrize("spread", [0.1, 3.0])
def test_same_rows_as_all_pairs(spark, spread):
    r = np.random.default_rng(1)
    centres = r.normal(size=(12, 16))
    vectors = [(i, centres[i % 12] + spread * r.normal(size=16)) for i in range(600)]
    vectors += [(1000 + i, vectors[3][1] * 2) for i in range(40)]  # one direction many times: ties
    queries = [(i, vectors[i][1]) for i in range(0, 600, 60)] + [(9000, -vectors[0][1])]
    index = vector_index.build(table(spark, vectors + [(5000, np.zeros(16)), (5001, None)]), cells=30)
    found, reports = vector_index.search(index, table(spark, queries, "query_id long, query array<double>"), 7, floor=0.1, block=6)
    got = sorted(map(tuple, found.collect()))
    want = sorted(all_pairs(vectors, queries, 7, 0.1))
    assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=2e-6)
    assert sum(x["queries"] for x in reports) == len(queries) and len(reports) > 1
    if spread < 1:  # the vectors have structure: most cells stay unread
        assert sum(x["vectors_met"] for x in reports) < 0.3 * sum(x["all_pairs"] for x in reports)


def test_empty(spark):
    index = vector_index.build(table(spark, []))
    found, _ = vector_index.search(index, table(spark, [(1, [1.0])], "query_id long, query array<double>"), 3)
    assert found.count() == 0
    some = vector_index.build(table(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])]))
    found, reports = vector_index.search(some, table(spark, [], "query_id long, query array<double>"), 3)
    assert found.count() == 0 and reports == []


def test_nearest_centroid_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(entity, "CENTRES_AT_ONCE", 2)
    vectors = table(spark, [(1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])])
    centres = spark.createDataFrame([(7, [1.0, 0.0]), (3, [0.0, 1.0]), (9, [-1.0, 0.0])], "k long, centroid array<double>")
    got = {r.id: (r.k, round(r.score, 6)) for r in entity.nearest_centroid(vectors, centres, "k", "embedding", "vec_id").collect()}
    assert got == {1: (7, 2.0), 2: (3, 1.0), 3: (3, 1.0)}
