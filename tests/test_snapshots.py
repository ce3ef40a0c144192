"""The bucketed snapshot: order and repetition of batches change nothing, reads stay bounded."""

import itertools
import os
import random

from shelfspark.streaming import snapshots

ROWS = [(k, at, f"v{k}-{at}") for k in range(9) for at in range(5)]
SCHEMA = "k int, at int, v string"


def state(spark, path):
    return {(r.k, r.at, r.v) for r in snapshots.latest(spark, path).collect()}


def test_batches_in_any_order(spark, tmp_path):
    r = random.Random(1)
    rows = ROWS[:]
    r.shuffle(rows)
    parts = [rows[i::3] for i in range(3)]
    want = {(k, 4, f"v{k}-4") for k in range(9)}
    for n, order in enumerate(list(itertools.permutations(range(3)))[::2]):
        path = f"file://{tmp_path}/t{n}"
        for number, i in enumerate(order):
            for _ in range(2):  # every batch runs twice
                snapshots.merge(spark.createDataFrame(parts[i], SCHEMA), path, number, ["k"], ["at"], 4)
        assert state(spark, path) == want


def test_reads_and_vacuum(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    for number in range(5):
        snapshots.merge(spark.createDataFrame([(k, number, "x") for k in range(20)], SCHEMA), path, number, ["k"], ["at"], 4)
    versions, buckets = snapshots.manifest(spark, path)
    assert buckets == 4 and len(versions) <= 4 and set(versions.values()) == {4}
    assert len(snapshots.latest(spark, path).inputFiles()) <= 4
    assert snapshots.vacuum(spark, path) == [0, 1, 2]
    assert state(spark, path) == {(k, 4, "x") for k in range(20)} and not os.path.exists(f"{tmp_path}/t/rows/version=0")
    snapshots.merge(spark.createDataFrame([], SCHEMA), path, 5, ["k"], ["at"])
    assert state(spark, path) == {(k, 4, "x") for k in range(20)}


def test_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    snapshots.merge(spark.createDataFrame([], SCHEMA), path, 0, ["k"], ["at"])
    assert state(spark, path) == set()
    snapshots.merge(spark.createDataFrame([(1, 1, None)], SCHEMA), path, 1, ["k"], ["at"])
    assert state(spark, path) == {(1, 1, None)}
