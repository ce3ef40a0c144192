"""The corpus pipeline over the small tables, stage by stage."""

import os

from pyspark.sql import functions as F

import corpus_pipeline
from shelfspark.llm import common, decontamination, queries
from tests_data import SMALL


def test_stages(spark):
    docs = common.table(spark, SMALL, "documents")
    columns = docs.columns
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = common.materialize(stage(spark, docs, SMALL), f"test-{name}")
        after = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(after) == len(set(after)) and set(after) <= before and after
        if stage is not corpus_pipeline.encoded:
            assert docs.columns == columns
        if name == "exact_dedup":
            assert docs.count() == docs.select("text").distinct().count()
        if name == "decontamination":
            assert decontamination.leaks(docs, common.table(spark, SMALL, "benchmark")).isEmpty()
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) == sorted(map(tuple, docs.collect()))


def test_empty(spark):
    docs = common.table(spark, SMALL, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0


def test_null_and_repeated_ids(spark):
    rows = [(None, "one"), (None, "two"), (None, "two"), (5, "alpha beta"), (5, "gamma"), (5, "gamma"), (5, "gam ma"), (2, "alpha  beta"), (7, None), (7, ""), (8, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.without_copies(spark, docs, SMALL)
    left = sorted(map(tuple, got.collect()), key=str)
    assert [r for r in left if r[0] not in (7, 8)] == sorted([(None, "one"), (None, "two"), (None, "two"), (5, "gam ma"), (2, "alpha  beta")], key=str)
    assert len([r for r in left if r[0] in (7, 8)]) == 1


def test_edges_of_every_stage(spark):
    """Null ids and texts, one id with two texts, repeated rows, a very long text, clashing columns: defined for each stage."""
    long = "word " * 40_000 + "end"
    rows = [
        (None, "nobody one"),
        (None, "nobody two"),
        (None, None),
        (3, "alpha beta gamma"),
        (3, "delta epsilon"),
        (4, long),
        (4, long),
        (5, None),
        (6, ""),
        (7, "one two three four five six seven eight"),
        (8, "One two three four five six seven eight"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clashing = ("i", "t", "fp", "node", "component", "text_sha256", "place_of_row", "keep_id", "kept", "predicted", "score", "item_id", "n", "a", "b", "lang", "dotted.name", "a`tick")
    for c in clashing:
        docs = docs.withColumn(c, F.lit("x"))
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        if name != "sentencepiece":
            assert out.columns == docs.columns
        left[name] = sorted(((r.doc_id, r.text) for r in out.collect()) if name != "sentencepiece" else ((r.doc_id, r.n_tokens) for r in out.collect()), key=str)
    every = sorted(rows, key=str)
    assert left["toxicity"] == every and left["decontamination"] == every
    without = lambda *gone: sorted((r for r in dict.fromkeys(rows) if r not in gone), key=str)
    assert left["exact_dedup"] == without((6, ""))
    assert left["near_dedup"] == sorted((r for r in rows if r not in ((6, ""), (8, rows[-1][1]))), key=str)
    assert len(left["sentencepiece"]) == len(rows) and (5, 2) in left["sentencepiece"]


def test_oracles(spark):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        c.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    for name, sql in queries.oracle_sql().items():
        got, want = queries.queries()[name](spark, SMALL), c.execute(sql).fetchall()
        names = [d[0] for d in c.description]
        assert sorted(map(str, map(tuple, got.select(*names).collect()))) == sorted(map(str, want)) and sorted(names) == sorted(got.columns)


def test_clear(spark):
    common.materialize(spark.range(3).toDF("x"), "kept")
    path = common._written[-1].removeprefix("file://")
    assert os.path.exists(path)
    common.clear(spark)
    assert not os.path.exists(path)


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{k}" for k in range(1, 14)]
