"""Steps that have to stay whole and right on large and odd tables."""

import math

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import entity
from shelfspark.plans import catalog, catalog_more  # noqa: F401


def test_titles_are_judged_once_for_each_pair(spark):
    rows = spark.createDataFrame([(f"{i}-{k}", i, k, None if k == 3 else f"epsilon wh100{i % 2}x pro" if k else f"zz-200{i}q thing", k) for i in range(6) for k in range(4)], "listing_id string, product_id long, source int, title string, captured int")
    products = spark.createDataFrame([(i, f"epsilon wh100{i % 2}x pro") for i in range(6)], "product_id long, title string")
    verdicts = entity.title_verdicts(rows.join(products.withColumnRenamed("title", "own"), "product_id"), "own", "title")
    assert verdicts.count() == 8 and {(r["own"] == r["title"]) == r["same"] == r["fits"] for r in verdicts.collect()} == {True}
    kept = {r["listing_id"] for r in entity.detached(rows, products).where("keep").collect()}
    assert kept == {f"{i}-{k}" for i in range(6) for k in (1, 2)}


def test_queries_alike_have_one_answer(spark):
    from shelfspark.plans import search

    rows = [(5, "chair", None), (3, "chair", None), (7, "chair", [1.0]), (9, None, None), (8, "desk", [1.0]), (6, "desk", [1.0])]
    asked = spark.createDataFrame(rows, "query_id long, query string, query_embedding array<double>")
    assert {(r["query_id"], r["class_id"]) for r in search.members(asked).collect()} == {(5, 3), (3, 3), (7, 7), (9, 9), (8, 6), (6, 6)}


def test_vectors_of_typed_queries_make_no_classes(spark):
    """Vectors tell the decisions of queries apart only where no product type is named; pairs and membership hold what each query alone gives."""
    from shelfspark.plans import search

    rows = [(5, "office chair", [1.0, 0.0]), (3, "office chair", [0.0, 1.0]), (7, "office chair", None), (9, "gizmo", [1.0, 0.0]), (8, "gizmo", [0.0, 1.0]), (6, "gizmo", [0.0, 1.0]), (4, None, [1.0, 0.0]), (2, "sony chair", [1.0, 1.0]), (1, "sony chair", [0.0, 1.0])]
    asked = spark.createDataFrame(rows, "query_id long, query string, query_embedding array<double>")
    titles = ["Office chair", "Sony office chair", "Chair gizmo cover", "Big gizmo", "gizmo large office tool", "Desk"]
    listings = spark.createDataFrame([(i, t, None, 500 + i, [float(i % 2), 1.0]) for i, t in enumerate(titles * 3)], "id long, title string, details string, price_minor long, embedding array<double>")
    listings = listings.selectExpr("*", "id % 2 source", "true has_image", "'in_stock' availability", "20 reviews", "4.5D rating", "false cached")
    of, one = search.role_classes(asked)
    classes = {(r["query_id"], r["class_id"]) for r in of.collect()}
    assert classes == {(5, 3), (3, 3), (7, 3), (9, 9), (8, 6), (6, 6), (4, 4), (2, 1), (1, 1)}
    columns = ("query_id", "id", "role", "confidence", "lexical", "quality")
    pairs = {tuple(r) for r in search.eligible_candidates(listings, one).select(*columns).collect()}
    got = {(q, *p[1:]) for q, c in classes for p in pairs if p[0] == c}
    for q in (5, 9, 2):
        alone = {tuple(r) for r in search.eligible_candidates(listings, asked.where(F.col("query_id") == q)).select(*columns).collect()}
        assert {p for p in got if p[0] == q} == alone and (alone or q == 9)


def test_search_of_a_text_is_done_once(spark, monkeypatch):
    """Queries of a typed text that differ by their vectors share candidates and ranks, and get what each would get by itself."""
    from shelfspark.operators import ranking
    from shelfspark.plans import search

    vectors = [[1.0, 0.0], None, [0.2, 0.9], [0.0, 0.0], [], [1.0], [-1.0, 0.1], [0.6, 0.6], None]
    titles = ["Office chair", "Sony office chair", "Chair gizmo cover", "Office chair leather", "Big gizmo", "Oak desk", "Office chair refurbished"]
    listings = spark.createDataFrame([(i, titles[i % 7], None, 500 + 37 * i, vectors[i % 9]) for i in range(40)], "id long, title string, details string, price_minor long, embedding array<double>")
    listings = listings.selectExpr("*", "id % 3 source", "id % 2 = 0 has_image", "'in_stock' availability", "id % 5 reviews", "4.5D rating", "false cached")
    rows = [(5, "office chair", [1.0, 0.0]), (3, "office chair", [0.0, 1.0]), (7, "office chair", None), (8, "office chair", [0.0, 0.0]), (11, "office chair", [0.0, 1.0]), (9, "gizmo", [1.0, 0.0]), (6, "desk", [0.5, 0.5])]
    asked = spark.createDataFrame(rows, "query_id long, query string, query_embedding array<double>")
    native = listings.select("id", "source", (F.floor(F.col("id") / 3) + 1).alias("rank"))
    columns = ("query_id", "key", "id", "position", "relaxed", F.round("base", 8), F.round("final", 8))
    want = {tuple(r) for r in ranking.ranked(search.search_block(listings, asked, None, 2, native), 12, search.PER_SOURCE).select(*columns).collect()}
    seen, real = [], search.channels
    monkeypatch.setattr(search, "channels", lambda c, n=None: (seen.append({r["query_id"] for r in c.select("query_id").distinct().collect()}), real(c, n))[1])
    got = [tuple(r) for r in search.search(listings, asked, results=12, sources=2, native=native).select(*columns).collect()]
    assert set(got) == want and len(got) == len(want) and {r[0] for r in want} >= {3, 5, 6, 7, 8, 11}
    assert {3, 6} in seen and all(len(s) <= 2 for s in seen)


def test_only_exact_listings_of_models_and_brands(spark):
    from shelfspark.plans import spec

    rows = [(1, "m", None, "exact"), (1, "m", None, "substitute"), (2, None, "b", "exact"), (2, None, "b", "substitute"), (3, None, None, "exact"), (3, None, None, "substitute"), (4, "m", "b", "substitute")]
    rows += [(5, None, "b", "exact")] * 10 + [(5, None, "b", "substitute")]
    kept = spec.exact_only(spark.createDataFrame(rows, "query_id long, model string, brand string, role string"))
    assert sorted((r["query_id"], r["role"]) for r in kept.collect()) == sorted([(1, "exact"), (2, "exact"), (2, "substitute"), (3, "exact"), (3, "substitute"), (4, "substitute")] + [(5, "exact")] * 10)


def test_part_is_dealt_out_by_its_rows(spark, tmp_path):
    from shelfspark import session, tables

    n = 4 * session.ROWS_A_TASK + 1
    spark.range(n).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    part = tables.table(spark, str(tmp_path), "part")
    assert part.rdd.getNumPartitions() == 5 and part.count() == n


def odd_events(path):
    """Events with equal times, times within one millisecond, missing values and types, and means that lie on a half."""
    import duckdb

    halves = [(a, x) for a in range(1, 400) for x in range(1, 4000, 7) if math.floor(0.8 * a + 0.2 * (x / 2) + 0.5) != math.floor(0.8 * a + (1 - 0.8) * (x / 2) + 0.5)]
    assert halves
    rows = []
    for user, (a, x) in enumerate(halves[:40]):
        rows += [(user, 0, "error", float(a)), (user, 60_000_000, "error", x / 2)]
    # order within a millisecond against that of the ids; equal times; no value, no type
    rows += [(100, 500, "error", 10.0), (100, 100, "click", 900.0), (100, 100, "error", 30.0), (100, 900, "error", 70.0)]
    rows += [(101, 0, "error", None), (101, 1_000_000, "error", float("nan")), (101, 2_000_000, None, 40.0), (101, 3_000_000, "error", 60.0), (101, 4_000_000, "error", None)]
    rows += [(102, 0, "error", -5.6), (102, 1_000, "error", -7.3)]
    c = duckdb.connect()
    c.execute("create table t (event_id bigint, us bigint, user_id bigint, event_type varchar, value double)")
    c.executemany("insert into t values (?, ?, ?, ?, ?)", [(7 if user == 100 and us == 100 else i, us, user, kind, v) for i, (user, us, kind, v) in enumerate(rows)])
    c.execute(f"copy (select event_id, timestamp '2024-01-01' + to_microseconds(us) as ts, user_id, event_type, value, '' as props from t) to '{path}/events.parquet' (format parquet)")
    c.execute(f"create view events as select * from read_parquet('{path}/events.parquet')")
    return c


@pytest.mark.parametrize("name", ["ewma_latency", "stream_breakers"])
def test_means_of_odd_events(spark, tmp_path, name):
    c = odd_events(tmp_path)
    got = {tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()}
    want = {tuple(r) for r in c.execute(catalog.ORACLE[name]).fetchall()}
    assert got == want


def test_lexical_evidence_has_every_pair(spark):
    from shelfspark.functions import scoring
    from shelfspark.operators import retrieval

    docs = spark.createDataFrame([(1, "Red shoes, red laces"), (2, "A thing"), (3, None), (4, ""), (5, "redshoe")], "doc_id long, text string")
    asked = spark.createDataFrame([(10, "red shoe"), (20, "the"), (30, None)], "query_id long, query string")
    got = {(r["query_id"], r["doc_id"]): round(r["score"], 9) for r in retrieval.lexical_evidence(docs, asked).collect()}
    rows = docs.crossJoin(asked).select("query_id", "doc_id", scoring.lexical_score(F.coalesce("query", F.lit("")), F.coalesce("text", F.lit(""))).alias("s"))
    assert got == {(r["query_id"], r["doc_id"]): 0.0 if r["query_id"] == 20 else round(r["s"], 9) for r in rows.collect()} and len(got) == 15


def test_repeated_cards_drop_out_before_any_shuffle(spark):
    from shelfspark.sources import payloads

    card = lambda n: f'<li class="s-card" data-listingid={n}><a href=https://www.shop.com/itm/{n}?q=1>x</a></li>'
    pages = spark.createDataFrame([(1, card(5) + card(6) + card(5)), (2, card(6)), (3, None)], "page_id long, html string")
    cut = payloads._cut(pages, "html", r'<li class="s-card[^"]*"[^>]*\bdata-listingid="?[0-9]+', r'data-listingid="?([0-9]+)')
    assert {(r["page_id"], r["pos"], r["external_id"]) for r in cut.collect()} == {(1, 0, "5"), (1, 1, "6"), (2, 0, "6")}
    assert "Exchange" not in cut._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")


def test_index_moves_texts_and_packed_blocks_only(spark):
    from shelfspark.operators import posting_index

    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), F.col("id") % 7, F.lit(" other word"), F.col("id") % 7).alias("text"))
    index = posting_index.build(docs)
    assert index.blocks.agg(F.sum(F.size("ids"))).collect()[0][0] == 600
    assert {tuple(r) for r in index.blocks.where("term = 'word3'").select(F.explode(F.arrays_zip("ids", "tfs"))).select("col.ids", "col.tfs").collect()} == {(i, 2) for i in range(3, 300, 7)}
    plan = posting_index.packed(index.texts.withColumn("slice", F.col("id") % 3), index.mean_length, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(slice" in plan
