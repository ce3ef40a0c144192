"""Text, scoring, roles, ranking, entities, bundles, evaluation and sources on small literal tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfspark.functions import scoring, text
from shelfspark.operators import bundles, entity, evaluation, posting_index, ranking, relational, retrieval
from shelfspark.plans import search, spec
from shelfspark.sources import payloads
from shelfspark.streaming import flows, snapshots
from tests_data import SMALL


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'long' if isinstance(v, int) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("y")).first().y


@pytest.mark.parametrize(
    "raw, clean",
    [("[Headphones] Airpods Pro - $169 (Starts at 7PM) + Free Shipping w/ Prime", "Airpods Pro"), ("Standing Desk 50% off at Walmart.com", "Standing Desk"), ("sale", "sale"), ("Kettle (Open Box) from Best Buy", "Kettle"), ("", "")],
)
def test_normalize_title(spark, raw, clean):
    assert one(spark, text.normalize_title(F.col("t")), t=raw).strip(" -+") == clean


@pytest.mark.parametrize(
    "raw, low, high",
    [
        ("tv between $500 and $200", 20000, 50000),
        ("shoes under $1,000", None, 100000),
        ("laptop at least 300 dollars", 30000, None),
        ("phone pro max 256gb", None, None),
        ("chair max $50", None, 5000),
        ("desk over 100 below 250.50", 10000, 25050),
    ],
)
def test_price_bounds(spark, raw, low, high):
    assert one(spark, text.price_bound(F.col("q"), "min"), q=raw) == low and one(spark, text.price_bound(F.col("q"), "max"), q=raw) == high


@pytest.mark.parametrize("raw, want", [("$1,299.99", 129999), ("1.299,99 €", 129999), ("USD 45", 4500), ("1,299", 129900), ("£12.5", 1250), ("1.299", 129900), ("free", 0)])
def test_storefront_price(spark, raw, want):
    assert one(spark, text.storefront_price(F.col("p")), p=raw) == want


@pytest.mark.parametrize(
    "url, safe",
    [
        ("https://shop.example.com/a", True),
        ("http://192.168.1.4/x", False),
        ("https://user:pw@a.example.com", False),
        ("ftp://a.example.com", False),
        ("http://localhost/x", False),
        ("http://printer.local", False),
        ("http://10.0.0.1", False),
        ("http://8.8.8.8/", True),
        ("nonsense", False),
        ("http://172.20.0.1/", False),
    ],
)
def test_safe_url(spark, url, safe):
    assert one(spark, text.safe_url(F.col("u")), u=url) is safe


def test_scalars(spark):
    assert one(spark, text.extract_asin(F.col("u")), u="https://a.example.com/dp/b0abcdefgh?x=1") == "B0ABCDEFGH"
    assert one(spark, text.normalize_search(F.col("t")), t="Café — Größe 5!") == "cafe gro e 5"
    assert one(spark, text.meaningful_tokens(F.col("t")), t="The best shoes for me under $50") == ["best", "shoes"]
    assert one(spark, text.has_token_overlap(F.col("q"), F.lit("Garmin Watch band")), q="watches") is False
    assert one(spark, text.has_token_overlap(F.col("q"), F.lit("Garmin Watch band")), q="bands") is True
    assert one(spark, text.negations(F.col("t")), t="boots but not leather, no laces and I am not sure") == ["leather", "laces"]
    assert one(spark, text.condition(F.col("t")), t="open box or used") == "open-box"
    assert one(spark, text.identity_tokens(F.col("t")), t="Sony WH-1000XM5 64gb") == ["wh1000xm5", "1000xm5"]
    assert one(spark, text.title_fingerprint(F.col("t")), t="The New Black Widget 5") == "widget"
    assert one(spark, text.includes_phrase(F.col("t"), "boots"), t="one boot") is True and one(spark, text.includes_phrase(F.col("t"), "boot"), t="bootleg") is False
    assert one(spark, scoring.price_band(F.col("p")), p=9999) == "price:value" and one(spark, scoring.price_band(F.col("p")), p=0) is None
    assert one(spark, scoring.clamp(F.col("x")), x=float("nan")) == 0.0 and one(spark, scoring.semantic(F.col("x")), x=-0.2) == pytest.approx(0.4)
    assert one(spark, scoring.jaccard(F.col("a"), F.array().cast("array<string>"), 1.0), a=["x"]) == 0.0
    assert one(spark, scoring.lexical_score(F.col("q"), F.lit("Sony WH-1000XM5 wireless headphones")), q="wh 1000xm5 headphone") > 0.6
    assert one(spark, scoring.query_specificity(F.col("q")), q="chair") < one(spark, scoring.query_specificity(F.col("q")), q="sony wh1000xm5 model") <= 1
    assert one(spark, text.slim_markup(F.col("h")), h="<p style='x'>a</p><script>b</script>") == "<p>a</p>"
    assert one(spark, text.ocr_text(F.col("w"), F.array(F.lit(90), F.lit(95), F.lit(10))), w=["Garmin", "Forerunner", "zz"]) == "Garmin Forerunner"


CASES = [
    ("playstation 5 console", "Sony PlayStation 5 Console Disc Edition", 49900, "exact", True),
    ("playstation 5 console", "Wireless Controller for PS5", 6900, "complement", False),
    ("controller for ps5", "DualSense wireless controller for PS5", 6900, "exact", True),
    ("controller for ps5", "Wireless controller for Xbox Series X", 5900, "irrelevant", False),
    ("leather boots", "Men's leather Chelsea boots", 15000, "exact", True),
    ("leather boots", "Faux leather boots", 5000, "irrelevant", False),
    ("boots under $100", "Hiking boots", 15000, "irrelevant", False),
    ("boots under $100", "Hiking boots", 0, "irrelevant", False),
    ("boots", "Running shoes", 9000, "substitute", True),
    ("boots", "Boot care kit polish for boots", 2000, "complement", False),
    ("nike running shoes", "Adidas running shoes", 9000, "substitute", False),
    ("used laptop", "Dell laptop", 30000, "irrelevant", False),
    ("used laptop", "Dell laptop pre-owned", 30000, "exact", True),
    ("office chair not mesh", "Mesh office chair", 20000, "irrelevant", False),
    ("monitor", "Monitor arm clamp", 5000, "complement", False),
    ("headphones", "Cotton shirt", 1500, "irrelevant", False),
    ("sony wh-1000xm5 headphones", "Sony WH-1000XM5 over-ear headphones", 30000, "exact", True),
    ("noise cancelling headphones", "Bose headphones with ANC", 30000, "exact", True),
]


def test_roles(spark):
    queries = spec.parse_queries(spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "query_id int, query string"))
    listings = spark.createDataFrame([(i, c[1], None, c[2]) for i, c in enumerate(CASES)], "query_id int, title string, details string, price_minor long")
    got = {r.query_id: r for r in spec.classified(listings.join(queries, "query_id")).collect()}
    for i, c in enumerate(CASES):
        assert (got[i].role, got[i].eligible) == (c[3], c[4]), (c, got[i].reason)


def test_specs(spark):
    rows = [(1, "Sony headphnes under $200 not wired"), (2, "furnish my home office"), (3, "keyboard, mouse and monitor"), (4, "vegan leather tote bag"), (5, "case for iphone 15 pro")]
    s = {r.query_id: r for r in spec.parse_queries(spark.createDataFrame(rows, "query_id int, query string")).collect()}
    assert (s[1].product_type, s[1].brand, s[1].max_price, s[1].must_not) == ("headphones", "Sony", 20000, ["wired"])
    assert s[2].kind == "mission" and s[3].kind == "list" and s[3].product_type is None
    assert "vegan leather" in s[4].must and "leather" not in s[4].must and s[5].compatible == ["iPhone"]
    v = spec.parse_queries(spark.createDataFrame([(1, "wireless headphones")], "query_id int, query string")).select(
        spec.query_variants(F.col("refined"), F.col("must"), F.col("brand"), F.col("model"), F.col("product_type")).alias("v")
    ).first().v
    assert v[0] == "wireless headphones" and len(v) == len(set(v)) <= 4
    i = spark.createDataFrame(rows, "query_id int, query string").select("query_id", spec.intent(F.col("query"))["intent"].alias("i")).collect()
    assert {r.query_id: r.i for r in i} == {1: "product", 2: "mission", 3: "mission", 4: "product", 5: "product"}


def test_bm25_ranks(spark):
    docs = spark.createDataFrame([(1, "red gps watch"), (2, "watch watch watch and a very long story about other things that nobody needs"), (3, "chairs")], "doc_id long, text string")
    found = posting_index.search(posting_index.build(docs), spark.createDataFrame([(7, "gps watch")], "query_id long, query string")).collect()
    assert [(r.id, r["rank"]) for r in found] == [(1, 1), (2, 2)]


def test_fusion(spark):
    rows = spark.createDataFrame([(1, 1, "a", 1), (1, 1, "b", 2), (1, 2, "a", 2), (1, 3, "c", 1), (1, 4, "a", 0)], "query_id int, id int, channel string, rank int")
    got = {r.id: r.rrf for r in retrieval.reciprocal_rank_fusion(rows, {"a": 2.0, "b": -1.0}).collect()}
    assert got[1] == pytest.approx((2 / 61) / (3 / 61)) and got[3] == pytest.approx(1 / 3) and 4 not in got


def test_mmr_keeps_caps_and_permutes():
    r = np.random.default_rng(0)
    n = 40
    pdf = pd.DataFrame(
        {
            "query_id": 1,
            "id": range(n),
            "base": r.random(n),
            "embedding": list(r.standard_normal((n, 4))),
            "aspects": [[f"a{i % 3}"] for i in range(n)],
            "source": [f"s{i % 4}" for i in range(n)],
            "model": [f"m{i % 20}" for i in range(n)],
            "key": [f"{i:03}" for i in range(n)],
            "words": [[f"w{i % 9}"] for i in range(n)],
            "lam": 0.7,
        }
    )
    out = ranking.mmr_order(pdf, 12, 3, 1)
    assert len(out) == 12 == out["id"].nunique() and list(out["position"]) == list(range(1, 13))
    free = out[~out["relaxed"]]
    picked = pdf.set_index("id").loc[free["id"]]
    assert picked["source"].value_counts().max() <= 3 and picked["model"].value_counts().max() == 1
    assert out.iloc[0]["id"] == pdf.sort_values("base").iloc[-1]["id"]
    alike = pdf.assign(embedding=[[1.0, 0.0]] * n, aspects=[[]] * n, words=[["w"]] * n, source=[str(i) for i in range(n)], model=None)
    assert list(ranking.mmr_order(alike.assign(lam=0.9), 10, 3, 1)["id"]) == list(pdf.sort_values("base", ascending=False)["id"][:10])


def brute_mmr(rows, lam, results, per_source, per_model):
    """The definition, place after place, with all pairs compared anew."""

    def share(x, y):
        return len(set(x) & set(y)) / len(set(x) | set(y)) if x and y else 0.0

    def alike(x, y):
        if x["model"] is not None and x["model"] == y["model"]:
            return 1.0
        titles, tags = share(x["words"], y["words"]), share(x["aspects"], y["aspects"])
        u, v = x["embedding"], y["embedding"]
        if not u or not v:
            return 0.75 * titles + 0.25 * tags
        cosine = sum(a * b for a, b in zip(u, v)) / (sum(a * a for a in u) * sum(b * b for b in v)) ** 0.5
        return 0.65 * min(1, max(0, cosine)) + 0.25 * titles + 0.1 * tags

    picks = []
    while len(picks) < min(results, len(rows)):
        scored = []
        for x in (x for x in rows if x not in picks):
            seen = [a for p in picks for a in p["aspects"]]
            gain = sum(1 / (1 + seen.count(a)) for a in x["aspects"]) / len(x["aspects"]) if x["aspects"] else 0.0
            final = lam * x["base"] + (1 - lam) * (0.6 * (1 - max([0, *(alike(x, p) for p in picks)])) + 0.4 * gain)
            full = sum(p["source"] == x["source"] for p in picks) >= per_source or x["model"] is not None and sum(p["model"] == x["model"] for p in picks) >= per_model
            scored.append((full, -round(final, 12), -x["base"], x["key"], x))
        picks.append(min(scored, key=lambda s: s[:4])[4])
    return [p["id"] for p in picks]


def test_diversified_order_against_brute_force(spark, monkeypatch):
    r = np.random.default_rng(4)
    rows = [{
        "query_id": q,
        "id": 100 * q + i,
        "key": f"k{i:03}",
        "base": float(r.integers(40, 100)) / 100,
        "words": [f"w{w}" for w in set(r.integers(0, 8, 3))],
        "aspects": [f"a{a}" for a in set(r.integers(0, 5, r.integers(0, 3)))],
        "embedding": None if i % 7 == 0 else r.standard_normal(5).tolist(),
        "source": f"s{r.integers(3)}",
        "model": None if i % 3 == 0 else f"m{r.integers(9)}",
        "lam": 0.6 + q / 10,
    } for q in (1, 2) for i in range(30 + 10 * q)]
    df = spark.createDataFrame(rows, "query_id long, id long, key string, base double, words array<string>, aspects array<string>, embedding array<double>, source string, model string, lam double")
    want = {q: brute_mmr([x for x in rows if x["query_id"] == q], 0.6 + q / 10, 9, 3, 1) for q in (1, 2)}
    for pool, most in ((500, 500), (45, 500), (10, 500), (10, 20)):  # in one task; one query of each kind; by the bound; by places where the bound doesn't help
        monkeypatch.setattr(ranking, "MOST", most)
        got = ranking.diversify(df, None, 9, 3, 1, pool).orderBy("position").collect()
        assert {q: [x.id for x in got if x.query_id == q] for q in (1, 2)} == want
    gated = ranking.gated(df, F.lit(0.8), 0.5)
    found = ranking.ranked(gated, 60, 3, 1).orderBy("position").collect()
    for q in (1, 2):
        mine, own = [x for x in found if x.query_id == q], [x for x in rows if x["query_id"] == q and x["base"] >= 0.5]
        top = max(x["base"] for x in own)
        near = [x for x in own if x["base"] >= top * 0.8]
        tail = [x["id"] for x in sorted((x for x in own if x not in near), key=lambda x: (-x["base"], x["key"]))]
        assert [x.id for x in mine] == [*brute_mmr(near, 0.6 + q / 10, 60, 3, 1), *tail] and [x.position for x in mine] == list(range(1, len(own) + 1))


def test_keys(spark):
    t, b = F.col("t"), F.lit("Sony")
    assert one(spark, ranking.canonical_key(t, b, F.lit(None).cast("string"), {"upc": F.lit("00-12 "), "gtin": F.lit("")}), t="New Black Kettle") == "upc:0012"
    assert one(spark, ranking.canonical_key(t, b, F.lit("WH 1"), {"asin": F.lit(None).cast("string")}), t="x") == "model:sony:wh 1"
    assert one(spark, ranking.canonical_key(t, F.lit(None).cast("string"), F.lit(None).cast("string"), mpn=F.lit("A 7")), t="x") == "model:unknown:a7"
    assert one(spark, ranking.canonical_key(t, b, F.lit(" ")), t="New Black Kettle") == "title:" + one(spark, text.title_fingerprint(t), t="New Black Kettle")


def test_entities(spark):
    a = spark.createDataFrame([(i, (0x0F0F0F0F0F0F0F0F ^ sum(1 << b for b in range(i)))) for i in range(9)], "id long, hash long")
    got = {(r.left_id, r.right_id, r.distance) for r in entity.hamming_pairs(a, a).collect()}
    assert got == {(i, j, abs(i - j)) for i in range(9) for j in range(9) if abs(i - j) <= 6}
    unit = entity.centroids(spark.createDataFrame([("x", [3.0, 0.0]), ("x", [0.0, 4.0])], "k string, v array<double>"), "k", "v").first().centroid
    assert unit == pytest.approx([0.6, 0.8])


def test_bundles_stay_in_the_budget(spark):
    rows = [("m", s, 10 * s + k, f"t{s}{k}", 100 * (k + 1), "USD", 1 - k / 10, k + 1) for s in range(3) for k in range(4)]
    c = spark.createDataFrame(rows, "mission_id string, slot int, id long, title_key string, price_minor long, currency string, score double, rank int")
    combos = bundles.combinations(c, 3, budget_max=600, budget_min=400)
    totals = [r.total for r in combos.collect()]
    assert totals and all(400 <= t <= 600 for t in totals)
    assert {r.choice for r in bundles.choices(combos, 600).collect()} <= {"balanced", "value", "premium"}
    assert bundles.combinations(c.where("slot != 1"), 3).count() == 0


def test_evaluation(spark):
    results = spark.createDataFrame(
        [("a", 1, 3, True, 0, "e1", "s1"), ("a", 2, 0, False, 1, "e1", "s2"), ("a", 3, 2, True, 0, "e2", "s2"), ("a", 4, 1, True, 0, "e3", "s3"), ("a", 5, 0, False, 0, "e4", "s1")],
        "case_id string, position int, grade long, relevant boolean, leaked int, entity string, source string",
    )
    r = evaluation.precision_and_leakage(results).first()
    assert (r.precision, r.leakage, round(r.duplicates, 9), r.entities, r.sources) == (0.6, 0.2, 0.2, 4, 3)
    assert evaluation.ndcg(results, results.select("case_id", "grade")).first().ndcg < 1
    runs = spark.createDataFrame([("a", 1, "x", 1), ("a", 1, "y", 2), ("a", 2, "y", 1), ("a", 2, "z", 2)], "case_id string, run_id int, result_id string, position int")
    assert evaluation.repeatability(runs).first().repeatability == pytest.approx(1 / 3)
    slots = spark.createDataFrame([("a", "s1"), ("a", "s2"), ("a", "s3")], "case_id string, slot_id string")
    items = spark.createDataFrame([("a", "b1", "s1"), ("a", "b1", "s2"), ("a", "b1", "s3"), ("a", "b2", "s1")], "case_id string, bundle_id string, slot_id string")
    assert evaluation.complete_bundles(items, slots).first().rate == 0.5
    assert evaluation.slot_coverage(items.where("slot_id != 's3'"), slots).first().coverage == pytest.approx(2 / 3)
    label = evaluation.relevance_label(F.col("t"), [{"label": "exact", "any_phrases": ["gps watch"], "none_phrases": ["band"]}, {"label": "substitute", "all_terms": ["watch"]}])
    assert [one(spark, label, t=t) for t in ("Garmin GPS watch", "gps watch band", "chair")] == ["exact", "substitute", "irrelevant"]


def test_reliability(spark):
    log = spark.createDataFrame(
        [("s", i, ok, v) for i, (ok, v) in enumerate([(False, 100), (False, 200), (False, 100), (True, 50)])],
        "source string, at int, ok boolean, latency long",
    ).withColumn("ts", F.timestamp_seconds(F.col("at") * 10))
    runs = relational.failure_streaks(log, "source", "ts", "at", F.col("ok")).orderBy("at").collect()
    assert [r.run for r in runs] == [1, 2, 3, 0] and [r.open_until is not None for r in runs] == [False, False, True, False]
    assert relational.ewma(log, "source", ["at"], "latency").first().ewma == 103


def test_sources(spark):
    html = "<ul><li class='c'><h2>Good <b>one</b></h2><a href='/p/1'>x</a><span class='p'>$12.50</span><img src='/i.png'></li><li class='c'><h2>Evil</h2><a href='https://evil.example.org/'>x</a></li><li class='c'><a href='/p/3'>x</a></li></ul>"
    config = {"baseUrl": "https://shop.example.com", "card": "li.c", "title": "h2", "link": "a", "price": "span.p", "image": "img"}
    pages = spark.createDataFrame([(1, "https://shop.example.com/s", html), (2, "https://shop.example.com/t", None)], "page_id long, url string, html string")
    rows = payloads.selector_listings(pages, config).collect()
    assert [(r.title, r.url, r.price_minor, r.image_url) for r in rows] == [("Good one", "https://shop.example.com/p/1", 1250, "https://shop.example.com/i.png")]
    ld = '<script type="application/ld+json">[{"@graph":[{"@type":"Product","name":"A","url":"/a","offers":{"lowPrice":"1,299.00"}},{"@type":["Product"],"name":"A2","url":"/a"}]}, {"bad"]</script><script type="application/ld+json">{"@type":"Product","name":"B","url":"/b","offers":[{"price":0},{"priceSpecification":{"price":5}}]}</script>'
    assert [(p["title"], p["price_minor"]) for p in payloads.jsonld_products(ld, "https://x.example.com")] == [("B", 500)]
    card = '<li data-id="77"><h3>Lamp</h3><a href="/itm/77">x</a> $5.00</li><li data-id="78"><h3>No</h3><a href="/itm/1">x</a></li>'
    assert [(r.external_id, r.price_minor) for r in payloads.html_cards(spark.createDataFrame([(1, card)], "page_id long, html string")).collect()] == [("77", 500)]


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"runs":[{"caseId":"c1","runId":"r","results":[{"resultId":"x"}]}]}')
    (tmp_path / "b.json").write_text('[{"caseId":"c2"}]')
    assert {r.caseId for r in payloads.read_runs(spark, str(tmp_path)).collect()} == {"c1", "c2"}
    assert payloads.read_within(spark, str(tmp_path), 20).count() == 1


def test_upsert_stream(spark, tmp_path):
    q = snapshots.upsert_sink(flows.events(spark, SMALL), f"{tmp_path}/out", f"{tmp_path}/state", ["user_id"], ["ts", "event_id"])
    q.awaitTermination()
    got = snapshots.latest(spark, f"{tmp_path}/out")
    want = flows.events(spark, SMALL).isStreaming and spark.read.parquet(f"{SMALL}/events.parquet").groupBy("user_id").agg(F.max("ts").alias("ts"))
    assert {(r.user_id, r.ts) for r in got.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts")).collect()} == {(r.user_id, r.ts) for r in want.collect()}
    flows.part(got.limit(3), f"{tmp_path}/again", 0)
    flows.part(got.limit(3), f"{tmp_path}/again", 0)
    assert spark.read.parquet(f"{tmp_path}/again").count() == 3
    assert got.count() == got.select("user_id").distinct().count() == spark.read.parquet(f"{SMALL}/events.parquet").select("user_id").distinct().count()


def test_search_plan(spark):
    listings = spark.createDataFrame(
        [(1, "Sony WH-1000XM5 headphones", None, 30000, "a"), (2, "Bose headphones", None, 20000, "b"), (3, "Cotton shirt with headphones print", None, 1000, "a"), (4, "Office chair", None, 9000, "b")],
        "id long, title string, details string, price_minor long, source string",
    ).selectExpr("*", "true has_image", "'in_stock' availability", "20 reviews", "4.5D rating", "false cached", "cast(null as array<double>) embedding")
    found = search.search(listings, spark.createDataFrame([(1, "headphones"), (2, "chair under $50")], "query_id long, query string").selectExpr("*", "cast(null as array<double>) query_embedding")).collect()
    assert {(r.query_id, r.id) for r in found} == {(1, 1), (1, 2)} and sorted(r.position for r in found) == [1, 2]
    asked = spark.createDataFrame([(1, "headphones")], "query_id long, query string").selectExpr("*", "cast(null as array<double>) query_embedding")
    judge = lambda pool: pool.select("query_id", "id", F.when(F.col("id") == 2, 1.0).otherwise(0.0).alias("relevance"))
    assert [r.id for r in search.search(listings, asked, judge).orderBy("position").collect()][0] == 2


def test_query_blocks(spark):
    q = spark.createDataFrame([(i, "x") for i in range(25)], "query_id long, query string")
    seen = []
    out = retrieval.in_blocks(q, lambda part: (seen.append(1), part.select("query_id"))[1], 10)
    assert len(seen) == 3 and sorted(r.query_id for r in out.collect()) == list(range(25))


def test_tools(spark):
    from shelfspark import api

    assert api.tool_arguments("search_products", {"query": "  desk ", "max_results": "99"}) == {"query": "desk", "max_results": 10}
    assert api.tool_arguments("drop_table", {"query": "x"}) is None and api.tool_arguments("find_cheaper", {"query": " "}) is None
    assert [api.routed(m)[0] for m in ("which stores do you know?", "find this cheaper", "furnish my office", "red shoes")] == ["list_sources", "find_cheaper", "run_shopping_mission", "search_products"]
    assert api.canaries(["Nike Store", "A1"])[:2] == ["nike", "shoes"] and api.bounded_millis("5000", 100, 0, 9000) == 5000 and api.bounded_millis("x", 100, 0, 9000) == 100
    assert api.keyed_query_hash("A  b", b"k") == api.keyed_query_hash("a b", b"k") != api.keyed_query_hash("a b", b"j")
    listings = spark.createDataFrame(
        [(1, "Oak standing desk", None, 30000, "a"), (2, "Pine standing desk", None, 20000, "b"), (3, "Office chair", None, 9000, "a"), (4, "Mesh office chair", None, 15000, "b")],
        "id long, title string, details string, price_minor long, source string",
    ).selectExpr("*", "true has_image", "'in_stock' availability", "20 reviews", "4.5D rating", "false cached", "cast(null as array<double>) embedding")
    assert [r.id for r in api.find_cheaper(listings, "Oak standing desk | Amazon", 30000, "a").collect()] == [2]
    found = api.run_shopping_mission(listings, ["standing desk", "office chair"], 40000).collect()
    assert found and all(r.total <= 40000 and len(r.ids) == 2 for r in found)
