"""Registered queries: image hashes, checks of benchmark files, SQL functions, the payload data source."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sql_functions
from ..operators import bundles, evaluation, gates, images, lookup, relational
from ..session import shared_path
from ..sources import payload_source, payloads
from ..tables import OFFERS_SQL, minor, offers, table
from .catalog import query


@query("""
WITH p AS (
  SELECT vec_id, 10 + vec_id % 4 AS w, 9 + vec_id % 3 AS h,
    list_transform(range((10 + vec_id % 4) * (9 + vec_id % 3)), lambda j: ((CAST(floor(1000 * CAST(embedding[j * 7 % 64 + 1] AS DOUBLE)) AS BIGINT) + 13 * j) % 256 + 256) % 256) AS px
  FROM embeddings),
s AS (
  SELECT vec_id, list_transform(range(72), lambda q: list_sum(list_transform(range(w * h), lambda j: px[j + 1]
      * greatest(0, least((j % w + 1) * 9, (q % 9 + 1) * w) - greatest(j % w * 9, q % 9 * w))
      * greatest(0, least((j // w + 1) * 8, (q // 9 + 1) * h) - greatest(j // w * 8, q // 9 * h))))) AS v
  FROM p),
b AS (SELECT vec_id, list_transform(range(64), lambda k: CAST(v[k // 8 * 9 + k % 8 + 1] < v[k // 8 * 9 + k % 8 + 2] AS INT)) AS bits FROM s)
SELECT vec_id, array_to_string(list_transform(range(16), lambda g: substr('0123456789abcdef', 1 + 8 * bits[4 * g + 1] + 4 * bits[4 * g + 2] + 2 * bits[4 * g + 3] + bits[4 * g + 4], 1)), '') AS hash,
  list_sum(bits) BETWEEN 4 AND 60 AS useful
FROM b
""")
def image_dhash(spark, sf_dir):
    """Difference hash of a grey image of several sizes for every vector."""
    w, h = (10 + F.col("vec_id") % 4).cast("int"), (9 + F.col("vec_id") % 3).cast("int")
    value = lambda j: F.pmod(F.floor(1000 * F.element_at("embedding", (j * 7 % 64 + 1).cast("int")).cast("double")) + 13 * j, F.lit(256))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", w.alias("w"), h.alias("h"), F.transform(F.sequence(F.lit(0), w * h - 1), value).alias("px"))
    hashed = rows.select("vec_id", images.difference_hash(F.col("px"), F.col("w"), F.col("h")).alias("h"))
    return hashed.select("vec_id", images.hex_hash(F.col("h")).alias("hash"), F.bit_count("h").between(4, 60).alias("useful"))


#: What is wrong in a file of each kind: (path, rule).
FAULTS = (
    (),
    (("$", "object"),),
    (("$.version", "version"), ("$.cases", "cases")),
    (("$.cases[1].id", "duplicate id"),),
    (("$.cases[1].expectedIntent", "intent"), ("$.cases[1].slices", "slices")),
    (("$.cases[1].mission.requiredSlots", "required slots"),),
    (("$.cases[1].id", "id"), ("$.cases[1].query", "query"), ("$.cases[1].relevanceRules", "relevance rules"), ("$.cases[1].idealRelevance", "ideal relevance")),
)


@query(f"""
WITH f(k, path, rule) AS (VALUES {", ".join(f"({k}, '{p}', '{r}')" for k, some in enumerate(FAULTS) for p, r in some)})
SELECT item_id AS file, path, rule FROM benchmark JOIN f ON k = item_id % {len(FAULTS)}
""")
def benchmark_rules(spark, sf_dir):
    """V5: files made of every benchmark item, one kind of fault after another, read back and checked."""
    good = '{"id": "a", "query": %s, "slices": [], "expectedIntent": "product", "relevanceRules": [], "idealRelevance": {"x": 1}}'
    second = (
        '{"id": "b", "query": "q", "slices": ["s"], "expectedIntent": "mission", "relevanceRules": [], "idealRelevance": {"x": 1}, "mission": {"requiredSlots": ["s"]}}',
        None,
        None,
        '{"id": "a", "query": "q", "slices": [], "expectedIntent": "product", "relevanceRules": [], "idealRelevance": {"x": 1}}',
        '{"id": "b", "query": "q", "slices": "s", "expectedIntent": "buy", "relevanceRules": [], "idealRelevance": {"x": 1}}',
        '{"id": "b", "query": "q", "slices": [], "expectedIntent": "mission", "relevanceRules": [], "idealRelevance": {"x": 1}, "mission": {"requiredSlots": []}}',
        '{"id": "", "slices": [], "expectedIntent": "product", "relevanceRules": {}}',
    )
    k = F.col("item_id") % len(FAULTS)
    text = F.to_json(F.struct(F.col("text").alias("t")))
    quoted = F.expr("substring(j, 6, length(j) - 6)")
    body = F.when(k == 1, F.concat(F.lit('{"version": 1, "cases": ['), quoted)).when(k == 2, F.concat(F.lit('{"version": "x", "cases": {"q": '), quoted, F.lit("}}")))
    for i, other in enumerate(second):
        if other:
            head, tail = good.split("%s")
            body = body.when(k == i, F.concat(F.lit('{"version": 2, "cases": [' + head), quoted, F.lit(tail + ", " + other + "]}")))
    path = shared_path(spark, "benchmarks")
    table(spark, sf_dir, "benchmark").withColumn("j", text).select("item_id", F.to_json(F.struct(body.alias("body"))).alias("value")).write.partitionBy("item_id").text(path)
    files = spark.read.schema("value string, item_id long").text(path).select(F.col("item_id").alias("file"), F.get_json_object("value", "$.body").alias("body"))
    return evaluation.benchmark_violations(files)


@query("""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="(/[^"]*)">[^<]*</a></li>', 1)) AS href, unnest(regexp_extract_all(html, '<li><a href="/[^"]*">([^<]*)</a></li>', 1)) AS title,
    generate_subscripts(regexp_extract_all(html, '<li><a href="(/[^"]*)">[^<]*</a></li>', 1), 1) AS place FROM pages)
SELECT page_id, place - 1 AS place, title, trim(regexp_replace(strip_accents(lower(title)), '[^a-z0-9]+', ' ', 'g')) AS plain, 'example.net' AS host
FROM l WHERE place <= 12 AND trim(regexp_replace(strip_accents(lower(title)), '[^a-z0-9]+', ' ', 'g')) <> ''
""")
def sql_cards(spark, sf_dir):
    """Cards of every page by SQL alone: the table function and scalar functions."""
    sql_functions.register(spark)
    table(spark, sf_dir, "pages").createOrReplaceTempView("captured_pages")
    return spark.sql("""
        SELECT page_id, c.place, c.title, normalized_text(c.title) AS plain, url_host(c.url) AS host
        FROM captured_pages, LATERAL selector_cards(html, '{"baseUrl": "http://www.example.net", "card": "nav li", "title": "a", "link": "a"}') c
        WHERE text_key(c.title) <> ''
    """)


@query("""
SELECT 's' || (p_partkey % 6) AS source, CASE WHEN p_partkey % 10 <> 7 THEN 'P' || p_partkey END AS external_id, CASE WHEN p_partkey % 10 <> 7 THEN p_name END AS title,
  CASE WHEN p_partkey % 10 NOT IN (3, 7) THEN CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) END AS price_minor, p_partkey % 10 = 7 AS broken
FROM part WHERE p_partkey % 6 IN (1, 4)
""")
def payload_files(spark, sf_dir):
    """G1: payload files of six sources, written and read by the data source; two sources by a filter that is pushed down."""
    payload_source.register(spark)
    path = shared_path(spark, "payloads")
    k = F.col("p_partkey") % 10
    price = F.when(k == 3, None).otherwise(F.concat(F.lit("$"), F.format_number("p_retailprice", 2)))
    body = F.when(k == 7, F.concat(F.lit("not a payload "), "p_name")).otherwise(F.to_json(F.struct(F.concat(F.lit("P"), "p_partkey").alias("id"), F.col("p_name").alias("title"), price.alias("price"))))
    table(spark, sf_dir, "part").select(F.concat(F.lit("s"), F.col("p_partkey") % 6).alias("source"), body.alias("value")).write.partitionBy("source").text(path)
    found = spark.read.format("payloads").option("path", path).load().where(F.col("source").isin("s1", "s4"))
    return found.select("source", "external_id", "title", "price_minor", F.col("broken").isNotNull().alias("broken"))


@query(f"""
WITH p AS (SELECT p_partkey AS page_id, p_name, 'shop' || (p_partkey % 5) || '.example' AS host, CASE WHEN p_partkey % 9 > 0 THEN CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) END AS price, CASE WHEN p_partkey % 4 = 0 THEN 'EUR' ELSE 'USD' END AS currency FROM part),
o AS (
  SELECT product_id AS page_id, external_id AS id, l_orderkey, price_minor, CASE WHEN source_id % 3 = 0 THEN 'EUR' WHEN source_id % 7 = 0 THEN 'CHF' ELSE 'USD' END AS currency, 'store ' || (source_id % 6) AS store,
    CASE WHEN source_id % 2 = 0 THEN 'www.' ELSE 'm.' END || 'shop' || (source_id % 5) || '.example' AS host, (l_orderkey * 37 + l_linenumber * 13 + product_id % 3 * 40) % 80 / 100.0 - 0.05 * (product_id % 3) AS score, l_returnflag
  FROM {OFFERS_SQL}),
k AS (
  SELECT o.*, p.p_name || ' ' || l_returnflag AS title, floor(score / 0.05) AS band FROM o JOIN p USING (page_id)
  WHERE score >= 0.35 AND price_minor > 0 AND regexp_replace(o.host, '^www[.]', '') <> p.host AND NOT regexp_replace(o.host, '^www[.]', '') LIKE '%.' || p.host),
s AS (SELECT page_id, count(DISTINCT store) AS stores FROM k GROUP BY 1),
u AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY page_id, store, lower(title[:40]) ORDER BY band DESC, price_minor, id) = 1),
a AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY band DESC, price_minor, id) AS rank FROM u QUALIFY rank <= 8),
f AS (SELECT a.*, p.currency AS own, max(a.currency = p.currency) OVER (PARTITION BY page_id) AS same FROM a JOIN p USING (page_id)),
c AS (SELECT * FROM f WHERE score >= 0.5 AND (NOT same OR currency = own) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY price_minor, rank) = 1),
n AS (SELECT page_id, count(*) AS alternatives FROM a GROUP BY 1),
r AS (
  SELECT p.page_id, coalesce(alternatives, 0) AS alternatives, coalesce(stores, 0) AS stores, c.id AS cheapest_id, c.price_minor AS cheapest_minor, c.store, c.currency AS of,
    CASE WHEN c.currency = p.currency AND c.price_minor < p.price THEN p.price - c.price_minor END AS savings_minor, p.currency
  FROM p LEFT JOIN n USING (page_id) LEFT JOIN s USING (page_id) LEFT JOIN c USING (page_id)),
w AS (SELECT *, coalesce(savings_minor, cheapest_minor) AS shown, CASE WHEN savings_minor > 0 THEN currency ELSE of END AS code FROM r)
SELECT page_id, alternatives, stores, cheapest_id, cheapest_minor, store, savings_minor,
  CASE WHEN cheapest_id IS NULL THEN CASE WHEN stores = 0 THEN 'No other stores found this' ELSE 'Compared across stores — no clear cheaper option' END
  ELSE CASE WHEN savings_minor > 0 THEN 'Save ' ELSE 'From ' END || CASE code WHEN 'USD' THEN '$' || format('{{:,}}', shown // 100) WHEN 'EUR' THEN '€' || format('{{:,}}', shown // 100) ELSE CAST(shown // 100 AS VARCHAR) END
    || '.' || lpad(CAST(shown % 100 AS VARCHAR), 2, '0') || CASE WHEN code = 'CHF' THEN ' CHF' ELSE '' END || ' at ' || store END AS headline
FROM w
""")
def page_lookup(spark, sf_dir):
    """Cheaper offers for the page of every part: cut-offs, host rule, currencies, and the four headlines."""
    k, s = F.col("p_partkey"), F.col("source_id")
    pages = table(spark, sf_dir, "part").select(
        k.alias("page_id"), "p_name", F.concat(F.lit("shop"), k % 5, F.lit(".example")).alias("host"), F.when(k % 9 > 0, minor("p_retailprice")).alias("price_minor"), F.when(k % 4 == 0, "EUR").otherwise("USD").alias("currency")
    )
    score = ((F.col("l_orderkey") * 37 + F.col("l_linenumber") * 13 + F.col("product_id") % 3 * 40) % 80 / 100.0) - 0.05 * (F.col("product_id") % 3)
    rows = offers(spark, sf_dir).join(pages.select(F.col("page_id").alias("product_id"), "p_name"), "product_id").select(
        F.col("product_id").alias("page_id"),
        F.col("external_id").alias("id"),
        F.concat_ws(" ", "p_name", "l_returnflag").alias("title"),
        "price_minor",
        F.when(s % 3 == 0, "EUR").when(s % 7 == 0, "CHF").otherwise("USD").alias("currency"),
        F.concat(F.lit("store "), s % 6).alias("store"),
        F.concat(F.lit("https://"), F.when(s % 2 == 0, "www.").otherwise("m."), F.lit("shop"), s % 5, F.lit(".example/p")).alias("url"),
        score.alias("score"),
    )
    return lookup.lookup(pages.drop("p_name"), rows)


@query("""
WITH r AS (SELECT p_partkey AS request_id, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE (p_partkey % 25) || ',x,' || (p_partkey % 7 + 100) || ',' || (p_partkey % 3) END AS asked FROM part),
n AS (SELECT DISTINCT request_id, unnest(string_split(asked, ',')) AS name FROM r WHERE asked IS NOT NULL)
SELECT request_id, n_nationkey FROM n JOIN nation ON CAST(n_nationkey AS VARCHAR) = name
UNION ALL SELECT request_id, n_nationkey FROM r, nation WHERE asked IS NULL
""")
def request_sources(spark, sf_dir):
    """Known sources of every request's list, all without one."""
    k = F.col("p_partkey")
    asked = F.when(k % 4 != 0, F.concat_ws(",", k % 25, F.lit("x"), k % 7 + 100, k % 3))
    return gates.requested_sources(table(spark, sf_dir, "part").select(k.alias("request_id"), asked.alias("asked")), table(spark, sf_dir, "nation"), "n_nationkey")


@query("""
WITH t AS (SELECT conv_id % 9 AS topic, conv_id, turn, length(text) % 5 > 0 AS ok FROM conversations),
p AS (SELECT * FROM t WHERE ok QUALIFY row_number() OVER (PARTITION BY topic, conv_id ORDER BY turn, conv_id) <= 10)
SELECT topic, conv_id, turn, row_number() OVER (PARTITION BY topic ORDER BY turn, conv_id) AS rank FROM p QUALIFY rank <= 24
""")
def discussion_topics(spark, sf_dir):
    """Snippets of each topic, ten of a discussion and 24 altogether; what failed doesn't count."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 9).alias("topic"), "conv_id", "turn", (F.length("text") % 5 > 0).alias("ok"))
    found = relational.gathered(rows, "topic", "conv_id", [F.asc("turn"), F.asc("conv_id")])
    return found.select("topic", "conv_id", "turn", F.col("rank").cast("long").alias("rank"))


@query(f"""
WITH f AS (SELECT product_id AS mission_id, l_linenumber % 3 AS slot, external_id AS id, CASE WHEN source_id % 5 = 0 THEN 0 ELSE price_minor END AS price_minor, CASE source_id % 4 WHEN 0 THEN 'EUR' WHEN 1 THEN NULL ELSE 'USD' END AS currency FROM {OFFERS_SQL})
SELECT mission_id, slot, id, price_minor, coalesce(currency, 'USD') AS currency, row_number() OVER (PARTITION BY mission_id, slot ORDER BY price_minor, id) AS rank
FROM f WHERE price_minor > 0 AND (mission_id % 2 = 0 AND slot <> 1 OR currency = 'USD') QUALIFY rank <= 8
""")
def slot_candidates(spark, sf_dir):
    """Offers of each mission's slots, eight at most; in dollars where the slot has a bound."""
    o = offers(spark, sf_dir)
    s = F.col("source_id")
    found = o.select(F.col("product_id").alias("mission_id"), (F.col("l_linenumber") % 3).alias("slot"), F.col("external_id").alias("id"), F.when(s % 5 == 0, 0).otherwise(F.col("price_minor")).alias("price_minor"), F.when(s % 4 == 0, "EUR").when(s % 4 != 1, "USD").alias("currency"))
    slots = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("mission_id"), F.explode(F.array(*map(F.lit, range(3)))).alias("slot"))
    slots = slots.withColumns({"min_price": F.when(F.col("mission_id") % 2 == 1, 100), "max_price": F.when(F.col("slot") == 1, 5000)})
    chosen = bundles.slot_candidates(found, slots, [F.asc("price_minor"), F.asc("id")])
    return chosen.select("mission_id", "slot", "id", "price_minor", "currency", F.col("rank").cast("long").alias("rank"))


@query("""
WITH r AS (
  SELECT p_brand, p_partkey, p_brand LIKE '%1' AS mission, CASE WHEN p_partkey % 13 = 0 THEN '  ' ELSE p_name END AS title, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_type END AS store,
    CASE p_partkey % 6 WHEN 0 THEN 'javascript:x' WHEN 1 THEN 'http://10.0.0.1/p' WHEN 2 THEN 'https://u:p@shop.example/p' ELSE 'https://shop.example/p' || p_partkey END AS url,
    CASE p_partkey % 3 WHEN 0 THEN 'from $5' WHEN 1 THEN NULL ELSE '' END AS price, CASE WHEN p_partkey % 4 > 0 THEN p_size * 12345 END AS price_minor, CASE p_partkey % 5 WHEN 0 THEN 'EUR' WHEN 1 THEN NULL WHEN 2 THEN 'CHF' ELSE 'USD' END AS currency,
    CASE WHEN p_partkey % 7 = 0 THEN 'http://localhost/i' ELSE 'https://img.example/' || p_partkey END AS image_url
  FROM part),
s AS (
  SELECT p_brand, p_partkey, mission, title, store, url, CASE WHEN image_url LIKE 'https%' THEN image_url END AS image_url,
    CASE WHEN price <> '' THEN price WHEN price_minor IS NOT NULL AND currency IS NOT NULL THEN
      CASE currency WHEN 'USD' THEN '$' WHEN 'EUR' THEN '€' ELSE '' END || CASE WHEN currency = 'CHF' THEN CAST(price_minor // 100 AS VARCHAR) ELSE format('{:,}', price_minor // 100) END || '.' || lpad(CAST(price_minor % 100 AS VARCHAR), 2, '0')
      || CASE WHEN currency = 'CHF' THEN ' CHF' ELSE '' END ELSE 'Price unavailable' END AS price
  FROM r WHERE trim(title) <> '' AND store IS NOT NULL AND url LIKE 'https://shop.%')
SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rank, title, store, url, price, image_url FROM s QUALIFY rank <= CASE WHEN mission THEN 5 ELSE 6 END
""")
def result_previews(spark, sf_dir):
    """Previews of results: safe addresses only, price texts, six of a search and five of a mission."""
    k = F.col("p_partkey")
    url = F.when(k % 6 == 0, "javascript:x").when(k % 6 == 1, "http://10.0.0.1/p").when(k % 6 == 2, "https://u:p@shop.example/p").otherwise(F.concat(F.lit("https://shop.example/p"), k))
    rows = table(spark, sf_dir, "part").select(
        "p_brand", "p_partkey", F.when(k % 13 == 0, "  ").otherwise(F.col("p_name")).alias("title"), F.when(k % 17 != 0, F.col("p_type")).alias("store"), url.alias("url"),
        F.when(k % 3 == 0, "from $5").when(k % 3 == 2, "").alias("price"), F.when(k % 4 > 0, F.col("p_size") * 12345).alias("price_minor"),
        F.when(k % 5 == 0, "EUR").when(k % 5 == 2, "CHF").when(k % 5 > 2, "USD").alias("currency"), F.when(k % 7 == 0, "http://localhost/i").otherwise(F.concat(F.lit("https://img.example/"), k)).alias("image_url"),
    )
    found = gates.previews(rows, "p_brand", [F.asc("p_partkey")], F.col("p_brand").endswith("1"))
    return found.withColumn("rank", F.col("rank").cast("long"))


#: Hosts and pages of products: N is a name, P a price, W a name that isn't the product's.
PAGE_FORMS = (
    ("www.amazon.com/dp/N1", '<h1 id="title">W</h1><span id="productTitle" class="a b"> N </span><span class="a-price x"><span class="a-offscreen">$P</span></span>'),
    ("amazon.de/gp/x", '<span id="productTitle">  </span><h1 id="title">N</h1><b id="priceblock_dealprice">P</b><meta property="og:type" content="Product.item"><meta content="eur" property="og:price:currency">'),
    ("www.ebay.com/itm/1", '<h1 class="x-item-title__mainTitle"><span>N</span></h1><div class="x-price-primary"><span>US $P</span></div>'),
    ("ebay.co.uk/sch", '<h1 itemprop="name">N</h1><meta itemprop="price" content="P"><meta property="product:price:currency" content=" gbp ">'),
    ("www.etsy.com/listing/9", '<h1>W</h1><h1 data-buy-box-listing-title="x">N</h1><div data-buy-box-region="p"><p class="wt-text-title-03 c">$P</p></div>'),
    ("bestbuy.com/x", '<div class="sku-title"><h1>N</h1></div><div data-testid="customer-price"><span>$P</span></div><div itemtype="https://schema.org/Product"></div>'),
    ("target.com/p/a", '<!-- <h1>W</h1> --><h1>N</h1><span data-test="product-price">$P</span>'),
    ("shop.example/c/12345678", '<script>"<h1>W</h1>"</script><h1>W</h1><meta property="og:title" content="N"><meta property="product:price:amount" content="P">'),
    ("shop.example/c", "<title>W</title><h1>N</h1>"),
)


@query(f"""
WITH p AS (SELECT p_partkey AS page_id, p_partkey % {len(PAGE_FORMS)} AS k, p_name, CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) AS price FROM part)
SELECT page_id, p_name AS title, CASE WHEN k < 8 AND price > 0 THEN price END AS price_minor, CASE k WHEN 1 THEN 'EUR' WHEN 3 THEN 'GBP' ELSE 'USD' END AS currency,
  ['amazon.com', 'amazon.de', 'ebay.com', 'ebay.co.uk', 'etsy.com', 'bestbuy.com', 'target.com', 'shop.example', 'shop.example'][k + 1] AS host, k NOT IN (3, 8) AS looks_like_product
FROM p
""")
def host_pages(spark, sf_dir):
    """Title, price and currency of product pages by the places of their hosts, with metadata behind them."""
    k = (F.col("p_partkey") % len(PAGE_FORMS) + 1).cast("int")
    form = lambda i: F.element_at(F.array(*(F.lit(x[i]) for x in PAGE_FORMS)), k)
    html = F.replace(F.replace(F.replace(form(1), F.lit("P<"), F.concat(F.format_number("p_retailprice", 2), F.lit("<"))), F.lit('"P"'), F.concat(F.lit('"'), F.format_number("p_retailprice", 2), F.lit('"'))), F.lit("N<"), F.concat("p_name", F.lit("<")))
    html = F.replace(F.replace(html, F.lit('"N"'), F.concat(F.lit('"'), "p_name", F.lit('"'))), F.lit(" N "), F.concat(F.lit(" "), "p_name", F.lit(" ")))
    pages = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("https://"), form(0)).alias("url"), html.alias("html"))
    return payloads.product_page(pages).drop("clean")
