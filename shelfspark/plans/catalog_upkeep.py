"""Further registered queries: result pages of markets, missions, judged scores, labels, and the upkeep of products."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import text
from ..operators import entity, evaluation, gates, ranking, relational as rel
from ..sources import payloads
from ..tables import OFFERS_SQL, offers, table
from . import missions, spec
from .catalog import cents_sql, query

# Result pages


@query(
    f"""SELECT p_partkey AS page_id, 'B0' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS external_id, p_name || ' & co' AS title, {cents_sql('p_retailprice')} AS price_minor, CASE WHEN p_size % 2 = 0 THEN p_size / 10.0 END AS rating, CASE WHEN p_size % 3 = 0 THEN 1000 + p_size END AS reviews FROM part WHERE p_partkey % 10 <> 9"""
)
def market_scan(spark, sf_dir):
    """Cards of a market's result pages with the title in one of four places; challenge pages give none."""
    k, size, price = F.col("p_partkey"), F.col("p_size"), F.format_number("p_retailprice", 2)
    name = F.concat("p_name", F.lit(" &amp; co"))
    number = F.concat(F.lit("B0"), F.lpad(k.cast("string"), 8, "0"))
    wrap = lambda a, b: F.concat(F.lit(a), name, F.lit(b))
    title = F.when(k % 4 == 0, wrap('<h2 class="x" aria-label="', '"></h2>')).when(k % 4 == 1, wrap("<h2><a>\n<span>", "</span></a></h2>")).when(k % 4 == 2, wrap('<span class="a-size-base-plus a-text">', "</span>")).otherwise(
        wrap('<h2 aria-label=""><b></b></h2><span class="a-size-medium">', "</span>")
    )
    stars = F.when(size % 2 == 0, F.concat((size / 10.0).cast("string"), F.lit(" out of 5 stars"))).otherwise("")
    ratings = F.when(size % 3 == 0, F.concat(F.lit('<a aria-label="1,0'), F.lpad(size.cast("string"), 2, "0"), F.lit(' ratings">'))).otherwise("")
    start = lambda n: F.concat(F.lit('<div data-asin="'), n, F.lit('" data-x="1" data-component-type="s-search-result">'))
    page = F.concat(
        F.lit("<html>"),
        start(number),
        title,
        F.lit('<span class="a-offscreen">$'),
        price,
        F.lit('</span><span class="a-offscreen">$9.99</span>'),
        stars,
        ratings,
        F.lit("</div>"),
        start(F.lit("B0NOTITLE1")),
        F.lit('<span class="a-offscreen">$1.00</span></div>'),
        F.when(k % 10 == 9, "Sorry, we just need to make sure you are no robot").otherwise(""),
    )
    return payloads.market_cards(table(spark, sf_dir, "part").select(k.alias("page_id"), page.alias("html"))).select("page_id", "external_id", "title", "price_minor", "rating", "reviews")


@query(
    f"""SELECT p_partkey AS page_id, CAST(1000 + p_partkey AS VARCHAR) AS external_id, p_name AS title, {cents_sql('p_retailprice')} AS price_minor, CASE WHEN p_size % 2 = 0 THEN 'in_stock' END AS availability, CASE WHEN p_size % 3 = 0 THEN '/later.jpg' ELSE '/shown.jpg' END AS image_url FROM part"""
)
def auction_scan(spark, sf_dir):
    """Cards of an auction site's result pages; placeholders and repeated cards drop out."""
    k, size = F.col("p_partkey"), F.col("p_size")
    number = (k + 1000).cast("string")
    card = lambda n, link, title: F.concat(
        F.lit('<li class="s-card s-card--x" id=a data-listingid='),
        n,
        F.lit("><a href=https://www.shop.com/itm/"),
        link,
        F.lit("?q=1>x</a><div role=heading class=s-card__title><span>"),
        title,
        F.lit("</span></div>"),
    )
    image = F.concat(F.lit("<img class=s-card__image src="), F.when(size % 3 == 0, "/fxxj3ttftm5ltcqnto1o4baovyl.png data-defer-load=/later.jpg").otherwise("/shown.jpg"), F.lit(" >"))
    real = F.concat(
        card(number, number, F.col("p_name")),
        image,
        F.lit('<div class=s-card__subtitle><span>'),
        F.when(size % 2 == 0, "Brand New").otherwise("Pre-owned"),
        F.lit('</span></div><span class="su-styled-text s-card__price">$'),
        F.format_number("p_retailprice", 2),
        F.lit(" to $9,999.00</span></li>"),
    )
    page = F.concat(F.lit("<ul>"), card(F.lit("77"), F.lit("123456"), F.lit("Shop here")), F.lit("</li>"), real, card(number, number, F.lit("again")), F.lit("</li></ul>"))
    return payloads.auction_cards(table(spark, sf_dir, "part").select(k.alias("page_id"), page.alias("html"))).select("page_id", "external_id", "title", "price_minor", "availability", "image_url")


# Missions

GOALS = (
    ("furnish a home office under $500", "bundle", "office desk|ergonomic office chair|task lamp"),
    ("gifts for a coffee lover", "alternatives", "coffee grinder|pour over coffee maker|coffee mug set"),
    ("equip a coffee station", "bundle", "coffee maker|coffee grinder|electric gooseneck kettle"),
    ("wedding outfit", "bundle", "linen shirt|dress pants|dress shoes"),
    ("outfit for fall", "bundle", "outfit top|outfit pants|outfit shoes"),
    ("monitor chair backpack", "bundle", "monitor|ergonomic office chair|laptop backpack"),
    ("ps5 or xbox, which one", "alternatives", "PlayStation 5 console|Xbox Series X console"),
    ("laptop backpack", "alternatives", "laptop backpack|practical laptop backpack|premium laptop backpack"),
)
GOAL_LIST_SQL = ", ".join(f"({i}, '{g}', '{c}', '{s}')" for i, (g, c, s) in enumerate(GOALS))


@query(f"""WITH g(k, goal, composition, slots) AS (VALUES {GOAL_LIST_SQL}), m AS (SELECT p_partkey, composition, unnest(string_split(slots, '|')) AS query, unnest(range(len(string_split(slots, '|')))) AS slot FROM part JOIN g ON p_partkey % 10 = k
UNION ALL SELECT p_partkey, 'bundle', unnest([p_name || ' kit essentials', p_name || ' kit accessories', p_name || ' kit storage']), unnest([0, 1, 2]) FROM part WHERE p_partkey % 10 = 8 UNION ALL SELECT p_partkey, 'alternatives', unnest([p_name, 'practical ' || p_name, 'premium ' || p_name]), unnest([0, 1, 2]) FROM part WHERE p_partkey % 10 = 9)
SELECT p_partkey, composition, CAST(slot AS BIGINT) AS slot, query FROM m""")
def mission_slots(spark, sf_dir):
    """Slots of missions by list, template and goal."""
    k = F.col("p_partkey") % 10
    goal = F.when(k == 8, F.concat("p_name", F.lit(" kit under $"), F.col("p_size").cast("string"))).when(k == 9, F.col("p_name"))
    for i, (text_, _, _) in enumerate(GOALS):
        goal = goal.when(k == i, text_)
    plans = missions.planned(table(spark, sf_dir, "part").select("p_partkey", goal.alias("mission")))
    return missions.slots(plans, "p_partkey").select("p_partkey", "composition", F.col("slot").cast("long").alias("slot"), "query")


# Judged scores and labels


@query("""WITH a AS (SELECT doc_id AS id, doc_id % 40 AS query_id, CASE WHEN doc_id % 40 < 20 AND (doc_id // 40) % 11 = 0 OR doc_id % 40 >= 20 AND (doc_id // 40) % 3 = 0 THEN NULL ELSE doc_id % 13 / 10.0 - 0.1 END AS score FROM labels), c AS (SELECT query_id FROM a GROUP BY 1 HAVING count(score) >= ceil(count(*) * 0.8))
SELECT id, query_id, round(least(1, greatest(0, coalesce(score, 0))), 6) AS relevance FROM a JOIN c USING (query_id)""")
def judge_coverage(spark, sf_dir):
    """A judge's scores count for a query of whose rows four fifths have one; what is missing is 0."""
    k = F.col("doc_id")
    rows = table(spark, sf_dir, "labels").select(k.alias("id"), (k % 40).alias("query_id"))
    part = F.floor(F.col("id") / 40)
    left_out = F.when(F.col("query_id") < 20, part % 11 == 0).otherwise(part % 3 == 0)
    scores = rows.where(~left_out).withColumn("score", F.col("id") % 13 / 10.0 - 0.1)
    return ranking.covered_scores(rows, scores).select("id", "query_id", F.round("relevance", 6).alias("relevance"))


RULES = [{"label": "exact", "any_phrases": ["blue bolt", "cold widget"], "none_phrases": ["promo"]}, {"label": "substitute", "all_terms": ["bolt"]}, {"label": "complement", "all_terms": ["widget", "economy"]}]


@query("""WITH p AS (SELECT p_partkey, ' ' || trim(regexp_replace(lower(p_name || CASE WHEN p_size % 2 = 0 THEN 's ' ELSE ' ' END || p_type), '[^a-z0-9]+', ' ', 'g')) || ' ' AS h, CASE WHEN p_partkey % 17 = 0 THEN 'irrelevant' END AS explicit FROM part)
SELECT p_partkey, coalesce(explicit, CASE WHEN (contains(h, ' blue bolt ') OR contains(h, ' cold widget ')) AND NOT contains(h, ' promo ') THEN 'exact' WHEN contains(h, ' bolt ') OR contains(h, ' bolts ') THEN 'substitute' WHEN (contains(h, ' widget ') OR contains(h, ' widgets ')) AND contains(h, ' economy ') THEN 'complement' ELSE 'irrelevant' END) AS label FROM p""")
def esci_labels(spark, sf_dir):
    """V1: labels by the first rule that a title with its evidence meets; an explicit label wins."""
    evidence = F.concat("p_name", F.when(F.col("p_size") % 2 == 0, "s ").otherwise(" "), "p_type")
    explicit = F.when(F.col("p_partkey") % 17 == 0, "irrelevant")
    return table(spark, sf_dir, "part").select("p_partkey", evaluation.relevance_label(evidence, RULES, explicit).alias("label"))


@query(
    """WITH i AS (SELECT o_custkey, o_orderkey, list_sort(list_distinct(list(l_linenumber % 4))) AS slots FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) SELECT o_custkey AS case_id, round(avg(CASE WHEN list_contains(slots, 1) AND list_contains(slots, 2) THEN 1.0 ELSE 0.0 END), 6) AS rate FROM i GROUP BY 1"""
)
def bundle_rate(spark, sf_dir):
    """V3: share of each customer's orders that fill both required slots."""
    items = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("case_id"),
        F.col("o_orderkey").alias("bundle_id"),
        (F.col("l_linenumber") % 4).alias("slot_id"),
    )
    slots = items.select("case_id").distinct().select("case_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("slot_id"))
    return evaluation.complete_bundles(items, slots).select("case_id", F.round("rate", 6).alias("rate"))


# Upkeep of products


@query(f"""WITH o AS (SELECT external_id, product_id, source_id, source_id % 9 AS brand_key FROM {OFFERS_SQL}), m AS (SELECT external_id, CASE WHEN l % 7 = 0 THEN NULL ELSE (product_id * 31 + 7) % (SELECT count(*) FROM part) END AS target FROM (SELECT *, CAST(split_part(external_id, '-', 1) AS BIGINT) + CAST(split_part(external_id, '-', 2) AS BIGINT) AS l FROM o) WHERE l % 5 = 0 OR l % 7 = 0),
a AS (SELECT o.external_id, o.source_id, CASE WHEN m.external_id IS NULL THEN o.product_id ELSE m.target END AS product_id FROM o LEFT JOIN m USING (external_id)), t AS (SELECT o.product_id FROM o JOIN m USING (external_id) WHERE o.product_id IS DISTINCT FROM m.target UNION SELECT m.target FROM o JOIN m USING (external_id) WHERE o.product_id IS DISTINCT FROM m.target AND m.target IS NOT NULL),
n AS (SELECT product_id, count(*) AS listing_count, count(DISTINCT source_id) AS source_count FROM a GROUP BY 1) SELECT t.product_id, CASE WHEN n.product_id IS NULL THEN 'delete' ELSE 'refresh' END AS action, coalesce(listing_count, 0) AS listing_count, coalesce(source_count, 0) AS source_count FROM t LEFT JOIN n USING (product_id)""")
def product_refresh(spark, sf_dir):
    """Products that moved or detached offers leave or reach, with their new aggregates, or deleted."""
    rows = offers(spark, sf_dir).select(F.col("external_id").alias("listing_id"), "product_id", F.col("source_id").alias("source"), (F.col("l_orderkey") + F.col("l_linenumber")).alias("n"))
    parts = table(spark, sf_dir, "part").count()
    moves = rows.where("n % 5 = 0 or n % 7 = 0").select("listing_id", F.when(F.col("n") % 7 != 0, (F.col("product_id") * 31 + 7) % parts).alias("product_id"))
    return entity.refreshed(rows.drop("n"), moves)


DETACH_SQL = """l AS (SELECT DISTINCT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS listing_id, l_partkey AS product_id, l_suppkey % 5 AS source, l_orderkey, l_linenumber, CASE l_orderkey % 4 WHEN 0 THEN 'alpha beta gamma delta wh-' || CAST(1000 + l_partkey % 500 AS VARCHAR) || 'x' WHEN 1 THEN 'other thing zz-' || CAST(2000 + l_orderkey % 50 AS VARCHAR) || 'q' WHEN 2 THEN 'epsilon wh' || CAST(1000 + l_partkey % 500 AS VARCHAR) || 'x pro' ELSE 'wh' || CAST(1000 + l_partkey % 500 AS VARCHAR) || 'x' END AS title, 'epsilon wh' || CAST(1000 + l_partkey % 500 AS VARCHAR) || 'x pro' AS own FROM lineitem)"""


@query(f"""WITH {DETACH_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY CASE WHEN title = own THEN 0 WHEN l_orderkey % 4 <> 1 THEN 1 ELSE 2 END, l_orderkey, l_linenumber, listing_id) AS r FROM l), c AS (SELECT product_id, source AS ks, l_orderkey % 4 = 1 AS odd, title AS kt FROM k WHERE r = 1),
f AS (SELECT k.*, row_number() OVER (PARTITION BY k.product_id, k.source ORDER BY l_orderkey, l_linenumber, listing_id) AS s FROM k JOIN c USING (product_id) WHERE r > 1 AND source <> ks AND CASE WHEN odd THEN title = kt ELSE l_orderkey % 4 <> 1 END) SELECT listing_id, listing_id IN (SELECT listing_id FROM k WHERE r = 1 UNION ALL SELECT listing_id FROM f WHERE s = 1) AS keep FROM l""")
def recluster_detach(spark, sf_dir):
    """Offers that stay with their product, and those to be resolved again."""
    k, model = F.col("l_orderkey") % 4, F.concat((F.col("l_partkey") % 500 + 1000).cast("string"), F.lit("x"))
    own = F.concat(F.lit("epsilon wh"), model, F.lit(" pro"))
    title = F.when(k == 0, F.concat(F.lit("alpha beta gamma delta wh-"), model)).when(
        k == 1,
        F.concat(F.lit("other thing zz-"), (F.col("l_orderkey") % 50 + 2000).cast("string"), F.lit("q")),
    ).when(k == 2, own).otherwise(F.concat(F.lit("wh"), model))
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("listing_id"),
        F.col("l_partkey").alias("product_id"),
        (F.col("l_suppkey") % 5).alias("source"),
        title.alias("title"),
        F.struct("l_orderkey", "l_linenumber").alias("captured"),
    ).distinct()
    products = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.concat(F.lit("epsilon wh"), (F.col("p_partkey") % 500 + 1000).cast("string"), F.lit("x pro")).alias("title"))
    return entity.detached(rows, products).select("listing_id", "keep")


MERGE_SQL = """h AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN NULL WHEN s_suppkey % 4 = 3 THEN -(s_suppkey // 8) - 1 ELSE s_suppkey END AS product, xor(CAST('0x' || substr(md5(CAST(s_suppkey // 4 AS VARCHAR)), 1, 15) AS BIGINT), CAST(1 AS BIGINT) << CAST(s_suppkey % 59 AS INT)) AS hash, CASE WHEN s_suppkey % 11 = 0 THEN 0 WHEN s_suppkey % 7 = 0 THEN 100000 ELSE 1000 + s_suppkey % 5 END AS price FROM supplier)"""


@query(f"""WITH {MERGE_SQL}, u AS (SELECT h.*, CASE WHEN product IS NULL THEN NULL ELSE count(*) OVER (PARTITION BY product) END AS members, bit_count(hash) BETWEEN 4 AND 60 AS useful FROM h),
m AS (SELECT a.id, a.product, a.price, b.id AS bid, b.product AS bproduct, b.price AS bprice, b.members AS bmembers, row_number() OVER (PARTITION BY a.id ORDER BY b.id) AS r FROM u a JOIN u b ON a.id <> b.id AND a.useful AND b.useful AND b.product IS NOT NULL AND (a.product IS NULL OR a.product <> b.product) AND bit_count(xor(a.hash, b.hash)) <= 6 WHERE coalesce(a.members, 1) = 1)
SELECT id AS listing_id, bproduct AS product_id FROM m WHERE r = 1 AND (price <= 0 OR bprice <= 0 OR price / bprice BETWEEN 0.25 AND 4) AND NOT (bmembers = 1 AND id < bid)""")
def late_hash_merge(spark, sf_dir):
    """Single offers move to the product of an image like theirs at a fitting price."""
    k = F.col("s_suppkey")
    common = F.conv(F.substring(F.md5(F.floor(k / 4).cast("long").cast("string").cast("binary")), 1, 15), 16, 10).cast("long")
    flip = F.call_function("shiftleft", F.lit(1).cast("long"), (k % 59).cast("int"))
    product = F.when(k % 4 == 0, None).when(k % 4 == 3, -F.floor(k / 8) - 1).otherwise(k).cast("long")
    price = F.when(k % 11 == 0, 0).when(k % 7 == 0, 100_000).otherwise(1000 + k % 5)
    return entity.late_merges(table(spark, sf_dir, "supplier").select(k.alias("listing_id"), product.alias("product_id"), common.bitwiseXOR(flip).alias("hash"), price.cast("long").alias("price_minor")))


@query(f"""WITH o AS (SELECT DISTINCT source_id, product_id, min(l_orderkey) OVER (PARTITION BY source_id, product_id) AS first FROM {OFFERS_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY first, product_id) AS k FROM o)
SELECT source_id, count(*) AS listings, array_to_string(list(product_id ORDER BY k) FILTER (WHERE k <= 3), '|') AS samples FROM r GROUP BY 1""")
def source_test(spark, sf_dir):
    """Different listings of each source, and its first three."""
    found = gates.source_report(offers(spark, sf_dir), "source_id", "product_id", ["l_orderkey"])
    return found.select("source_id", "listings", F.concat_ws("|", F.transform("samples", lambda x: x.cast("string"))).alias("samples"))


@query("""SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (1, 3, 5)""")
def active_sources(spark, sf_dir):
    """Sources of a request's list; names that aren't known are ignored."""
    return gates.active_sources(table(spark, sf_dir, "supplier"), "1, 3,5,x,", "s_nationkey").select("s_suppkey", "s_name")


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 AND p_size % 2 = 0 THEN NULL WHEN p_size % 3 = 0 THEN p_type WHEN p_size % 2 = 0 THEN p_name ELSE p_name || chr(10) || p_type END AS details FROM part""")
def details_text(spark, sf_dir):
    """details and recognised text, a line each where there is any."""
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", gates.details_with_ocr(F.when(size % 3 != 0, F.col("p_name")), F.when(size % 2 == 0, " ").otherwise(F.col("p_type"))).alias("details"))


@query(
    """WITH p AS (SELECT p_partkey, p_name || CASE p_partkey % 6 WHEN 0 THEN ' faux leather' WHEN 1 THEN ' leather' WHEN 2 THEN ' pu leather' WHEN 3 THEN ' type c' WHEN 4 THEN ' sit stand' ELSE '' END AS title FROM part) SELECT p_partkey, p_partkey % 6 = 1 OR p_partkey % 6 = 2 AS leather, p_partkey % 6 IN (0, 2) AS vegan, p_partkey % 6 = 3 AS usb, p_partkey % 6 = 4 AS standing FROM p"""
)
def demanded_attributes(spark, sf_dir):
    """Demanded attributes in titles by alias, material and subtype."""
    k = F.col("p_partkey") % 6
    suffix = F.when(k == 0, " faux leather").when(k == 1, " leather").when(k == 2, " pu leather").when(k == 3, " type c").when(k == 4, " sit stand").otherwise("")
    has = lambda a: spec.attribute_present(text.padded(F.concat("p_name", suffix)), F.lit(a), F.array(F.lit(a)))
    return table(spark, sf_dir, "part").select("p_partkey", has("leather").alias("leather"), has("vegan leather").alias("vegan"), has("usb-c").alias("usb"), has("standing").alias("standing"))


# Sources, saved products and telemetry


@query("""WITH s AS (SELECT c_custkey AS k, CAST(c_custkey AS BIGINT) * 10 AS alert FROM customer WHERE c_custkey % 5 = 0), a AS (SELECT o_custkey AS k, o_orderkey AS moment, CASE o_orderkey % 4 WHEN 0 THEN 'save' WHEN 1 THEN 'unsave' ELSE 'alert' END AS action, CASE o_orderkey % 12 WHEN 2 THEN NULL WHEN 3 THEN -5 WHEN 6 THEN 200000000 ELSE o_orderkey END AS alert FROM orders WHERE o_custkey % 7 <> 0),
g AS (SELECT * FROM a WHERE action <> 'alert' OR alert IS NULL OR alert BETWEEN 0 AND 100000000), u AS (SELECT k, max(moment) AS u FROM g WHERE action = 'unsave' GROUP BY 1), n AS (SELECT DISTINCT k FROM (SELECT k FROM s UNION ALL SELECT k FROM g)),
b AS (SELECT n.k, u.u, CASE WHEN u.u IS NULL AND s.k IS NOT NULL THEN -1 ELSE (SELECT min(moment) FROM g WHERE g.k = n.k AND action = 'save' AND moment > coalesce(u.u, -1)) END AS since, CASE WHEN u.u IS NULL THEN s.alert END AS old FROM n LEFT JOIN u USING (k) LEFT JOIN s USING (k)),
l AS (SELECT b.k, first(g.alert ORDER BY g.moment DESC) AS alert, count(*) AS c FROM b JOIN g ON g.k = b.k AND g.action = 'alert' AND g.moment > b.since GROUP BY 1) SELECT b.k AS product_id, CASE WHEN l.c > 0 THEN l.alert ELSE b.old END AS alert FROM b LEFT JOIN l USING (k) WHERE since IS NOT NULL""")
def wishlist_actions(spark, sf_dir):
    """K8: saves, removals and alerts in their order; alerts out of range and unknown products don't count."""
    c, k = table(spark, sf_dir, "customer"), F.col("o_orderkey")
    saved = c.where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("product_id"), (F.col("c_custkey") * 10).cast("long").alias("alert"))
    action = F.when(k % 4 == 0, "save").when(k % 4 == 1, "unsave").otherwise("alert")
    alert = F.when(k % 12 == 2, None).when(k % 12 == 3, -5).when(k % 12 == 6, 200_000_000).otherwise(k).cast("long")
    actions = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("product_id"), k.alias("at"), action.alias("action"), alert.alias("alert"))
    return rel.wishlist(saved, actions, c.where("c_custkey % 7 != 0").select(F.col("c_custkey").alias("product_id")))


@query("""SELECT user_id, max(epoch_us(ts)) AS at, CASE WHEN arg_max(event_type, (ts, event_id)) = 'error' THEN substring(repeat(arg_max(props, (ts, event_id)), 90), 1, 500) END AS last_error FROM events GROUP BY 1""")
def source_status(spark, sf_dir):
    """K5: time of each source's newest attempt, and its error in at most 500 characters."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.col("event_type") != "error").alias("ok"), F.repeat("props", F.lit(90)).alias("error"))
    return rel.source_status(e, "user_id", "ts", "event_id").select("user_id", F.unix_micros(F.col("last_fetched_at").cast("timestamp")).alias("at"), "last_error")


SOURCE_SQL = "(SELECT s_suppkey AS id, CASE s_nationkey % 5 WHEN 0 THEN 'shopify' WHEN 1 THEN 'woocommerce' WHEN 2 THEN 'generic-html' WHEN 3 THEN 'rss' ELSE NULL END AS type, CASE WHEN s_suppkey % 9 = 0 THEN ' ' ELSE s_name END AS label, s_acctbal > 0 AS enabled FROM supplier)"


def sources_of(spark, sf_dir):
    n = F.col("s_nationkey") % 5
    kind = F.when(n == 0, "shopify").when(n == 1, "woocommerce").when(n == 2, "generic-html").when(n == 3, "rss")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), kind.alias("type"), F.when(F.col("s_suppkey") % 9 == 0, " ").otherwise(F.col("s_name")).alias("label"), (F.col("s_acctbal") > 0).alias("enabled"))


@query(f"SELECT id, type FROM {SOURCE_SQL} WHERE NOT (id % 2 = 0 AND coalesce(type IN ('shopify', 'woocommerce', 'generic-html'), false))")
def source_removal(spark, sf_dir):
    """Removals take only sources of three types."""
    s = sources_of(spark, sf_dir)
    return rel.removed(s, s.where("id % 2 = 0"), "id").select("id", "type")


@query(f"SELECT id, type, label, row_number() OVER (ORDER BY type, label) AS place FROM {SOURCE_SQL} WHERE enabled AND trim(label) <> '' AND type IS NOT NULL")
def source_registry(spark, sf_dir):
    """Enabled sources with a valid row, in the order of type and label."""
    ordered = rel.registry(sources_of(spark, sf_dir)).select("id", "type", "label")
    # the place is a key's: labels are numbered inside a type, after the types before it
    sizes = ordered.groupBy("type").agg(F.count("*").alias("n"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.type") < F.col("a.type"), "left").groupBy("a.type").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("type").orderBy("label"))
    return ordered.withColumn("r", place).join(F.broadcast(before), "type").select("id", "type", "label", (F.col("before") + F.col("r")).cast("long").alias("place"))


@query(
    """WITH t AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM t) SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY r DESC) AS place, event_type <> 'error' AS ok FROM r WHERE r <= 14"""
)
def health_dots(spark, sf_dir):
    """The last fourteen of each source's attempts among the newest thousand, the oldest first."""
    e = table(spark, sf_dir, "events").withColumn("ok", F.col("event_type") != "error")
    return rel.health_dots(e, "user_id", "ts", "event_id")


@query("""WITH m AS (SELECT max(ts) AS now FROM events) SELECT event_id, user_id FROM events, m WHERE epoch(date_trunc('second', ts)) >= epoch(date_trunc('second', now)) - 86400 ORDER BY ts DESC, event_id LIMIT 80""")
def recent_listings(spark, sf_dir):
    """The newest eighty rows of the last day."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    dated = e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now"))))
    return rel.recent(dated, F.col("now"), 86_400, "ts", "event_id", 80).select("event_id", "user_id")


@query(
    """SELECT l_partkey AS product_id, CASE l_returnflag WHEN 'A' THEN 'EUR' WHEN 'N' THEN 'USD' ELSE 'GBP' END AS currency, min(CAST(floor(l_extendedprice / l_quantity * 100 + 0.5) AS BIGINT)) AS low, max(CAST(floor(l_extendedprice / l_quantity * 100 + 0.5) AS BIGINT)) AS high FROM lineitem WHERE CAST(floor(l_extendedprice / l_quantity * 100 + 0.5) AS BIGINT) > 0 GROUP BY ALL"""
)
def price_ranges(spark, sf_dir):
    """A10: price range of each product in each currency."""
    flag = F.col("l_returnflag")
    rows = offers(spark, sf_dir).withColumn("currency", F.when(flag == "A", "EUR").when(flag == "N", "USD").otherwise("GBP"))
    return rel.price_ranges(rows, "product_id")


@query("""WITH l AS (SELECT user_id AS listing_id, user_id % 300 AS product_id, CAST(floor(min(value)) AS BIGINT) AS price_minor, max(ts) AS seen FROM events GROUP BY 1), t AS (SELECT product_id FROM l GROUP BY 1 ORDER BY max(seen) DESC, product_id LIMIT 200),
h AS (SELECT user_id AS listing_id, CAST(floor(value) AS BIGINT) AS price, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, floor(value) DESC) AS r FROM events), p AS (SELECT listing_id, array_to_string(list(price ORDER BY r), ',') AS prices FROM h WHERE r <= 30 GROUP BY 1)
SELECT product_id, array_to_string(list(listing_id || ':' || price_minor || ':' || prices ORDER BY price_minor, listing_id), ';') AS offers FROM l JOIN t USING (product_id) JOIN p USING (listing_id) GROUP BY 1""")
def nested_products(spark, sf_dir):
    """The 200 products seen last with their offers by price and the last thirty prices of each."""
    e, whole = table(spark, sf_dir, "events"), F.floor("value").cast("long")
    listings = e.groupBy(F.col("user_id").alias("listing_id")).agg(F.floor(F.min("value")).cast("long").alias("price_minor"), F.max("ts").alias("seen")).withColumn("product_id", F.col("listing_id") % 300)
    products = listings.groupBy("product_id").agg(F.max("seen").alias("seen"))
    found = rel.nested_products(products, listings.select("listing_id", "product_id", "price_minor"), e.select(F.col("user_id").alias("listing_id"), F.col("ts").alias("at"), whole.alias("price")))
    one = lambda o: F.concat_ws(":", o["listing_id"].cast("string"), o["price_minor"].cast("string"), F.concat_ws(",", F.transform(o["prices"], lambda p: p.cast("string"))))
    return found.select("product_id", F.concat_ws(";", F.transform("offers", one)).alias("offers"))


@query(f"""WITH o AS (SELECT product_id, source_id, min(price_minor) AS price, max(l_shipdate) AS moment FROM {OFFERS_SQL} GROUP BY ALL), p AS (SELECT product_id, max(moment) AS seen FROM o GROUP BY 1), n AS (SELECT product_id, seen FROM p JOIN part ON p_partkey = product_id ORDER BY seen DESC, product_id LIMIT 30),
c AS (SELECT product_id, seen, count(*) AS sources, list(source_id ORDER BY price, source_id)[1:5] AS stores FROM o JOIN n USING (product_id) JOIN part ON p_partkey = product_id WHERE contains(p_name, 'widget') OR contains(p_name, 'bolt') GROUP BY ALL HAVING count(*) >= 2) SELECT product_id, sources, array_to_string(stores, '|') AS stores FROM c ORDER BY seen DESC, product_id LIMIT 8""")
def compared_offers(spark, sf_dir):
    """Of the thirty newest products those with a word of the query and two sources, eight at most, with five stores."""
    rows = offers(spark, sf_dir)
    named = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("title"))
    products = rows.groupBy("product_id").agg(F.max("l_shipdate").alias("seen")).join(named, "product_id")
    listings = rows.select("product_id", F.col("source_id").alias("source"), F.lit("").alias("title"), "price_minor")
    found = rel.compared(products, listings, text.lit_array(("widget", "bolts")))
    return found.select("product_id", "sources", F.concat_ws("|", F.transform("stores", lambda s: s.cast("string"))).alias("stores"))


@query(
    """WITH r AS (SELECT DISTINCT event_id AS run FROM events WHERE event_type = 'view') SELECT e.event_id, r.run AS run_id, length(substring(repeat(e.props, 2000), 1, 20000)) AS kept FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type IN ('click', 'purchase')) e LEFT JOIN r ON r.run = e.k"""
)
def feedback_rows(spark, sf_dir):
    """K6, K7: feedback of accepted kinds with its run, if there is such a run, and JSON cut at 20,000 characters."""
    e = table(spark, sf_dir, "events")
    feedback = e.where(F.col("event_type").isin("click", "purchase")).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("run_id"), F.length(rel.bounded_json(F.repeat("props", F.lit(2000)))).cast("long").alias("kept"))
    return rel.known_run(feedback, e.where("event_type = 'view'").select(F.col("event_id").alias("run_id")), "run_id")


@query(
    """SELECT p_partkey AS query_id, 'product' AS kind, 'chair' AS product_type, p_partkey % 2 = 0 AS has_brand, 1 AS must_count, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS exclusion_count, CASE WHEN p_partkey % 5 = 0 THEN 'used' ELSE 'any' END AS condition, true AS has_max_price, 0.95 AS confidence FROM part"""
)
def safe_specs(spark, sf_dir):
    """what parsed queries leave in telemetry: kinds, flags and counts."""
    k = F.col("p_partkey")
    q = F.concat_ws(" ", F.when(k % 5 == 0, "used"), F.when(k % 2 == 0, "sony"), F.lit("leather chair"), F.when(k % 3 == 0, "not mesh"), F.concat(F.lit("under $"), (F.col("p_size") + 1).cast("string")))
    found = rel.safe_spec(spec.parse_queries(table(spark, sf_dir, "part").select(k.alias("query_id"), q.alias("query"))))
    return found.select("query_id", "kind", "product_type", "has_brand", "must_count", "exclusion_count", "condition", "has_max_price", "confidence")


# Roles, a case for each rule of the decision list: query, title, details, price, role, eligible, confidence

ROLE_CASES = (
    ("boots under $100", "Hiking boots", "", 0, "irrelevant", False, 1.0),
    ("boots over $100", "Hiking boots", "", 5000, "irrelevant", False, 1.0),
    ("boots under $100", "Hiking boots", "", 15000, "irrelevant", False, 1.0),
    ("office chair not mesh", "Mesh office chair", "", 20000, "irrelevant", False, 1.0),
    ("leather boots", "Faux leather boots", "", 5000, "irrelevant", False, 0.98),
    ("brand new laptop", "Used Dell laptop", "", 30000, "irrelevant", False, 1.0),
    ("used laptop", "Dell laptop", "", 30000, "irrelevant", False, 0.98),
    ("controller for ps5", "Wireless controller for Xbox Series X", "", 5900, "irrelevant", False, 0.98),
    ("controller for ps5", "Wireless controller", "", 5900, "irrelevant", False, 0.95),
    ("zorbing sphere", "Big zorbing sphere", "", 5000, "exact", True, 0.75),
    ("zorbing sphere", "Cube", "", 5000, "irrelevant", False, 0.65),
    ("ps5 console", "Racing game (PS5)", "", 5000, "complement", False, 0.97),
    ("ps5 console", "PS5 travel bag", "", 5000, "complement", False, 0.96),
    ("monitor", "Monitor arm clamp", "", 5000, "complement", False, 0.98),
    ("headphones", "Cotton shirt", "", 5000, "irrelevant", False, 0.95),
    ("lamp", "Glowing thing", "", 5000, "irrelevant", False, 0.7),
    ("sony wh-1000xm5 headphones", "WH-1000XM5 over-ear headphones", "", 30000, "exact", True, 0.98),
    ("nike running shoes", "Adidas running shoes", "", 9000, "substitute", False, 0.96),
    ("boots", "Walking shoes", "", 9000, "substitute", True, 0.88),
    ("airpods pro", "Silicone case for AirPods Pro", "", 1900, "complement", False, 0.98),
    ("lamp", "Warm glow", "floor lamp with a dimmer", 5000, "exact", True, 0.98),
    ("ps5 console", "Sony PlayStation 5 Console Disc Edition", "", 49900, "exact", True, 0.98),
)
ROLE_SQL = ", ".join(f"({i}, '{role}', {str(ok).lower()}, {sure})" for i, (*_, role, ok, sure) in enumerate(ROLE_CASES))


@query(f"WITH c(k, role, eligible, confidence) AS (VALUES {ROLE_SQL}) SELECT p_partkey, role, eligible, CAST(confidence AS DOUBLE) AS confidence FROM part JOIN c ON p_partkey % {len(ROLE_CASES)} = k")
def role_rules(spark, sf_dir):
    """The decision of each rule, over titles that end with every part's name."""
    cases = F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in zip(("query", "title", "details", "price_minor"), case))) for case in ROLE_CASES))
    case = F.element_at(cases, (F.col("p_partkey") % len(ROLE_CASES) + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", case.alias("c")).select(
        "p_partkey",
        "c.query",
        F.concat_ws(" ", "c.title", "p_name").alias("title"),
        "c.details",
        F.col("c.price_minor").cast("long").alias("price_minor"),
    )
    return spec.classified(spec.parse_queries(rows)).select("p_partkey", "role", "eligible", "confidence")
