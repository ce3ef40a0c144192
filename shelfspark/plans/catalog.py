"""Registered queries of the library, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import lexicon as lx, scoring, text
from ..operators import bundles, entity, evaluation, gates, posting_index, ranking, relational as rel, retrieval, vector_index
from ..tables import OFFERS_SQL, minor, offers, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its oracle if SQL can express it."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def norm_sql(x: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower({x})), '[^a-z0-9]+', ' ', 'g'))"


def spec_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({x}), '[''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"


def tokens_sql(x: str, noise=lx.LEXICAL_NOISE) -> str:
    return f"list_filter(string_split({norm_sql(x)}, ' '), lambda t: length(t) > 1 AND t NOT IN ({quoted(noise)}))"


def cents_sql(x: str) -> str:
    return f"CAST(floor({x} * 100 + 0.5) AS BIGINT)"


# Retrieval


def item_queries(spark: SparkSession, sf_dir: str, place: int = 0) -> DataFrame:
    """The stated query set: every benchmark item whose id is divisible by 100, or leaves another rest."""
    return table(spark, sf_dir, "benchmark").where(F.col("item_id") % 100 == place).select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def bm25_sql(place: int) -> str:
    return f"""
WITH d AS (SELECT doc_id AS id, {tokens_sql('text')} AS tokens, {norm_sql('text')} AS plain FROM documents),
q AS (SELECT item_id AS query_id, {norm_sql('text')} AS phrase, list_distinct({tokens_sql('text')}) AS terms FROM benchmark WHERE item_id % 100 = {place}),
t AS (SELECT query_id, unnest(terms) AS term FROM q),
f AS (SELECT DISTINCT query_id, term, unnest(CASE WHEN term LIKE '%s' THEN [term, term || 's', term[:-2]] ELSE [term, term || 's'] END) AS form FROM t),
s AS (SELECT count(*) AS n, greatest(avg(len(tokens)), 1.0) AS mean FROM d),
e AS (SELECT id, len(tokens) AS length, unnest(tokens) AS form FROM d),
tf AS (SELECT query_id, id, term, count(*) AS tf, any_value(length) AS length FROM e JOIN f USING (form) GROUP BY ALL),
df AS (SELECT query_id, term, count(*) AS df FROM tf GROUP BY ALL),
b AS (
  SELECT query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS base
  FROM tf JOIN df USING (query_id, term), s GROUP BY ALL),
scored AS (SELECT query_id, id, base + CASE WHEN contains(plain, phrase) THEN 0.75 ELSE 0 END AS score FROM b JOIN d USING (id) JOIN q USING (query_id)),
r AS (SELECT query_id, id AS doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM scored)
"""


@query(bm25_sql(0) + "SELECT query_id, doc_id, round(round(score, 6), 4) AS score, rank FROM r WHERE rank <= 10")
def bm25_top(spark, sf_dir):
    """The ten best documents of each query by BM25, from the posting index."""
    index = posting_index.build(table(spark, sf_dir, "documents"))
    found = posting_index.search(index, item_queries(spark, sf_dir))
    return found.select("query_id", F.col("id").alias("doc_id"), F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""
SELECT query_id, doc_id, round(round(score, 6), 4) AS score, rank FROM ({bm25_sql(0)} SELECT * FROM r WHERE rank <= 3) a
UNION ALL SELECT query_id, doc_id, round(round(score, 6), 4), rank FROM ({bm25_sql(1)} SELECT * FROM r WHERE rank <= 3) b
""")
def bm25_two_sets(spark, sf_dir):
    """Two sets of queries answered from one index; the second reads no documents."""
    index = posting_index.build(table(spark, sf_dir, "documents"))
    first, second = (posting_index.search(index, item_queries(spark, sf_dir, place), 3) for place in (0, 1))
    return first.unionByName(second).select("query_id", F.col("id").alias("doc_id"), F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""
WITH q AS (SELECT item_id AS query_id, text AS query FROM benchmark WHERE item_id % 100 = 0),
x AS (
  SELECT query_id, doc_id, {norm_sql('query')} AS qn, {norm_sql('text')} AS tn, list_distinct({tokens_sql('query')}) AS qt, list_distinct({tokens_sql('text')}) AS tt
  FROM documents, q),
m AS (SELECT *, list_filter(qt, lambda t: list_contains(tt, t) OR (t LIKE '%s' AND list_contains(tt, t[:-2])) OR list_contains(tt, t || 's')) AS met FROM x)
SELECT query_id, doc_id, round(CASE WHEN coalesce(qn, '') = '' OR coalesce(tn, '') = '' OR len(qt) = 0 THEN 0 ELSE least(1.0, 0.65 * len(met) / len(qt) + CASE WHEN contains(tn, qn) THEN 0.2 ELSE 0 END
  + CASE WHEN length(replace(qn, ' ', '')) >= 4 AND contains(replace(tn, ' ', ''), replace(qn, ' ', '')) THEN 0.15 ELSE 0 END) END, 6) AS score
FROM m
""")
def lexical_score(spark, sf_dir):
    """Lexical evidence of every document for each query; a document's words are looked up once for all queries."""
    return retrieval.lexical_evidence(table(spark, sf_dir, "documents"), item_queries(spark, sf_dir)).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH t AS (SELECT unnest({tokens_sql('text')}) AS term, doc_id FROM documents)
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM t GROUP BY term HAVING count(DISTINCT doc_id) > 1""")
def corpus_stats(spark, sf_dir):
    """Document and collection frequency of every token in more than one document."""
    return retrieval.corpus_statistics(table(spark, sf_dir, "documents"), "text").where("df > 1")


# Text functions over titles that the tables give

TITLE_SQL = """(SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice, CASE p_partkey % 6
 WHEN 0 THEN '[Deal] ' || p_name || ' ' || p_brand || ' - $' || CAST(p_size AS VARCHAR) || ' (Starts at 7PM) + Free Shipping w/ Prime'
 WHEN 1 THEN 'HOT: ' || p_name || ' ' || p_type || ' 25% off at Walmart.com'
 WHEN 2 THEN p_name || ' (Refurbished) after coupon | from Best Buy'
 WHEN 3 THEN '[Amazon] [tools] ' || p_name || '  size ' || CAST(p_size AS VARCHAR) || ' -- clearance *'
 WHEN 4 THEN 'sale'
 ELSE p_name || ' model WH-' || CAST(1000 + p_size AS VARCHAR) || 'XM' || CAST(p_size % 9 AS VARCHAR) || ' 64gb new' END AS title FROM part)"""


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with a noisy title made of their own columns."""
    n, size, kind = F.col("p_name"), F.col("p_size").cast("string"), F.col("p_partkey") % 6
    c = F.concat
    return table(spark, sf_dir, "part").withColumn(
        "title",
        F.when(kind == 0, c(F.lit("[Deal] "), n, F.lit(" "), "p_brand", F.lit(" - $"), size, F.lit(" (Starts at 7PM) + Free Shipping w/ Prime"))).when(kind == 1, c(F.lit("HOT: "), n, F.lit(" "), "p_type", F.lit(" 25% off at Walmart.com"))).when(kind == 2, c(n, F.lit(" (Refurbished) after coupon | from Best Buy"))).when(kind == 3, c(F.lit("[Amazon] [tools] "), n, F.lit("  size "), size, F.lit(" -- clearance *"))).when(kind == 4, "sale").otherwise(
            c(n, F.lit(" model WH-"), (F.col("p_size") + 1000).cast("string"), F.lit("XM"), (F.col("p_size") % 9).cast("string"), F.lit(" 64gb new"))
        ),
    )


@query(rf"""WITH t AS (SELECT p_partkey, title, p_partkey % 6 AS k, trim(regexp_replace(regexp_replace(p_name, '\b(?:{'|'.join(lx.URGENCY)})\b', ' ', 'g'), '\s+', ' ', 'g')) AS p_name, p_type, p_brand, CAST(p_size AS VARCHAR) AS s, CAST(1000 + p_size AS VARCHAR) AS m, CAST(p_size % 9 AS VARCHAR) AS x FROM {TITLE_SQL})
SELECT p_partkey, CASE WHEN length(clean) < 4 THEN trim(title) ELSE clean END AS clean FROM (SELECT p_partkey, title, CASE k WHEN 0 THEN p_name || ' ' || p_brand WHEN 1 THEN p_name || ' ' || p_type WHEN 2 THEN p_name WHEN 3 THEN '[tools] ' || p_name || ' size ' || s WHEN 4 THEN 'sale' ELSE p_name || ' model WH-' || m || 'XM' || x || ' 64gb' END AS clean FROM t)""")
def normalize_title(spark, sf_dir):
    """titles without deal copy (the oracle states the expected title of each pattern)."""
    return titled(spark, sf_dir).select("p_partkey", text.normalize_title(F.col("title")).alias("clean"))


@query(f"""SELECT p_partkey, substring(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), 1, 80) AS title_key,
 coalesce(nullif(array_to_string(list_filter({tokens_sql('title', lx.TITLE_NOISE)}, lambda t: t NOT IN ({quoted(lx.FINGERPRINT_NOISE)}))[1:12], '-'), ''), {norm_sql('title')}) AS fingerprint,
 array_to_string({tokens_sql('title', lx.TITLE_NOISE)}, ' ') AS tokens FROM {TITLE_SQL}""")
def title_keys(spark, sf_dir):
    """Title key, fingerprint and tokens."""
    t = F.col("title")
    return titled(spark, sf_dir).select("p_partkey", text.title_key(t).alias("title_key"), text.title_fingerprint(t).alias("fingerprint"), F.concat_ws(" ", text.title_tokens(t)).alias("tokens"))


@query(f"""SELECT doc_id, {norm_sql('text')} AS plain, {spec_sql('text')} AS strict, len({tokens_sql('text')}) AS tokens FROM documents""")
def normalized_text(spark, sf_dir):
    """both normal forms of every document."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_search(t).alias("plain"), text.normalize_spec(t).alias("strict"), F.size(text.lexical_tokens(t)).cast("long").alias("tokens"))


OVERLAP_SQL = """WITH q AS (SELECT p_partkey, lower(p_name || ' ' || p_type) AS title, list_distinct(list_filter(regexp_extract_all(lower(split_part(p_name, ' ', 1) || 's and ' || p_brand || ' ' || split_part(p_name, ' ', 2)), '[\\p{L}\\p{N}]+'), lambda t: length(t) >= 3 AND t NOT IN ('and','for','from','into','the','that','this','with'))) AS toks FROM part),
m AS (SELECT p_partkey, len(toks) AS n, len(list_filter(toks, lambda t: contains(title, t) OR (t LIKE '%s' AND length(t) > 3 AND contains(title, t[:-2])))) AS hit FROM q)"""


def overlap_rows(spark, sf_dir):
    word = F.split("p_name", " ")
    q = F.concat(word[0], F.lit("s and "), "p_brand", F.lit(" "), word[1], F.lit(" under $"), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", q.alias("q"), F.concat_ws(" ", "p_name", "p_type").alias("title"))


@query(OVERLAP_SQL + " SELECT p_partkey, n = hit AS overlap, round(hit / n, 6) AS coverage, hit >= ceil(n * 0.5) AS half FROM m")
def token_coverage(spark, sf_dir):
    """Meaningful query tokens found in titles, price phrases left out."""
    r, q, t = overlap_rows(spark, sf_dir), F.col("q"), F.col("title")
    return r.select("p_partkey", text.has_token_overlap(q, t).alias("overlap"), F.round(text.token_coverage(q, t), 6).alias("coverage"), text.has_token_coverage(q, [t], 0.5).alias("half"))


@query(f"""WITH p AS (SELECT item_id, array_to_string(string_split({spec_sql('text')}, ' ')[1:2], ' ') AS phrase FROM benchmark)
SELECT item_id, doc_id FROM documents, p WHERE contains(' ' || {spec_sql('text')} || ' ', ' ' || phrase || ' ') OR (phrase LIKE '%s' AND contains(' ' || {spec_sql('text')} || ' ', ' ' || phrase[:-2] || ' '))""")
def phrase_gate(spark, sf_dir):
    """Documents that hold the first two words of a benchmark item, met by the first word's token."""
    bench = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat_ws(" ", F.slice(F.split(text.normalize_spec(F.col("text")), " "), 1, 2)).alias("phrase"))
    docs = table(spark, sf_dir, "documents").select("doc_id", text.normalize_spec(F.col("text")).alias("plain"))
    grams = docs.select("doc_id", F.split("plain", " ").alias("w")).select(
        "doc_id",
        F.explode(F.array_distinct(F.concat("w", F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))))).alias("gram"),
    )
    forms = bench.select("query_id", F.explode(F.array_distinct(F.array_compact(F.array("phrase", F.when(F.col("phrase").endswith("s"), F.expr("substring(phrase, 1, length(phrase) - 1)")))))).alias("gram"))
    found = retrieval.in_blocks(forms, lambda part: grams.join(F.broadcast(part), "gram"))
    return found.select(F.col("query_id").alias("item_id"), "doc_id").distinct()


MATERIAL_SQL = """(SELECT p_partkey, p_name || CASE p_partkey % 7 WHEN 0 THEN ' leather' WHEN 1 THEN ' faux leather' WHEN 2 THEN ' leather-free' WHEN 3 THEN ' non leather' WHEN 4 THEN ' alternative to leather' WHEN 5 THEN ' wool leather' ELSE '' END AS title FROM part)"""


@query(f"""SELECT p_partkey, title, p_partkey % 7 IN (0, 5) AS leather FROM {MATERIAL_SQL}""")
def material_gate(spark, sf_dir):
    """Real leather after imitations and negations are blanked (the oracle knows which suffix is real)."""
    k = F.col("p_partkey") % 7
    suffix = F.when(k == 0, " leather").when(k == 1, " faux leather").when(k == 2, " leather-free").when(k == 3, " non leather").when(k == 4, " alternative to leather").when(k == 5, " wool leather").otherwise("")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", suffix).alias("title"))
    return rows.select("p_partkey", "title", gates.has_materials(F.col("title"), ["leather"]).alias("leather"))


@query(f"""SELECT p_partkey, p <= 0 OR ((lo IS NULL OR p >= lo) AND (hi IS NULL OR p <= hi)) AS in_window, (lo IS NULL AND hi IS NULL) OR (p > 0 AND (lo IS NULL OR p >= lo) AND (hi IS NULL OR p <= hi)) AS passes
FROM (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 0 ELSE {cents_sql('p_retailprice')} END AS p, CASE WHEN p_size % 2 = 0 THEN 91000 END AS lo, CASE WHEN p_size % 3 = 0 THEN 100000 END AS hi FROM part)""")
def price_gates(spark, sf_dir):
    """The window that passes unknown prices and the gate that rejects them."""
    price = F.when(F.col("p_partkey") % 9 == 0, 0).otherwise(minor("p_retailprice"))
    low, high = F.when(F.col("p_size") % 2 == 0, 91000), F.when(F.col("p_size") % 3 == 0, 100000)
    return table(spark, sf_dir, "part").select("p_partkey", scoring.price_window(price, low, high).alias("in_window"), scoring.spec_price_gate(price, low, high).alias("passes"))


@query("""SELECT p_partkey, CASE k WHEN 0 THEN least(a, b) WHEN 2 THEN a WHEN 5 THEN 120000 END AS min_price, CASE k WHEN 0 THEN greatest(a, b) WHEN 1 THEN a WHEN 3 THEN a END AS max_price
FROM (SELECT p_partkey, p_partkey % 6 AS k, CAST(p_size AS BIGINT) * 100 AS a, CAST(p_size * 7 % 50 + 1 AS BIGINT) * 100 AS b FROM part)""")
def price_bounds(spark, sf_dir):
    """Bounds of queries written from part sizes; a model name with max is no bound, and commas are thousands."""
    a, b, k = F.col("p_size").cast("string"), (F.col("p_size") * 7 % 50 + 1).cast("string"), F.col("p_partkey") % 6
    q = F.when(
        k == 0,
        F.concat(F.col("p_name"), F.lit(" between $"), a, F.lit(" and "), b, F.lit(" dollars")),
    ).when(k == 1, F.concat(F.col("p_name"), F.lit(" under $"), a)).when(k == 2, F.concat(F.col("p_name"), F.lit(" at least "), a, F.lit(" bucks"))).when(k == 3, F.concat(F.col("p_name"), F.lit(" max $"), a)).when(k == 4, F.concat(F.col("p_name"), F.lit(" pro max 256gb"))).otherwise(F.concat(F.col("p_name"), F.lit(" over $1,200")))
    return table(spark, sf_dir, "part").select("p_partkey", text.price_bound(q, "min").alias("min_price"), text.price_bound(q, "max").alias("max_price"))


@query(f"""SELECT p_partkey, {cents_sql('p_retailprice')} AS us, {cents_sql('p_retailprice')} AS eu, CAST(p_size AS BIGINT) * 100 AS whole, {cents_sql('p_retailprice')} AS dollars FROM part""")
def price_texts(spark, sf_dir):
    """prices printed in US and European notation and read back."""
    p = F.col("p_retailprice")
    us = F.format_number(p, 2)
    eu = F.translate(us, ",.", ".,")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        text.storefront_price(F.concat(F.lit("USD "), us)).alias("us"),
        text.storefront_price(F.concat(eu, F.lit(" €"))).alias("eu"),
        text.storefront_price(F.concat(F.lit("€"), F.col("p_size").cast("string"))).alias("whole"),
        text.dollar_price(F.concat(F.lit("now "), text.format_price(minor(p)), F.lit(" only"))).alias("dollars"),
    )


HOST_SQL = "regexp_replace(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '^www\\.', '')"


@query(f"""SELECT page_id, {HOST_SQL} AS host, url LIKE 'http%' AND contains({HOST_SQL}, '.') AS safe, {HOST_SQL} LIKE '%example.net' AS same FROM pages""")
def page_hosts(spark, sf_dir):
    """Host, safety and site of every page's URL."""
    h = text.host(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", h.alias("host"), text.safe_url(F.col("url")).alias("safe"), text.same_site(h, F.lit("example.net")).alias("same"))


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '\s+', ' ', 'g')) AS plain,
 regexp_matches(lower(html), 'captcha|access denied|are you a human|unusual traffic|verify you are human|robot check') AS blocked FROM pages""")
def page_text(spark, sf_dir):
    """Text of every page without tags, and whether it is a bot challenge."""
    return table(spark, sf_dir, "pages").select("page_id", text.strip_tags(F.col("html")).alias("plain"), text.blocked_page(F.col("html")).alias("blocked"))


@query(
    r"""SELECT page_id, substring(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<svg.*?</svg>', '', 'g'), '(?i)\s(?:style|srcset|sizes|on\w+|data-[\w-]+)=(?:"[^"]*"|''[^'']*'')', '', 'g'), '\s+', ' ', 'g')), 1, 20000) AS slim FROM pages"""
)
def slim_pages(spark, sf_dir):
    """markup without bulk."""
    return table(spark, sf_dir, "pages").select("page_id", text.slim_markup(F.col("html")).alias("slim"))


@query(
    r"""SELECT item_id, sha256(trim(regexp_replace(lower(trim(text)), '\s+', ' ', 'g'))) AS query_hash, 's' || CAST(item_id % 3 AS VARCHAR) || '|' || trim(regexp_replace(lower(trim(text)), '\s+', ' ', 'g')) AS search_key FROM benchmark"""
)
def query_keys(spark, sf_dir):
    """hash and source-scoped key of queries."""
    t = F.col("text")
    key = F.replace(text.search_key(F.concat(F.lit("s"), (F.col("item_id") % 3).cast("string")), t), F.lit("\u0000"), F.lit("|"))
    return table(spark, sf_dir, "benchmark").select("item_id", text.query_hash(t).alias("query_hash"), key.alias("search_key"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 6 = 5 THEN array_to_string(list_distinct_sorted, ' ') WHEN p_partkey % 6 = 0 THEN regexp_extract(p_brand, '[0-9]{2,6}') WHEN p_partkey % 6 = 3 AND p_size > 9 THEN CAST(p_size AS VARCHAR) ELSE '' END AS ids FROM (SELECT p_partkey, p_brand, p_size,  list_sort(list_distinct(['wh' || CAST(1000 + p_size AS VARCHAR) || 'xm' || CAST(p_size % 9 AS VARCHAR), CAST(1000 + p_size AS VARCHAR) || 'xm' || CAST(p_size % 9 AS VARCHAR)])) AS list_distinct_sorted FROM part)"""
)
def identity_tokens(spark, sf_dir):
    """model-like tokens of titles; measures such as 64gb are none."""
    return titled(spark, sf_dir).select("p_partkey", F.concat_ws(" ", F.array_sort(text.identity_tokens(F.col("title")))).alias("ids"))


@query("""SELECT p_partkey, round(least(1, greatest(0, 0.55 + CASE WHEN c > 0 THEN 0.12 ELSE 0 END + CASE WHEN p_size % 2 = 0 THEN 0.08 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 0.1 WHEN p_size % 3 = 1 THEN -0.35 ELSE 0 END + CASE WHEN p_size >= 10 THEN 0.05 ELSE 0 END + CASE WHEN p_size % 5 >= 4 THEN 0.05 ELSE 0 END)), 6) AS quality,
 CASE WHEN c < 2500 THEN 'price:entry' WHEN c < 10000 THEN 'price:value' WHEN c < 30000 THEN 'price:mid' WHEN c < 75000 THEN 'price:premium' ELSE 'price:luxury' END AS band FROM (SELECT p_partkey, p_size, CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) AS c FROM part)""")
def listing_quality(spark, sf_dir):
    """Quality score and price band."""
    price, size = minor("p_retailprice"), F.col("p_size")
    availability = F.when(size % 3 == 0, "in_stock").when(size % 3 == 1, "out").otherwise("unknown")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(scoring.listing_quality(price, size % 2 == 0, availability, size, size % 5, F.lit(False)), 6).alias("quality"), scoring.price_band(price).alias("band"))


@query(f"""WITH t AS (SELECT p_partkey, p_name AS q, list_filter(string_split({norm_sql('p_name')}, ' '), lambda t: t <> '') AS k FROM part),
s AS (SELECT p_partkey, least(1, greatest(0, 0.15 + CASE WHEN len(k) >= 2 THEN 0.1 ELSE 0 END + CASE WHEN len(k) >= 4 THEN 0.15 ELSE 0 END)) AS s FROM t)
SELECT p_partkey, round(s, 6) AS specificity, round(0.64 + 0.3 * s, 6) AS lam, round(0.55 + 0.3 * s, 6) AS gate FROM s""")
def query_specificity(spark, sf_dir):
    """M8, M9: how exact a query is, and the weights that follow."""
    s = scoring.query_specificity(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(s, 6).alias("specificity"), F.round(scoring.dynamic_lambda(s), 6).alias("lam"), F.round(scoring.relative_gate(s), 6).alias("gate"))


# Latest state, change data, deduplication


@query("""WITH x AS (SELECT doc_id, text, 8 * CAST(doc_id % 3 > 0 AS INT) + 4 * CAST(doc_id % 5 > 0 AS INT) + 2 * CAST(lang = 'en' AS INT) + CAST(n_chars > 500 AS INT) AS q FROM documents),
r AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_position, row_number() OVER (PARTITION BY text ORDER BY q DESC, doc_id) AS r FROM x) SELECT doc_id, first_position FROM r WHERE r = 1""")
def dedupe_keep_best(spark, sf_dir):
    """The best copy of equal texts at the first one's place."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", F.sha2("text", 256).alias("key"))
    q = rel.listing_dedupe_quality(F.col("doc_id") % 3, F.col("doc_id") % 5 == 0, F.col("lang") == "en", F.col("n_chars") > 500)
    return rel.dedupe_keep_best(docs, ["key"], q, "doc_id").select("doc_id", "first_position")


@query("""SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, min(ts) AS captured_at, max(ts) AS last_seen_at FROM events GROUP BY user_id""")
def upsert_latest(spark, sf_dir):
    """K1, K5: last version of each key with the times of its first and last."""
    return rel.upsert_latest(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type", "captured_at", "last_seen_at")


EVENT_PRICE_SQL = "(SELECT *, CASE WHEN event_type = 'error' THEN 0 ELSE CAST(floor(value) AS BIGINT) END AS price FROM events)"


def event_prices(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("price", F.when(F.col("event_type") == "error", 0).otherwise(F.floor("value")).cast("long"))


@query(f"""SELECT event_id, user_id, price FROM (SELECT *, lag(price) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM {EVENT_PRICE_SQL}) WHERE (b IS NULL OR b <> price) AND price > 0""")
def price_change_cdc(spark, sf_dir):
    """Observations that change the price."""
    return rel.price_changes(event_prices(spark, sf_dir), "user_id", "price", "ts", "event_id").select("event_id", "user_id", "price")


@query(f"""SELECT date_trunc('hour', ts) AS hour, min(price) AS low FROM {EVENT_PRICE_SQL} WHERE price > 0 GROUP BY 1""")
def hourly_min_trend(spark, sf_dir):
    """A4: smallest price of each hour."""
    return rel.hourly_min(event_prices(spark, sf_dir), "ts", "price").select(F.col("hour").cast("timestamp_ntz").alias("hour"), "low")


@query(
    f"""SELECT user_id, min(price) AS low, max(price) AS high, CASE WHEN count(*) < 2 THEN 'flat' WHEN arg_max(price, (ts, event_id)) > arg_min(price, (ts, event_id)) THEN 'up' WHEN arg_max(price, (ts, event_id)) < arg_min(price, (ts, event_id)) THEN 'down' ELSE 'flat' END AS direction FROM {EVENT_PRICE_SQL} WHERE price > 0 GROUP BY user_id"""
)
def price_trend(spark, sf_dir):
    """Direction and range of each listing's prices."""
    at = F.struct("ts", "event_id")
    last, first = F.max_by("price", at), F.min_by("price", at)
    direction = F.when(F.count("*") < 2, "flat").when(last > first, "up").when(last < first, "down").otherwise("flat")
    return event_prices(spark, sf_dir).where("price > 0").groupBy("user_id").agg(F.min("price").alias("low"), F.max("price").alias("high"), direction.alias("direction"))


@query("""SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 30""")
def latest_n_history(spark, sf_dir):
    """The newest thirty entries of each source."""
    return rel.latest_n(table(spark, sf_dir, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 30).select("user_id", "event_id", F.col("rank").cast("long").alias("rank"))


@query("""WITH m AS (SELECT *, event_type <> 'error' AS ok, sum(CAST(event_type <> 'error' AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events),
r AS (SELECT *, CAST(sum(CAST(NOT ok AS INT)) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS BIGINT) AS run FROM m)
SELECT event_id, user_id, run, CASE WHEN run >= 3 THEN ts + INTERVAL 5 MINUTE END AS open_until FROM r""")
def failure_streaks(spark, sf_dir):
    """Consecutive failures and when the circuit breaker closes."""
    return rel.failure_streaks(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", F.col("event_type") != "error").select("event_id", "user_id", "run", "open_until")


@query("""WITH s AS (SELECT user_id, list(value ORDER BY ts, event_id, value) FILTER (WHERE isfinite(value)) AS v, count(*) AS attempts FROM events GROUP BY user_id)
SELECT user_id, CAST(list_reduce(list_prepend(floor(v[1] + 0.5), v[2:]), lambda a, x: floor(0.8 * a + 0.2 * x + 0.5)) AS BIGINT) AS ewma, attempts FROM s""")
def ewma_latency(spark, sf_dir):
    """Exponentially weighted mean rounded at each step."""
    return rel.ewma(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value").select("user_id", "ewma", F.col("attempts").cast("long").alias("attempts"))


# Offers, products and sources


@query(
    f"""SELECT product_id, source_id, price_minor FROM (SELECT product_id, source_id, price_minor, row_number() OVER (PARTITION BY product_id, source_id ORDER BY CASE WHEN price_minor > 0 THEN price_minor ELSE 9223372036854775807 END, external_id) AS r FROM {OFFERS_SQL}) WHERE r = 1"""
)
def cheapest_per_source(spark, sf_dir):
    """The cheapest offer of each source of a product."""
    return rel.cheapest_per_source(offers(spark, sf_dir).select("product_id", "source_id", "price_minor", "external_id"), ["product_id", "source_id"], "price_minor", "external_id").select("product_id", "source_id", "price_minor")


@query(
    f"""SELECT product_id, min(price_minor) AS low, max(price_minor) AS high, CAST(floor((max(price_minor) - min(price_minor)) * 100.0 / max(price_minor) + 0.5) AS BIGINT) AS spread FROM {OFFERS_SQL} WHERE price_minor > 0 GROUP BY product_id"""
)
def price_spread(spark, sf_dir):
    """Price range of each product and its spread in percent."""
    low, high = F.min("price_minor"), F.max("price_minor")
    return offers(spark, sf_dir).where("price_minor > 0").groupBy("product_id").agg(low.alias("low"), high.alias("high"), F.floor((high - low) * 100.0 / high + 0.5).cast("long").alias("spread"))


@query(f"SELECT product_id, count(*) AS listing_count, count(DISTINCT source_id) AS source_count FROM {OFFERS_SQL} GROUP BY product_id")
def product_aggregates(spark, sf_dir):
    """A2: offers and sources of each product."""
    return entity.product_aggregates(offers(spark, sf_dir), "product_id", "source_id")


@query(f"SELECT product_id, source_id, count(*) AS n FROM {OFFERS_SQL} GROUP BY ALL HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    """A3: products with several offers of one source."""
    return entity.duplicate_groups(offers(spark, sf_dir), "product_id", "source_id")


@query("""SELECT DISTINCT l_suppkey, l_partkey, min(l_orderkey) OVER (PARTITION BY l_partkey, l_suppkey) AS keeper, count(*) OVER (PARTITION BY l_partkey, l_suppkey) AS offers FROM lineitem""")
def recluster_keepers(spark, sf_dir):
    """The offer that stays for each product and source."""
    kept = entity.keepers(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    return kept.groupBy("l_suppkey", "l_partkey").agg(F.min(F.when(F.col("keep"), F.col("l_orderkey"))).alias("keeper"), F.count("*").alias("offers"))


@query(
    f"""SELECT product_id, count(DISTINCT source_id) AS sources, count(*) AS listings FROM {OFFERS_SQL} o JOIN part ON p_partkey = product_id WHERE p_name NOT LIKE 'sponsored%' GROUP BY product_id HAVING count(DISTINCT source_id) >= 2 ORDER BY sources DESC, listings DESC, product_id LIMIT 10"""
)
def featured_clusters(spark, sf_dir):
    """The ten products with the most sources, then offers."""
    named = offers(spark, sf_dir).join(table(spark, sf_dir, "part").where(~F.col("p_name").rlike("(?i)^sponsored")).select(F.col("p_partkey").alias("product_id")), "product_id")
    grouped = named.groupBy("product_id").agg(F.countDistinct("source_id").alias("sources"), F.count("*").alias("listings")).where("sources >= 2")
    return grouped.orderBy(F.desc("sources"), F.desc("listings"), "product_id").limit(10)


@query(f"""WITH m AS (SELECT product_id, median(price_minor) AS median FROM {OFFERS_SQL} WHERE price_minor > 0 GROUP BY product_id)
SELECT product_id, median, count(*) AS fitting FROM {OFFERS_SQL} o JOIN m USING (product_id) WHERE price_minor <= 0 OR price_minor / median BETWEEN 0.25 AND 4 GROUP BY ALL""")
def median_price_fit(spark, sf_dir):
    """Exact median of each product and the offers that fit it."""
    rows = offers(spark, sf_dir).select("product_id", "price_minor")
    return rows.join(entity.price_medians(rows, "product_id", "price_minor"), "product_id").where(scoring.price_fit(F.col("price_minor"), F.col("median"))).groupBy("product_id", "median").agg(F.count("*").alias("fitting"))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def semi_exists(spark, sf_dir):
    """Customers with a finished order."""
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return rel.with_children(table(spark, sf_dir, "customer"), done, "c_custkey", "o_custkey").select("c_custkey", "c_name")


@query("SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def anti_orphans(spark, sf_dir):
    """Parts without any large line item."""
    large = table(spark, sf_dir, "lineitem").where("l_quantity > 45")
    return rel.orphans(table(spark, sf_dir, "part"), large, "p_partkey", "l_partkey").select("p_partkey", "p_name")


@query(
    """SELECT c_custkey, o.first_order, o.first_order IS NOT NULL AS saved FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS first_order FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) o ON o_custkey = c_custkey"""
)
def left_saved(spark, sf_dir):
    """Every customer with its first urgent order, if there is one."""
    first = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("first_order"))
    return table(spark, sf_dir, "customer").join(first, "c_custkey", "left").select("c_custkey", "first_order", F.col("first_order").isNotNull().alias("saved"))


@query("""WITH live AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O'), cached AS (SELECT DISTINCT o_orderkey, o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))
SELECT o_orderkey, o_custkey, 'live' AS origin FROM live UNION ALL SELECT o_orderkey, o_custkey, 'cache' FROM cached WHERE o_orderkey NOT IN (SELECT o_orderkey FROM live)""")
def live_union_cached(spark, sf_dir):
    """Live rows and the cached ones that aren't live."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    live, cached = rows.where("o_orderstatus = 'O'"), rows.where("o_orderpriority in ('1-URGENT', '2-HIGH')")
    keep = ["o_orderkey", "o_custkey"]
    return rel.live_and_cached(live.select(*keep), cached.select(*keep), "o_orderkey")


@query(
    """SELECT l_orderkey, l_linenumber, p_name, s_name, n_name, r_name FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE l_quantity >= 49"""
)
def listing_dimensions(spark, sf_dir):
    """Listings with product, source and place."""
    t = lambda n: table(spark, sf_dir, n)
    return t("lineitem").where("l_quantity >= 49").join(t("part"), F.col("p_partkey") == F.col("l_partkey")).join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey")).join(t("region"), F.col("r_regionkey") == F.col("n_regionkey")).select(
        "l_orderkey",
        "l_linenumber",
        "p_name",
        "s_name",
        "n_name",
        "r_name",
    )


@query("""WITH e AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS v FROM events)
SELECT n.event_id, n.event_type AS now_type, p.event_type AS before_type, p.event_id IS NULL OR p.event_type <> n.event_type AS target FROM e n LEFT JOIN e p ON p.user_id = n.user_id AND p.v = n.v - 1""")
def prior_version(spark, sf_dir):
    """Each version with the one before it, and whether it has to be embedded again."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("now_type"), F.lag("event_type").over(w).alias("before_type"))
    return rows.withColumn("target", F.col("before_type").isNull() | (F.col("before_type") != F.col("now_type")))


@query("""SELECT doc_id, source, n_chars FROM (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 8 ORDER BY n_chars DESC, doc_id LIMIT 48""")
def top_n_per_source(spark, sf_dir):
    """A balanced pool of 48 with eight of a source at most."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return rel.top_per_source(rows, "source", [F.desc("n_chars"), F.asc("doc_id")], 8, 48)


@query("""SELECT p_name, p_partkey, p_type, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_type, p_partkey) AS r FROM part) WHERE r = 1""")
def first_seen_dedupe(spark, sf_dir):
    """The first part of each name in slot order."""
    return rel.first_seen(table(spark, sf_dir, "part").select("p_name", "p_partkey", "p_type", "p_size"), "p_name", ["p_type", "p_partkey"])


@query("""WITH s AS (SELECT p_partkey, p_name, p_type AS slot, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice, p_partkey) AS pos FROM part), f AS (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY pos, slot) AS r FROM s)
SELECT p_name, p_partkey, slot, pos FROM f WHERE r = 1 ORDER BY pos, slot LIMIT 24""")
def round_robin_picks(spark, sf_dir):
    """Slots take turns, repeated titles are skipped."""
    w = Window.partitionBy("p_type").orderBy("p_retailprice", "p_partkey")
    rows = table(spark, sf_dir, "part").select("p_name", "p_partkey", F.col("p_type").alias("slot"), F.row_number().over(w).cast("long").alias("pos"))
    return rel.round_robin(rows, "slot", "pos", "p_name", 24)


@query(
    f"""SELECT product_id, source_id, total FROM (SELECT product_id, source_id, CASE WHEN price_minor > 0 THEN price_minor + greatest(shipping_minor, 0) ELSE 9223372036854775807 END AS total, row_number() OVER (PARTITION BY product_id ORDER BY CASE WHEN price_minor > 0 THEN price_minor + greatest(shipping_minor, 0) ELSE 9223372036854775807 END, source_id, external_id) AS r FROM {OFFERS_SQL}) WHERE r <= 3"""
)
def landed_price_sort(spark, sf_dir):
    """O3: the three offers of each product that are cheapest with shipping."""
    rows = offers(spark, sf_dir).withColumn("total", rel.landed(F.col("price_minor"), F.col("shipping_minor")))
    return rel.latest_n(rows, "product_id", [F.asc("total"), F.asc("source_id"), F.asc("external_id")], 3).select("product_id", "source_id", "total")


@query(f"""WITH r AS (SELECT product_id, total, lead(total) OVER (PARTITION BY product_id ORDER BY total) AS next, row_number() OVER (PARTITION BY product_id ORDER BY total) AS r FROM (SELECT product_id, source_id, min(price_minor + shipping_minor) AS total FROM {OFFERS_SQL} WHERE price_minor > 0 GROUP BY ALL))
SELECT product_id, total AS best, next, next - total AS saves FROM r WHERE r = 1 AND next IS NOT NULL""")
def verified_deal(spark, sf_dir):
    """What the cheapest source saves against the next one."""
    per = offers(spark, sf_dir).where("price_minor > 0").groupBy("product_id", "source_id").agg(F.min(F.col("price_minor") + F.col("shipping_minor")).alias("total"))
    w = Window.partitionBy("product_id").orderBy("total")
    return per.select(
        "product_id",
        F.col("total").alias("best"),
        F.lead("total").over(w).alias("next"),
        F.row_number().over(w).alias("r"),
    ).where("r = 1 and next is not null").select("product_id", "best", "next", (F.col("next") - F.col("best")).alias("saves"))


@query(f"""WITH o AS (SELECT product_id, source_id, price_minor, external_id, CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) AS reference FROM {OFFERS_SQL} JOIN part ON p_partkey = product_id WHERE price_minor > 0),
c AS (SELECT product_id, min(price_minor) AS low, count(*) AS cheaper, any_value(reference) AS reference FROM o WHERE price_minor < reference GROUP BY product_id)
SELECT product_id, low, cheaper, reference - low AS savings, CASE WHEN (reference - low) * 100 >= 20 * reference THEN 'much cheaper' ELSE 'cheaper' END AS headline FROM c""")
def lookup_cheaper(spark, sf_dir):
    """Cheaper offers of a product than its reference price, with savings and a headline."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), minor("p_retailprice").alias("reference"))
    rows = offers(spark, sf_dir).where("price_minor > 0").join(p, "product_id").where("price_minor < reference")
    best = rows.groupBy("product_id", "reference").agg(F.min("price_minor").alias("low"), F.count("*").alias("cheaper"))
    saved = F.col("reference") - F.col("low")
    return best.select("product_id", "low", "cheaper", saved.alias("savings"), F.when(saved * 100 >= 20 * F.col("reference"), "much cheaper").otherwise("cheaper").alias("headline"))


@query("""SELECT 'documents' AS relation, count(*) AS n FROM documents UNION ALL SELECT 'products', count(*) FROM part UNION ALL SELECT 'listings', count(*) FROM lineitem UNION ALL SELECT 'sources', count(*) FROM supplier""")
def global_counts(spark, sf_dir):
    """Sizes of the catalogue."""
    n = lambda t, name: table(spark, sf_dir, t).agg(F.lit(name).alias("relation"), F.count("*").alias("n"))
    return n("documents", "documents").unionByName(n("part", "products")).unionByName(n("lineitem", "listings")).unionByName(n("supplier", "sources"))


@query(f"""SELECT s_suppkey, s_name, s_acctbal > 0 AS enabled, count(product_id) AS listings, count(DISTINCT product_id) AS products FROM supplier LEFT JOIN {OFFERS_SQL} o ON source_id = s_suppkey GROUP BY ALL""")
def source_summary(spark, sf_dir):
    """Sources with their state and size."""
    per = offers(spark, sf_dir).groupBy(F.col("source_id").alias("s_suppkey")).agg(F.count("*").alias("l"), F.countDistinct("product_id").alias("p"))
    return table(spark, sf_dir, "supplier").join(per, "s_suppkey", "left").select("s_suppkey", "s_name", (F.col("s_acctbal") > 0).alias("enabled"), F.coalesce("l", F.lit(0)).alias("listings"), F.coalesce("p", F.lit(0)).alias("products"))


@query("""WITH u AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase') AS hits, count(*) AS n, max(ts) AS last FROM events GROUP BY user_id), m AS (SELECT max(ts) AS now FROM events)
SELECT user_id, CASE WHEN hits >= 1 AND last >= now - INTERVAL 1 DAY THEN 'ok' WHEN n = 0 THEN 'unreachable' WHEN last < now - INTERVAL 1 DAY THEN 'stale' WHEN errors * 2 > n THEN 'blocked' ELSE 'empty' END AS status, errors, hits FROM u, m""")
def source_health(spark, sf_dir):
    """Status of each source from its probes."""
    e = table(spark, sf_dir, "events")
    per = e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "purchase").alias("hits"), F.count("*").alias("n"), F.max("ts").alias("last"))
    per = per.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now"))))
    fresh = F.col("last") >= F.col("now") - F.expr("INTERVAL 1 DAY")
    status = F.when((F.col("hits") >= 1) & fresh, "ok").when(F.col("n") == 0, "unreachable").when(~fresh, "stale").when(F.col("errors") * 2 > F.col("n"), "blocked").otherwise("empty")
    return per.select("user_id", status.alias("status"), "errors", "hits")


@query("""WITH saved AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), wanted AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O') SELECT k FROM saved UNION SELECT k FROM wanted""")
def wishlist_save(spark, sf_dir):
    """Saving what isn't saved yet."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return rel.wishlist_changes(o.where("o_orderstatus = 'F'").select("k").distinct(), o.where("o_orderstatus = 'O'"), "k")


@query(f"""WITH low AS (SELECT product_id, min(price_minor) FILTER (price_minor > 0) AS cheapest FROM {OFFERS_SQL} GROUP BY 1)
SELECT p_partkey, cheapest, coalesce(cheapest > 0 AND cheapest <= p_size * 3000, false) AS hit FROM part LEFT JOIN low ON product_id = p_partkey""")
def wishlist_targets(spark, sf_dir):
    """Saved products whose cheapest offer is at or under the alert."""
    low = offers(spark, sf_dir).where("price_minor > 0").groupBy(F.col("product_id").alias("p_partkey")).agg(F.min("price_minor").alias("cheapest"))
    return table(spark, sf_dir, "part").join(low, "p_partkey", "left").select("p_partkey", "cheapest", F.coalesce(F.col("cheapest") <= F.col("p_size") * 3000, F.lit(False)).alias("hit"))


@query("""WITH old AS (SELECT s_suppkey AS k, s_name AS label, s_acctbal > 0 AS enabled FROM supplier WHERE s_suppkey % 3 <> 0), new AS (SELECT s_suppkey AS k, lower(s_name) AS label, true AS enabled FROM supplier WHERE s_suppkey % 2 = 0)
SELECT coalesce(new.k, old.k) AS k, coalesce(new.label, old.label) AS label, coalesce(old.enabled, new.enabled) AS enabled FROM old FULL JOIN new ON old.k = new.k""")
def seed_upsert(spark, sf_dir):
    """Seeds refresh labels and keep the user's switches."""
    s = table(spark, sf_dir, "supplier")
    old = s.where("s_suppkey % 3 != 0").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("old_label"), (F.col("s_acctbal") > 0).alias("old_enabled"))
    new = s.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("k"), F.lower("s_name").alias("new_label"), F.lit(True).alias("new_enabled"))
    return old.join(new, "k", "full").select("k", F.coalesce("new_label", "old_label").alias("label"), F.coalesce("old_enabled", "new_enabled").alias("enabled"))


@query(
    """SELECT event_id, CASE WHEN length(props) <= 50000 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, event_type IN ('click', 'purchase') AS accepted, sha256(event_type || '|' || CAST(user_id AS VARCHAR)) AS query_hash FROM events"""
)
def telemetry_rows(spark, sf_dir):
    """Telemetry with bounded JSON and a hash for what was asked."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.when(F.length("props") <= 50000, F.get_json_object("props", "$.k").cast("long")).alias("k"),
        F.col("event_type").isin("click", "purchase").alias("accepted"),
        F.sha2(F.concat_ws("|", "event_type", F.col("user_id").cast("string")), 256).alias("query_hash"),
    )


@query("""SELECT conv_id, turn, role FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE role <> 'system') WHERE r <= 10""")
def discussion_snippets(spark, sf_dir):
    """The first ten turns of each discussion."""
    rows = table(spark, sf_dir, "conversations").where("role != 'system'")
    return rel.latest_n(rows, "conv_id", [F.asc("turn")], 10).select("conv_id", "turn", "role")


@query(f"""WITH p AS (SELECT product_id, count(DISTINCT source_id) AS sources, max(l_shipdate) AS seen FROM {OFFERS_SQL} GROUP BY 1), n AS (SELECT * FROM p ORDER BY seen DESC, product_id LIMIT 30)
SELECT product_id, sources FROM n WHERE sources >= 2 ORDER BY sources DESC, product_id LIMIT 8""")
def compared_products(spark, sf_dir):
    """Of the thirty newest products those with two sources or more, eight at most."""
    p = offers(spark, sf_dir).groupBy("product_id").agg(F.countDistinct("source_id").alias("sources"), F.max("l_shipdate").alias("seen"))
    return p.orderBy(F.desc("seen"), "product_id").limit(30).where("sources >= 2").orderBy(F.desc("sources"), "product_id").limit(8).select("product_id", "sources")


@query("""WITH m AS (SELECT max(epoch_us(ts)) AS now FROM events), e AS (SELECT event_id, (m.now // 1000000) - (epoch_us(ts) // 1000000) AS s FROM events, m)
SELECT event_id, CASE WHEN s < 45 THEN 'just now' WHEN s < 3600 THEN CAST(greatest(s // 60, 1) AS VARCHAR) || 'm ago' WHEN s < 86400 THEN CAST(s // 3600 AS VARCHAR) || 'h ago' ELSE CAST(s // 86400 AS VARCHAR) || 'd ago' END AS ago FROM e""")
def time_ago(spark, sf_dir):
    """age of events in words."""
    e = table(spark, sf_dir, "events").select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    return e.crossJoin(F.broadcast(e.agg(F.max("t").alias("now")))).select("event_id", text.time_ago(F.col("now") - F.col("t")).alias("ago"))


# Vectors and entities

VECTOR_QUERY_SQL = "SELECT q.vec_id AS query_id, v.vec_id AS id, list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) / sqrt(list_sum(list_transform(q.embedding, lambda z: CAST(z AS DOUBLE) * z)) * list_sum(list_transform(v.embedding, lambda z: CAST(z AS DOUBLE) * z))) AS c FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0"


@query(
    f"""WITH s AS ({VECTOR_QUERY_SQL}), r AS (SELECT query_id, id, round(least(1, greatest(0, c)), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(least(1, greatest(0, c)), 6) DESC, id) AS rank FROM s WHERE round(least(1, greatest(0, c)), 6) > 0.15) SELECT * FROM r WHERE rank <= 20"""
)
def cosine_topk(spark, sf_dir):
    """Vector channel of every vector whose id is divisible by 100."""
    v = table(spark, sf_dir, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    found, _ = vector_index.search(vector_index.build(v), q, 20, floor=0.15)
    return found.select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


@query("""
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e),
m AS (SELECT u.vec_id, list_transform(list_zip(b.v, u.v), lambda z: z[1] + 0.25 * z[2]) AS v FROM u JOIN u b ON b.vec_id = u.label),
s AS (SELECT q.vec_id AS query_id, m.vec_id AS id, round(list_dot_product(q.v, m.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(m.v, m.v)), 6) AS score FROM m q, m WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score > 0.5)
SELECT query_id, id, score, rank FROM r WHERE rank <= 15
""")
def vector_cells_topk(spark, sf_dir):
    """Exact top-k from the cells that can matter; the vectors lie around ten directions."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", scoring.unit(F.col("embedding").cast("array<double>")).alias("v"))
    around = v.select(F.col("vec_id").cast("int").alias("label"), F.col("v").alias("b"))
    made = v.join(around, "label").select("vec_id", F.zip_with("b", "v", lambda x, y: x + 0.25 * y).alias("embedding"))
    q = made.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    found, _ = vector_index.search(vector_index.build(made, cells=24), q, 15, floor=0.5)
    return found.select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


@query("""WITH e AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings), s AS (SELECT label, i, sum(CAST(x AS DOUBLE)) AS s FROM e GROUP BY ALL), c AS (SELECT label, list(s ORDER BY i) AS v, sqrt(sum(s * s)) AS n FROM s GROUP BY label),
d AS (SELECT vec_id, c.label, list_sum(list_transform(list_zip(embedding, v), lambda z: CAST(z[1] AS DOUBLE) * z[2])) / n AS score FROM embeddings, c), r AS (SELECT vec_id AS id, label, round(score, 6) AS score, row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 9) DESC, label) AS r FROM d) SELECT id, label, score FROM r WHERE r = 1""")
def centroid_assign(spark, sf_dir):
    """Every vector's most similar centroid."""
    v = table(spark, sf_dir, "embeddings")
    return entity.nearest_centroid(v, entity.centroids(v, "label", "embedding"), "label", "embedding", "vec_id").select("id", "label", F.round("score", 6).alias("score"))


@query("""WITH h AS (SELECT s_suppkey AS id, xor(CAST('0x' || substr(md5(CAST(s_suppkey // 5 AS VARCHAR)), 1, 15) AS BIGINT), CAST(1 AS BIGINT) << CAST(s_suppkey % 59 AS INT)) AS hash FROM supplier), u AS (SELECT * FROM h WHERE bit_count(hash) BETWEEN 4 AND 60)
SELECT l.id AS left_id, r.id AS right_id, CAST(bit_count(xor(l.hash, r.hash)) AS BIGINT) AS distance FROM u l, u r WHERE l.id < r.id AND bit_count(xor(l.hash, r.hash)) <= 6""")
def hamming_join(spark, sf_dir):
    """Pairs of 64-bit hashes within six bits, by seven bands. Five suppliers in a row share a hash but for one bit."""
    common = F.conv(F.substring(F.md5(F.floor(F.col("s_suppkey") / 5).cast("long").cast("string").cast("binary")), 1, 15), 16, 10).cast("long")
    flip = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("s_suppkey") % 59).cast("int"))
    h = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), common.bitwiseXOR(flip).alias("hash"))
    return entity.hamming_pairs(h, h, within=True)


@query(
    """WITH v AS (SELECT vec_id, embedding FROM embeddings), s AS (SELECT vec_id, list_sum(list_transform(embedding, lambda x, i: CASE WHEN x > 0 THEN i ELSE 0 END)) AS places, list_sum(list_transform(embedding, lambda x: CAST(x > 0 AS INT))) AS bits FROM v) SELECT vec_id, CAST(bits AS BIGINT) AS bits, bits BETWEEN 4 AND 60 AS useful FROM s"""
)
def image_hash(spark, sf_dir):
    """Sign hash of every vector and whether it tells anything."""
    h = entity.sign_hash(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.bit_count(h).cast("long").alias("bits"), scoring.useful_hash(h).alias("useful"))


@query("""
WITH RECURSIVE e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
r AS (
  SELECT label, id, 1.0::DOUBLE - (id * 37 % 101) / 150.0 AS base, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v,
    id % 7 AS aspect, id % 11 AS w, id % 3 AS x, id % 5 AS source, id % 50 AS model FROM e),
go AS (
  SELECT label, 0 AS position, [] :: STRUCT(id BIGINT, v DOUBLE[], aspect BIGINT, w BIGINT, x BIGINT, source BIGINT, model BIGINT)[] AS picks,
    NULL::BIGINT AS id, NULL::DOUBLE AS base, NULL::DOUBLE AS final, NULL::BOOLEAN AS relaxed FROM r GROUP BY label
  UNION ALL
  SELECT label, position + 1, list_append(picks, {'id': b.id, 'v': b.v, 'aspect': b.aspect, 'w': b.w, 'x': b.x, 'source': b.source, 'model': b.model}), b.id, b.base, b.final, b.relaxed
  FROM (
    SELECT label, position, any_value(picks) AS picks, min_by(s, (s.relaxed, -s.final, -s.base, s.id)) AS b
    FROM (
      SELECT g.label, g.position, g.picks, {'id': r.id, 'v': r.v, 'aspect': r.aspect, 'w': r.w, 'x': r.x, 'source': r.source, 'model': r.model, 'base': r.base,
        'relaxed': len(list_filter(g.picks, lambda p: p.source = r.source)) >= 10 OR len(list_filter(g.picks, lambda p: p.model = r.model)) >= 1,
        'final': least(1.0, greatest(0.0, 0.7 * r.base + 0.3 * (
          0.6 * (1 - coalesce(list_max(list_transform(g.picks, lambda p: CASE WHEN p.model = r.model THEN 1.0::DOUBLE ELSE
            0.65 * least(1.0, greatest(0.0, list_dot_product(p.v, r.v)))
            + 0.25 * CASE WHEN p.w = r.w AND p.x = r.x THEN 1.0 WHEN p.w = r.w OR p.x = r.x THEN 1.0 / 3 ELSE 0 END
            + 0.1 * CASE WHEN p.aspect = r.aspect THEN 1.0 ELSE 0 END END)), 0.0))
          + 0.4 / (1 + len(list_filter(g.picks, lambda p: p.aspect = r.aspect))))))} AS s
      FROM go g JOIN r USING (label) WHERE g.position < 24 AND NOT list_contains(list_transform(g.picks, lambda p: p.id), r.id))
    GROUP BY label, position))
SELECT label AS query_id, id, base, round(final, 9) AS final, relaxed, CAST(position AS BIGINT) AS position FROM go WHERE position > 0
""")
def mmr_diversify(spark, sf_dir):
    """Diversified order of each label's vectors."""
    v = table(spark, sf_dir, "embeddings")
    tag = lambda letter, n: F.concat(F.lit(letter), (F.col("vec_id") % n).cast("string"))
    rows = v.select(
        F.col("label").alias("query_id"),
        F.col("vec_id").alias("id"),
        F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("key"),
        (1.0 - (F.col("vec_id") * 37 % 101) / 150.0).alias("base"),
        "embedding",
        F.array(tag("a", 7)).alias("aspects"),
        F.array(tag("w", 11), tag("v", 3)).alias("words"),
        tag("s", 5).alias("source"),
        tag("m", 50).alias("model"),
    )
    return ranking.diversify(rows, 0.7).select("query_id", "id", "base", F.round("final", 9).alias("final"), "relaxed", "position")


ENTITY_SQL = f"""c AS (SELECT p_brand AS query_id, p_partkey AS id, 's' || CAST(p_partkey % 7 AS VARCHAR) AS source, CASE WHEN p_partkey % 3 = 0 THEN 'gtin:' || replace({norm_sql('p_type')}, ' ', '') || CAST(p_size AS VARCHAR) WHEN p_partkey % 3 = 1 THEN 'model:' || {norm_sql('p_brand')} || ':' || {norm_sql('p_type')} ELSE 'canonical:' || replace({norm_sql('p_name')}, ' ', '') END AS key,
 CASE WHEN p_partkey % 4 > 0 THEN p_size / 50.0 - 0.3 END AS semantic, p_partkey % 11 / 10.0 AS lexical, p_partkey % 10 / 9.0 AS relevance, CASE WHEN p_partkey % 5 > 0 THEN 0.5 END AS quality FROM part),
ch AS (SELECT p_brand AS query_id, p_partkey AS id, 'lexical:literal' AS channel, 2.2 AS w, 1 + p_partkey * 7919 % 97 AS rank FROM part UNION ALL SELECT p_brand, p_partkey, 'semantic', 1.0, 1 + p_partkey * 104729 % 89 FROM part WHERE p_partkey % 4 > 0 UNION ALL SELECT p_brand, p_partkey, 'native:0', 1.35, 1 + p_partkey % 31 FROM part WHERE p_partkey % 2 = 0),
f AS (SELECT query_id, id, sum(w / (60 + rank)) / (5.3 / 61) AS rrf FROM ch GROUP BY ALL)"""


def base_sql(rrf: str) -> str:
    sem, bound = "CASE WHEN semantic < 0 THEN (semantic + 1) / 2 ELSE semantic END", "least(1.0, greatest(0.0, {}))"
    weight = {"0.25": ("semantic", bound.format(sem)), "0.12": ("lexical", bound.format("lexical")), "0.18": ("relevance", bound.format("relevance")), "0.05": ("quality", bound.format("quality"))}
    total = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE {w} END" for w, (c, _) in weight.items())
    return f"round((0.4 * {bound.format(rrf)} + {' + '.join(f'coalesce({w} * {v}, 0)' for w, (_, v) in weight.items())}) / (0.4 + {total}), 9)"


@query(f"""WITH {ENTITY_SQL}, o AS (SELECT c.*, {base_sql('rrf')} AS own FROM c JOIN f USING (query_id, id)), p AS (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY own DESC, id) AS r FROM o),
g AS (SELECT query_id, key, max(CASE WHEN r = 1 THEN id END) AS id, count(*) AS offers, count(DISTINCT source) AS sources, max(semantic) AS semantic, max(lexical) AS lexical, max(relevance) AS relevance, max(quality) AS quality FROM p GROUP BY ALL),
m AS (SELECT query_id, key, channel, any_value(w) AS w, min(rank) AS rank FROM ch JOIN c USING (query_id, id) GROUP BY query_id, key, channel), e AS (SELECT query_id, key, sum(w / (60 + rank)) / (5.3 / 61) AS rrf FROM m GROUP BY ALL),
b AS (SELECT g.*, {base_sql('rrf')} AS base FROM g JOIN e USING (query_id, key)), k AS (SELECT *, max(base) OVER (PARTITION BY query_id) AS top FROM b WHERE base >= 0.2) SELECT query_id, key, id, offers, sources, round(base, 6) AS base, base >= top * 0.8 AS eligible FROM k""")
def search_entities(spark, sf_dir):
    """Offers with numbers, models or neither as entities, with their own base score, the floor and the gate."""
    k = F.col("p_partkey")
    none = F.lit(None).cast("string")
    key = ranking.canonical_key(
        F.col("p_name"),
        F.col("p_brand"),
        F.when(k % 3 == 1, F.col("p_type")),
        {"canonical": F.when(k % 3 == 2, F.col("p_name")).otherwise(none), "gtin": F.when(k % 3 == 0, F.concat("p_type", F.col("p_size").cast("string"))).otherwise(none)},
    )
    model = ranking.model_key(F.col("p_brand"), F.when(k % 3 == 1, F.col("p_type")))
    part = table(spark, sf_dir, "part").withColumn("query_id", F.col("p_brand")).withColumn("id", k)
    rows = part.select(
        "query_id",
        "id",
        key.alias("key"),
        F.concat(F.lit("s"), (k % 7).cast("string")).alias("source"),
        model.alias("model"),
        F.col("p_name").alias("title"),
        F.array_distinct(text.title_tokens(F.col("p_name"))).alias("words"),
        F.array("p_type").alias("aspects"),
        F.lit(None).cast("array<double>").alias("embedding"),
        F.when(k % 4 > 0, F.col("p_size") / 50.0 - 0.3).alias("semantic"),
        (k % 11 / 10.0).alias("lexical"),
        (k % 10 / 9.0).alias("relevance"),
        F.when(k % 5 > 0, 0.5).alias("quality"),
    )
    at = lambda df, name, rank: df.select("query_id", "id", F.lit(name).alias("channel"), rank.cast("long").alias("rank"))
    channels = at(part, "lexical:literal", 1 + k * 7919 % 97).unionByName(at(part.where(k % 4 > 0), "semantic", 1 + k * 104729 % 89)).unionByName(at(part.where(k % 2 == 0), "native:0", 1 + k % 31))
    found = ranking.entities(rows, channels, {"lexical:literal": 2.2, "lexical:expanded": 0.75, "semantic": 1.0, "native:0": 1.35})
    return ranking.gated(found, F.lit(0.8), 0.2).select("query_id", "key", "id", "offers", "sources", F.round("base", 6).alias("base"), "eligible")


@query("""WITH v AS (SELECT vec_id, label, embedding, 'm' || CAST(vec_id % 40 AS VARCHAR) AS model, [CAST(vec_id % 5 AS VARCHAR), CAST(vec_id % 3 AS VARCHAR)] AS words, CASE WHEN vec_id % 6 = 0 THEN [] ELSE ['a' || CAST(vec_id % 2 AS VARCHAR)] END AS aspects FROM embeddings), f AS (SELECT label, min(vec_id) AS first FROM v GROUP BY 1),
p AS (SELECT a.vec_id, a.model = b.model AS same, a.vec_id % 9 = 0 AS blind, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(z[1] AS DOUBLE) * z[2])) / sqrt(list_sum(list_transform(a.embedding, lambda z: CAST(z AS DOUBLE) * z)) * list_sum(list_transform(b.embedding, lambda z: CAST(z AS DOUBLE) * z))) AS c,
 len(list_intersect(a.words, b.words)) / len(list_distinct(list_concat(a.words, b.words))) AS t, CASE WHEN len(a.aspects) = 0 OR len(b.aspects) = 0 THEN 0.0 WHEN a.aspects[1] = b.aspects[1] THEN 1.0 ELSE 0.0 END AS s FROM v a JOIN f USING (label) JOIN v b ON b.vec_id = f.first)
SELECT vec_id, round(CASE WHEN same THEN 1.0 WHEN blind THEN 0.75 * t + 0.25 * s ELSE 0.65 * least(1, greatest(0, c)) + 0.25 * t + 0.1 * s END, 6) AS similarity FROM p""")
def entity_similarity(spark, sf_dir):
    """Similarity of each vector's entity with its label's first, where some have no vector."""
    k = F.col("vec_id")
    v = table(spark, sf_dir, "embeddings").select(
        k,
        "label",
        "embedding",
        F.concat(F.lit("m"), (k % 40).cast("string")).alias("model"),
        F.array((k % 5).cast("string"), (k % 3).cast("string")).alias("words"),
        F.when(k % 6 == 0, F.expr("cast(array() as array<string>)")).otherwise(F.array(F.concat(F.lit("a"), (k % 2).cast("string")))).alias("aspects"),
    )
    first = v.groupBy("label").agg(F.min_by(F.struct("model", "embedding", "words", "aspects"), "vec_id").alias("f"))
    own = F.when(k % 9 != 0, F.col("embedding"))
    return v.join(F.broadcast(first), "label").select(
        "vec_id",
        F.round(scoring.entity_similarity(F.col("model"), own, F.col("words"), F.col("aspects"), F.col("f.model"), F.col("f.embedding"), F.col("f.words"), F.col("f.aspects")), 6).alias("similarity"),
    )


CHANNEL_SQL = """ch AS (SELECT lang AS query_id, doc_id AS id, 'literal' AS channel, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents
UNION ALL SELECT lang, doc_id, 'native', row_number() OVER (PARTITION BY lang ORDER BY doc_id * 7919 % 1009, doc_id) FROM documents WHERE doc_id % 2 = 0
UNION ALL SELECT lang, doc_id, 'other', row_number() OVER (PARTITION BY lang ORDER BY doc_id) FROM documents WHERE doc_id % 3 = 0),
rrf AS (SELECT query_id, id, least(1, greatest(0, sum(CASE channel WHEN 'literal' THEN 2.2 WHEN 'native' THEN 1.35 ELSE 1 END / (60 + rank)) / ((2.2 + 1.35 + 0.75 + 1) / 61))) AS rrf FROM ch GROUP BY ALL)"""


def fused(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("id"), "n_chars")
    rank = lambda df, name, bucket, *order: retrieval.ranked_in_buckets(df, "query_id", bucket, *order).select("query_id", "id", F.lit(name).alias("channel"), "rank")
    own = F.col("id") * 7919 % 1009
    literal = rank(d, "literal", -F.floor(F.col("n_chars") / 100), F.desc("n_chars"), F.asc("id"))
    rows = literal.unionByName(rank(d.where("id % 2 = 0"), "native", own, own, F.asc("id"))).unionByName(rank(d.where("id % 3 = 0"), "other", F.floor(F.col("id") / 1000), F.asc("id")))
    return retrieval.reciprocal_rank_fusion(rows, {"literal": 2.2, "native": 1.35, "expanded": 0.75})


@query(f"WITH {CHANNEL_SQL} SELECT query_id, id, round(rrf, 9) AS rrf FROM rrf")
def rrf_fusion(spark, sf_dir):
    """Weighted reciprocal-rank fusion of three channels with a shared denominator."""
    return fused(spark, sf_dir).select("query_id", "id", F.round("rrf", 9).alias("rrf"))


@query(f"""WITH {CHANNEL_SQL}, h AS (SELECT r.query_id, id, (0.4 * rrf + 0.18 * least(n_chars / 5000.0, 1) + coalesce(0.05 * quality, 0)) / (0.4 + 0.18 + CASE WHEN quality IS NULL THEN 0 ELSE 0.05 END) AS base FROM rrf r JOIN documents d ON d.doc_id = id LEFT JOIN labels l ON l.doc_id = id),
m AS (SELECT query_id, max(base) AS top FROM h GROUP BY 1) SELECT query_id, id, round(base, 6) AS base, base >= top * 0.7 AS eligible FROM h JOIN m USING (query_id)""")
def hybrid_gate(spark, sf_dir):
    """Weighted mean over the signals that are there, and the relative gate."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.least(F.col("n_chars") / 5000.0, F.lit(1.0)).alias("relevance"))
    q = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("quality"))
    rows = fused(spark, sf_dir).join(d, "id").join(q, "id", "left")
    out = retrieval.gated(rows, retrieval.hybrid({"rrf": F.col("rrf"), "relevance": F.col("relevance"), "quality": F.col("quality")}), 0.7)
    return out.select("query_id", "id", F.round("base", 6).alias("base"), "eligible")


@query("""WITH c AS (SELECT lower(p_brand) || ':' || lower(p_type) AS key, p_partkey AS id, p_size / 50.0 AS base, 's' || CAST(p_partkey % 7 AS VARCHAR) AS source, p_size / 60.0 AS semantic, p_partkey % 13 + 1 AS rank FROM part)
SELECT 'model:' || key AS key, arg_max(id, (base, -id)) AS representative, max(base) AS base, count(*) AS offers, count(DISTINCT source) AS sources, round(max(semantic), 6) AS semantic, min(rank) AS rank FROM c GROUP BY key""")
def entity_group(spark, sf_dir):
    """Offers of one model as one entity, with the best of each signal."""
    key = F.concat_ws(":", F.lit("model"), F.lower("p_brand"), F.lower("p_type"))
    rows = table(spark, sf_dir, "part").select(
        key.alias("key"),
        F.col("p_partkey").alias("id"),
        (F.col("p_size") / 50.0).alias("base"),
        F.concat(F.lit("s"), (F.col("p_partkey") % 7).cast("string")).alias("source"),
        (F.col("p_size") / 60.0).alias("semantic"),
        (F.col("p_partkey") % 13 + 1).alias("rank"),
    )
    return ranking.entity_groups(rows, "key").withColumn("semantic", F.round("semantic", 6))


BUNDLE_SQL = """c AS (SELECT p_brand AS mission_id, CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'SMALL' THEN 1 ELSE 2 END AS slot, p_partkey AS id, p_name AS title, CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) AS price, p_size / 50.0 AS score, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size DESC, p_partkey) AS r FROM part WHERE p_type IN ('ECONOMY', 'SMALL', 'PROMO')),
h AS (SELECT * FROM c WHERE r <= 8), b AS (SELECT a.mission_id, [a.id, b.id, c.id] AS ids, a.price + b.price + c.price AS total, (a.score + b.score + c.score) / 3 AS rel, [a.r, b.r, c.r] AS ranks FROM h a JOIN h b ON b.mission_id = a.mission_id AND b.slot = 1 JOIN h c ON c.mission_id = a.mission_id AND c.slot = 2
 WHERE a.slot = 0 AND a.title <> b.title AND a.title <> c.title AND b.title <> c.title AND a.price + b.price + c.price <= 300000),
x AS (SELECT mission_id, ids, total, rel, 0 AS k, 'balanced' AS choice, row_number() OVER (PARTITION BY mission_id ORDER BY round(0.75 * rel + 0.25 * least(1, total / 300000.0), 9) DESC, ranks) AS n FROM b
UNION ALL SELECT mission_id, ids, total, rel, 1, 'value', row_number() OVER (PARTITION BY mission_id ORDER BY total, round(rel, 9) DESC, ranks) FROM b
UNION ALL SELECT mission_id, ids, total, rel, 2, 'premium', row_number() OVER (PARTITION BY mission_id ORDER BY total DESC, round(rel, 9) DESC, ranks) FROM b)"""


@query(
    f"""WITH {BUNDLE_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY mission_id, ids ORDER BY k) AS m FROM x WHERE n = 1) SELECT mission_id, choice, array_to_string(ids, '|') AS ids, total, round(rel, 6) AS relevance FROM f WHERE m = 1"""
)
def bundle_select(spark, sf_dir):
    """Balanced, value and premium bundles of three slots within a budget, a mission for each brand."""
    p = table(spark, sf_dir, "part").where("p_type in ('ECONOMY', 'SMALL', 'PROMO')")
    slot = F.when(F.col("p_type") == "ECONOMY", 0).when(F.col("p_type") == "SMALL", 1).otherwise(2)
    rank = F.row_number().over(Window.partitionBy("p_brand", "p_type").orderBy(F.desc("p_size"), "p_partkey"))
    rows = p.select(
        F.col("p_brand").alias("mission_id"),
        slot.alias("slot"),
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("title_key"),
        minor("p_retailprice").alias("price_minor"),
        F.lit("USD").alias("currency"),
        (F.col("p_size") / 50.0).alias("score"),
        rank.alias("rank"),
    )
    found = bundles.choices(bundles.combinations(rows, 3, budget_max=300_000), 300_000)
    return found.select("mission_id", "choice", F.concat_ws("|", F.transform("ids", lambda x: x.cast("string"))).alias("ids"), "total", F.round("relevance", 6).alias("relevance"))


# Evaluation


GRADED_SQL = "g AS (SELECT source AS case_id, d.doc_id, CAST(coalesce(quality, 0) * 2 + (1 - coalesce(toxic, 1)) AS BIGINT) AS grade, lang, coalesce(toxic, 0) AS leaked, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, d.doc_id) AS position FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"


def graded(spark, sf_dir):
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    grade = (F.coalesce("quality", F.lit(0)) * 2 + 1 - F.coalesce("toxic", F.lit(1))).cast("long")
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return d.drop("text").join(lab, "doc_id", "left").select(F.col("source").alias("case_id"), "doc_id", grade.alias("grade"), "lang", F.coalesce("toxic", F.lit(0)).alias("leaked"), rank.alias("position"))


@query(f"""WITH {GRADED_SQL}, a AS (SELECT case_id, sum((pow(2, grade) - 1) / log2(position + 1.0)) AS dcg FROM g WHERE position <= 10 GROUP BY 1), i AS (SELECT case_id, grade, row_number() OVER (PARTITION BY case_id ORDER BY grade DESC) AS p FROM g), b AS (SELECT case_id, sum((pow(2, grade) - 1) / log2(p + 1.0)) AS best FROM i WHERE p <= 10 GROUP BY 1)
SELECT case_id, round(CASE WHEN best > 0 THEN least(1, coalesce(dcg, 0) / best) ELSE 0 END, 6) AS ndcg FROM b LEFT JOIN a USING (case_id)""")
def ndcg_at_10(spark, sf_dir):
    """Graded gain of each case against its ideal order."""
    g = graded(spark, sf_dir)
    return evaluation.ndcg(g, g.select("case_id", "grade")).withColumn("ndcg", F.round("ndcg", 6))


@query(
    f"""WITH {GRADED_SQL} SELECT case_id, round(count(*) FILTER (position <= 5 AND grade >= 3) / 5.0, 6) AS precision, round(sum(leaked) / count(*), 6) AS leakage, round(1 - count(DISTINCT doc_id % 4) / count(*), 6) AS duplicates, count(DISTINCT doc_id % 4) AS entities, count(DISTINCT lang) AS sources FROM g WHERE position <= 10 GROUP BY case_id"""
)
def precision_leakage(spark, sf_dir):
    """V2: precision at five, leakage, duplicates, distinct entities and sources."""
    rows = graded(spark, sf_dir).select("case_id", "position", (F.col("grade") >= 3).alias("relevant"), "leaked", (F.col("doc_id") % 4).alias("entity"), F.col("lang").alias("source"))
    out = evaluation.precision_and_leakage(rows)
    return out.select("case_id", *(F.round(c, 6).alias(c) for c in ("precision", "leakage", "duplicates")), "entities", "sources")


@query(f"""WITH {GRADED_SQL}, n AS (SELECT case_id, lang, count(*) AS n FROM g WHERE position <= 10 GROUP BY ALL), p AS (SELECT case_id, n, n / sum(n) OVER (PARTITION BY case_id) AS p FROM n)
SELECT case_id, round(CASE WHEN count(*) > 1 AND sum(n) > 1 THEN sum(-p * ln(p)) / ln(count(*)) ELSE 0 END, 6) AS entropy FROM p GROUP BY 1""")
def source_entropy(spark, sf_dir):
    """Normalised entropy of the sources of each case's results."""
    rows = graded(spark, sf_dir).select("case_id", "position", F.col("lang").alias("source"))
    return evaluation.source_entropy(rows).withColumn("entropy", F.round("entropy", 6))


@query("""WITH r AS (SELECT lang AS case_id, doc_id % 3 AS run_id, doc_id // 3 % 40 AS result_id, row_number() OVER (PARTITION BY lang, doc_id % 3 ORDER BY n_chars DESC, doc_id) AS position FROM documents), s AS (SELECT case_id, run_id, list(DISTINCT result_id) AS ids FROM r WHERE position <= 10 GROUP BY ALL)
SELECT a.case_id, round(avg(len(list_intersect(a.ids, b.ids)) / len(list_distinct(list_concat(a.ids, b.ids)))), 6) AS repeatability FROM s a JOIN s b ON a.case_id = b.case_id AND a.run_id < b.run_id GROUP BY 1""")
def repeatability(spark, sf_dir):
    """Mean Jaccard of the result sets of pairs of runs."""
    d = table(spark, sf_dir, "documents")
    rank = F.row_number().over(Window.partitionBy("lang", F.col("doc_id") % 3).orderBy(F.desc("n_chars"), "doc_id"))
    runs = d.select(F.col("lang").alias("case_id"), (F.col("doc_id") % 3).alias("run_id"), (F.floor(F.col("doc_id") / 3) % 40).alias("result_id"), rank.alias("position"))
    return evaluation.repeatability(runs).withColumn("repeatability", F.round("repeatability", 6))


@query(
    """WITH s AS (SELECT unnest([lang, source, CASE WHEN n_chars > 1000 THEN 'long' ELSE 'short' END]) AS slice, quality FROM documents JOIN labels USING (doc_id)) SELECT slice, count(*) AS cases, round(coalesce(avg(quality), 0), 6) AS mean FROM s GROUP BY 1"""
)
def slice_summary(spark, sf_dir):
    """Mean quality of each slice; a case is in several."""
    rows = table(spark, sf_dir, "documents").drop("text").join(table(spark, sf_dir, "labels"), "doc_id").select(F.array("lang", "source", F.when(F.col("n_chars") > 1000, "long").otherwise("short")).alias("slices"), "quality")
    return evaluation.slice_summary(rows, "quality").withColumn("mean", F.round("mean", 6))


@query(
    """WITH need AS (SELECT DISTINCT lang AS case_id, source AS slot_id FROM documents), hit AS (SELECT DISTINCT lang AS case_id, source AS slot_id FROM documents JOIN labels USING (doc_id) WHERE toxic = 1) SELECT n.case_id, round(avg(CASE WHEN h.slot_id IS NULL THEN 0 ELSE 1 END), 6) AS coverage FROM need n LEFT JOIN hit h USING (case_id, slot_id) GROUP BY 1"""
)
def slot_coverage(spark, sf_dir):
    """V3: share of required slots that results fill."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("case_id"), F.col("source").alias("slot_id"))
    hit = d.join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")
    return evaluation.slot_coverage(hit, d.select("case_id", "slot_id").distinct()).withColumn("coverage", F.round("coverage", 6))


@query(
    """SELECT doc_id, 'missing' AS problem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION SELECT doc_id, 'unknown' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 1000) AND doc_id NOT IN (SELECT doc_id FROM documents)"""
)
def missing_unknown(spark, sf_dir):
    """V5, U4: cases without a prediction and predictions without a case."""
    return evaluation.missing_and_unknown(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


# TPC-H style scans that the catalogue needs


@query("""SELECT o_orderpriority, count(*) AS orders, sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) AS total FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY GROUP BY 1""")
def recent_orders(spark, sf_dir):
    """A scan of the last year, by priority."""
    o = table(spark, sf_dir, "orders")
    last = o.agg(F.max("o_orderdate").alias("last"))
    recent = o.crossJoin(F.broadcast(last)).where("o_orderdate >= last - INTERVAL 365 DAYS")
    return recent.groupBy("o_orderpriority").agg(F.count("*").alias("orders"), F.sum(minor("o_totalprice")).alias("total"))
