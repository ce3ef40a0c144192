"""Filters and classifications of rows around the search: sources, clusters, judged results, missions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import lexicon as lx, text

# Words that a listing's aspects are read from, and source types that are no shops.
ASPECTS = ("wireless", "bluetooth", "waterproof", "leather", "ergonomic", "mechanical", "portable", "compact", "gaming", "office", "running", "hiking", "standing", "foldable", "rechargeable", "quiet", "adjustable", "lightweight", "vegan")
NO_SHOPS = ("reddit", "rss", "mock")


def freshness(fetched: Column, now: Column, fresh: int = 600, usable: int = 3600) -> Column:
    """fresh, stale (usable while it is read again) or expired, by the seconds since a snapshot."""
    age = F.unix_seconds(now) - F.unix_seconds(fetched)
    return F.when(age <= fresh, "fresh").when(age <= usable, "stale").otherwise("expired")


def store_type(catalog_status: Column, store_status: Column) -> Column:
    """Kind of shop behind two captured probes: 200 on its catalogue or store endpoint; 403 on both is blocked."""
    return F.when(catalog_status == 200, "shopify").when(store_status == 200, "woocommerce").when((catalog_status == 403) | (store_status == 403), "blocked").otherwise("unknown")


def diagnosis(html: Column, listings: Column, last_ok_days: Column) -> Column:
    """Why a page gave no listings: blocked, empty, stale (its layout changed since it last worked), or ok if it gave some."""
    return F.when(listings > 0, "ok").when(text.blocked_page(html), "blocked").when(F.length(text.strip_tags(html)) < 40, "empty").when(text.js_shell(html), "script").when(last_ok_days.isNotNull(), "stale").otherwise("empty")


def string_hash(c: Column) -> Column:
    """Absolute value of the 32-bit polynomial hash with factor 31 of a text's characters (basic plane)."""
    folded = F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), F.lit(0).cast("long"), lambda h, x: F.pmod(h * 31 + F.ascii(x), F.lit(1 << 32)))
    return F.abs(F.when(folded >= (1 << 31), folded - (1 << 32)).otherwise(folded))


def mock_price(name: Column, base: Column) -> Column:
    """A deterministic price between 80 and 120 percent of a base price."""
    return F.floor(base * (80 + string_hash(name) % 41) / 100 + 0.5).cast("long")


def aspects(body: Column) -> Column:
    """Aspect words that are in a text, in their order."""
    words = F.split(F.trim(F.regexp_replace(F.lower(body), "[^a-z0-9]+", " ")), " ")
    return F.array_intersect(text.lit_array(ASPECTS), words)


def entity_aspects(facets: Column, category: Column, brand: Column, band: Column) -> Column:
    """Different tags facet:, category:, brand: and the price band; empty ones left out."""
    tag = lambda name, c: F.when(text.normalize_search(c) != "", F.concat(F.lit(f"{name}:"), text.normalize_search(c)))
    rows = F.concat(F.transform(facets, lambda f: tag("facet", f)), F.array(tag("category", category), tag("brand", brand), band))
    return F.array_distinct(F.filter(rows, lambda x: x.isNotNull()))


def slot_query(name: Column, low: Column, high: Column) -> Column:
    """A slot's query with its bounds in words; whole amounts without decimals."""
    money = lambda c: F.when(c % 100 == 0, F.concat(F.lit("$"), F.floor(c / 100).cast("string"))).otherwise(F.concat(F.lit("$"), F.replace(F.format_number(c / 100.0, 2), F.lit(","))))
    return F.concat_ws(" ", name, F.when(high.isNotNull(), F.concat(F.lit("under "), money(high))), F.when(low.isNotNull(), F.concat(F.lit("above "), money(low))))


def explanation(role: Column, reasons: Column, covered: Column) -> Column:
    """Up to three different notes: the role, two reasons, two newly covered facets."""
    return F.slice(F.array_distinct(F.concat(F.array(role), F.slice(reasons, 1, 2), F.slice(covered, 1, 2))), 1, 3)


def judged(df: DataFrame, query: str = "query_id", least: float = 0.45, blind: float = 0.35) -> DataFrame:
    """Rows whose judged score reaches the threshold. Where all of a query's are rejected, those with hardly any details
    come back on their own score; where nothing was judged, the score decides."""
    w = Window.partitionBy(query)
    good = F.coalesce(F.col("judged") >= least, F.lit(False))
    any_good, any_judged = F.max(good).over(w), F.max(F.col("judged").isNotNull()).over(w)
    keep = F.when(~any_judged, F.col("score") >= blind).when(any_good, good).otherwise((F.length(F.coalesce("details", F.lit(""))) < 20) & (F.col("score") >= blind))
    return df.withColumn("keep", keep).where("keep").drop("keep")


def relevant_clusters(df: DataFrame, cluster: str, query_tokens: Column, low: int | None = None, high: int | None = None, least: float = 0.25) -> DataFrame:
    """Clusters with a similarity of at least 0.25, every query token in some title and a known price in the window."""
    price = F.col("price_minor")
    inside = (price > 0) & (F.lit(low).isNull() | (price >= F.lit(low))) & (F.lit(high).isNull() | (price <= F.lit(high)))
    hit = df.select(cluster, "similarity", inside.alias("inside"), F.filter(query_tokens, lambda t: text.token_in_title(t, F.lower("title"))).alias("hit"), query_tokens.alias("all"))
    one = hit.groupBy(cluster).agg(F.max("similarity").alias("similarity"), F.max("inside").alias("inside"), F.first("all").alias("all"))
    got = hit.select(cluster, F.explode("hit").alias("t")).distinct().groupBy(cluster).agg(F.count("*").alias("got"))
    return one.join(got, cluster, "left").where((F.col("similarity") >= least) & F.col("inside") & (F.coalesce("got", F.lit(0)) >= F.size(F.array_distinct("all")))).select(cluster, "similarity")


def expanded_recall(first: DataFrame, wider: DataFrame, query: str = "query_id", few: int = 3, weak: float = 0.32) -> DataFrame:
    """Queries with fewer than three results or a weak best one take the wider variant's, if it has more or a better one."""
    stats = lambda df, p: df.groupBy(query).agg(F.count("*").alias(f"n_{p}"), F.max("score").alias(f"top_{p}"))
    both = stats(wider, "b").join(stats(first, "a"), query, "left")
    n, top = F.coalesce("n_a", F.lit(0)), F.coalesce("top_a", F.lit(0.0))
    use = both.where(((n < few) | (top < weak)) & ((F.col("n_b") > n) | (F.col("top_b") > top))).select(query)
    return first.join(use, query, "left_anti").withColumn("variant", F.lit(0)).unionByName(wider.join(use, query, "left_semi").withColumn("variant", F.lit(1)))


def banded_order(score: Column, price: Column, band: float = 0.05) -> list[Column]:
    """Order by bands of the score, then price: the transitive form of "a clear difference in score, else the price"."""
    return [F.floor(score / band).desc(), price.asc()]


def queue(df: DataFrame, key: str, order: str, most: int = 300) -> DataFrame:
    """Work to do: each key once, the oldest first, up to the queue's size."""
    return df.groupBy(key).agg(F.min(order).alias(order)).orderBy(order, key).limit(most)


def has_materials(title: Column, materials: list[str]) -> Column:
    """Whether a title literally holds every demanded material after imitations, negations and alternatives are blanked."""
    met = F.lit(True)
    for m in materials:
        low = F.lower(title)
        for pattern in (part.replace("MATERIAL", m) for part in lx.NOT_THE_MATERIAL):
            low = F.regexp_replace(low, pattern, " ")
        met = met & F.contains(low, F.lit(m))
    return met


def active_sources(sources: DataFrame, asked: str | None, key: str) -> DataFrame:
    """Sources whose key is in a request's comma list; all of them without a list. Unknown names are ignored."""
    names = [x.strip() for x in (asked or "").split(",") if x.strip()]
    return sources.where(F.col(key).cast("string").isin(names)) if names else sources


def source_report(listings: DataFrame, source: str, key: str, order: list[str], samples: int = 3) -> DataFrame:
    """(source, listings, samples): different listings of each source and the first few of them, of sanitised rows."""
    first = listings.groupBy(source, key).agg(F.min(F.struct(*order)).alias("at"))
    place = F.row_number().over(Window.partitionBy(source).orderBy("at", key))
    counted = first.groupBy(source).agg(F.count("*").alias("listings"))
    shown = first.withColumn("place", place).where(F.col("place") <= samples).groupBy(source).agg(F.array_sort(F.collect_list(F.struct("place", key))).alias("rows"))
    return counted.join(shown, source).select(source, "listings", F.transform("rows", lambda r: r[key]).alias("samples"))


def details_with_ocr(details: Column, ocr: Column) -> Column:
    """The parts that aren't empty, a line each; null if none is left."""
    parts = F.array_compact(F.array(F.nullif(F.trim(details), F.lit("")), F.nullif(F.trim(ocr), F.lit(""))))
    return F.nullif(F.array_join(parts, "\n"), F.lit(""))


def requested_sources(requests: DataFrame, sources: DataFrame, key: str, asked: str = "asked") -> DataFrame:
    """(request_id, key): the sources of each request (request_id, asked): those of its comma list that are known, all of them without a list (null)."""
    known = sources.select(F.col(key).cast("string").alias("_name"), key)
    named = requests.where(F.col(asked).isNotNull()).select("request_id", F.explode(F.array_distinct(F.split(asked, ","))).alias("_name")).join(known, "_name")
    every = requests.where(F.col(asked).isNull()).select("request_id").join(sources.select(key))
    return named.select("request_id", key).unionByName(every)


#: Characters of a preview's title, store and price text; rows of a search's and of a mission's preview.
TITLE_CUT, STORE_CUT, PRICE_CUT, SEARCH_ROWS, MISSION_ROWS = 300, 100, 40, 6, 5
NO_PRICE = "Price unavailable"


def previews(results: DataFrame, key: str, order: list[Column], mission: Column) -> DataFrame:
    """results (key, title, store, url, price, price_minor, currency, image_url) as previews: key, rank, title, store, url, price, image_url.

    Rows without a title, a store or a safe address go; the price is the row's own text, else its amount, else NO_PRICE; an
    unsafe image is left out; the first SEARCH_ROWS of a key stay, MISSION_ROWS where `mission` holds.
    """
    from . import lookup

    cut = lambda c, n: F.nullif(F.substring(F.trim(c), 1, n), F.lit(""))
    shown = results.withColumns({"title": cut("title", TITLE_CUT), "store": cut("store", STORE_CUT)}).where(F.col("title").isNotNull() & F.col("store").isNotNull() & text.safe_url(F.col("url")))
    made = F.when(F.col("price_minor").isNotNull() & F.col("currency").isNotNull(), lookup.amount(F.col("price_minor"), F.col("currency")))
    shown = shown.withColumns({"price": F.coalesce(cut("price", PRICE_CUT), made, F.lit(NO_PRICE)), "image_url": F.when(text.safe_url(F.col("image_url")), F.col("image_url"))})
    ranked = shown.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where(F.col("rank") <= F.when(mission, MISSION_ROWS).otherwise(SEARCH_ROWS)).select(key, "rank", "title", "store", "url", "price", "image_url")
