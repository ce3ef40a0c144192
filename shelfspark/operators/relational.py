"""Joins, latest-state, deduplication, window and set operators over keyed tables. No operator holds a group in memory."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F


def dedupe_keep_best(df: DataFrame, keys: Sequence[str], quality: Column, position: str) -> DataFrame:
    """One row for each key: the best quality, the earliest among equals; `first_position` is where the key was first seen."""
    top = F.max_by(F.struct(*df.columns), F.struct(quality.alias("q"), (-F.col(position)).alias("p")))
    return df.groupBy(*keys).agg(top.alias("row"), F.min(position).alias("first_position")).select("row.*", "first_position")


def listing_dedupe_quality(price: Column, sponsored: Column, image: Column, details: Column) -> Column:
    """8 for a price, 4 for not being sponsored, 2 for an image, 1 for details."""
    one = lambda c: F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0)
    return one(price > 0) * 8 + (1 - one(sponsored)) * 4 + one(image) * 2 + one(details)


def upsert_latest(df: DataFrame, keys: Sequence[str], at: str, tie: str) -> DataFrame:
    """The last version of each key, with the time of its first: captured_at and last_seen_at."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(at, tie)).alias("row"), F.min(at).alias("captured_at"), F.max(at).alias("last_seen_at")).select("row.*", "captured_at", "last_seen_at")


def price_changes(df: DataFrame, key: str, price: str, at: str, tie: str) -> DataFrame:
    """Observations whose price is known and differs from the one before it in the same listing; the first counts."""
    before = F.lag(price).over(Window.partitionBy(key).orderBy(at, tie))
    return df.withColumn("before", before).where((F.col("before").isNull() | (F.col("before") != F.col(price))) & (F.col(price) > 0))


def latest_n(df: DataFrame, key: str, order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each key in an order, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)


def top_per_source(df: DataFrame, source: str, order: Sequence[Column], per_source: int, overall: int) -> DataFrame:
    """A balanced pool: the best rows with at most per_source of each source, then the best overall."""
    return latest_n(df, source, order, per_source).drop("rank").orderBy(*order).limit(overall)


def live_and_cached(live: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """All live rows, and the cached ones whose key isn't live."""
    return live.withColumn("origin", F.lit("live")).unionByName(cached.join(live.select(key), key, "left_anti").withColumn("origin", F.lit("cache")))


def first_seen(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key in an order."""
    return df.groupBy(key).agg(F.min_by(F.struct(*(c for c in df.columns if c != key)), F.struct(*order)).alias("row")).select(key, "row.*")


def round_robin(df: DataFrame, slot: str, position: str, key: str, limit: int) -> DataFrame:
    """Position one of each slot, then position two and so on, without repeated keys, up to a limit."""
    kept = first_seen(df, key, [position, slot])
    return kept.orderBy(position, slot).limit(limit)


def cheapest_per_source(df: DataFrame, group: Sequence[str], price: str, tie: str) -> DataFrame:
    """The cheapest row of each group; unknown prices (0 or less) come last."""
    known = F.when(F.col(price) > 0, F.col(price)).otherwise(F.lit((1 << 63) - 1))
    return df.groupBy(*group).agg(F.min_by(F.struct(*(c for c in df.columns if c not in group)), F.struct(known.alias("k"), tie)).alias("row")).select(*group, "row.*")


def hourly_min(df: DataFrame, at: str, price: str, *keys: str) -> DataFrame:
    """Smallest known price of each hour."""
    return df.where(F.col(price) > 0).groupBy(*keys, F.date_trunc("HOUR", at).alias("hour")).agg(F.min(price).alias("low"))


def landed(price: Column, shipping: Column) -> Column:
    """Price with shipping; an unknown price is the largest number."""
    return F.when(price > 0, price + F.greatest(F.coalesce(shipping, F.lit(0)), F.lit(0))).otherwise(F.lit((1 << 63) - 1))


def failure_streaks(df: DataFrame, key: str, at: str, tie: str, ok: Column, opens_at: int = 3, minutes: int = 5) -> DataFrame:
    """Consecutive failures up to each attempt, and when the breaker that they open closes (null while it is closed)."""
    w = Window.partitionBy(key).orderBy(at, tie)
    marked = df.withColumn("ok", ok).withColumn("island", F.sum(ok.cast("int")).over(w))
    run = F.sum((~F.col("ok")).cast("int")).over(Window.partitionBy(key, "island").orderBy(at, tie))
    return marked.withColumn("run", run).withColumn("open_until", F.when(F.col("run") >= opens_at, F.col(at) + F.expr(f"INTERVAL {minutes} MINUTES"))).drop("island")


def ewma(df: DataFrame, key: str, order: Sequence[str], value: str, keep: float = 0.8, new: float = 0.2) -> DataFrame:
    """(key, ewma, attempts): exponentially weighted mean of each key's values in order, rounded to a whole number at each step.

    A row without a finite value leaves the mean as it is and counts as an attempt; rows alike in the order go by value. The rounding makes the steps depend on each other, so a key's rows are read one after the other from a sorted
    partition; only the running mean is held, whatever the length of a key's history.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mean, n = None, None, 0
        row = lambda done: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=[key, "ewma", "attempts"])
        types = None
        for batch in batches:
            types, out = [batch.schema.field(0).type, pa.int64(), pa.int64()], []
            for k, v in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                if n and k != now:
                    out.append((now, mean, n))
                    mean, n = None, 0
                if v is not None:
                    mean = math.floor((v if mean is None else keep * mean + new * v) + 0.5)
                now, n = k, n + 1
            if out:
                yield row(out)
        if n:
            yield row([(now, mean, n)])

    v = F.col(value).cast("double")
    finite = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    rows = df.select(key, *order, finite.alias("v"))
    places = [F.asc_nulls_last(c) for c in (*order, "v")]
    sorted_rows = rows.repartition(key).sortWithinPartitions(key, *places)
    return sorted_rows.select(key, "v").mapInArrow(fold, f"`{key}` {dict(df.dtypes)[key]}, ewma long, attempts long")


def wishlist_changes(saved: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Saved rows, with the wanted ones that weren't saved before."""
    return saved.select(key).unionByName(wanted.select(key).distinct().join(saved, key, "left_anti").select(key))


def orphans(parents: DataFrame, children: DataFrame, key: str, child_key: str) -> DataFrame:
    """Parents without any child."""
    return parents.join(children.select(F.col(child_key).alias(key)), key, "left_anti")


def with_children(parents: DataFrame, children: DataFrame, key: str, child_key: str) -> DataFrame:
    """Parents with at least one child."""
    return parents.join(children.select(F.col(child_key).alias(key)), key, "left_semi")


#: Largest alert of a saved product, in minor units.
MOST_ALERT = 100_000_000
#: Source types that a user may remove.
REMOVABLE = ("shopify", "woocommerce", "generic-html")


def wishlist(saved: DataFrame, actions: DataFrame, products: DataFrame) -> DataFrame:
    """(product_id, alert) after actions (product_id, at, action, alert): save, unsave and alert, in the order of `at`.

    Saving counts for known products and what isn't saved yet; an alert is a whole number in range or null, of a saved
    product. What an action leaves depends on those before it only through the last save or unsave, so two aggregates
    decide: whether the last of these was a save, and the last alert since the product has been saved.
    """
    good = (F.col("action") != "alert") | F.col("alert").isNull() | F.col("alert").between(0, MOST_ALERT)
    known = actions.join(products.select("product_id").distinct(), "product_id", "left_semi").where(good)
    first = saved.select("product_id", F.lit(None).cast("long").alias("at"), F.lit("saved").alias("action"), "alert")
    rows = first.unionByName(known.select("product_id", F.col("at").cast("long").alias("at"), "action", F.col("alert").cast(dict(saved.dtypes)["alert"]).alias("alert")))
    order = Window.partitionBy("product_id").orderBy(F.asc_nulls_first("at"))
    switched = F.last(F.when(F.col("action").isin("save", "saved", "unsave"), F.col("action") != "unsave"), ignorenulls=True).over(order)
    before = F.coalesce(F.lag("on").over(order), F.lit(False))
    marked = rows.withColumn("on", F.coalesce(switched, F.lit(False))).withColumn("begins", (F.col("action").isin("save", "saved") & ~before).cast("int"))
    spell = marked.withColumn("spell", F.sum("begins").over(order))
    last = spell.groupBy("product_id").agg(F.max_by("on", F.struct(F.coalesce("at", F.lit(-1)))).alias("on"), F.max("spell").alias("spell")).where("on")
    alerts = spell.where(F.col("action").isin("alert", "saved") & F.col("on")).groupBy("product_id", "spell").agg(F.max_by(F.struct("alert"), F.coalesce("at", F.lit(-1))).alias("a"))
    return last.join(alerts, ["product_id", "spell"], "left").select("product_id", F.col("a.alert").alias("alert"))


def source_status(attempts: DataFrame, source: str, at: str, tie: str) -> DataFrame:
    """(source, last_fetched_at, last_error): the newest attempt of each source; its error, cut at 500 characters, or null if it worked."""
    last = F.max_by(F.struct(at, "ok", "error"), F.struct(at, tie))
    return attempts.groupBy(source).agg(last.alias("r")).select(source, F.col(f"r.{at}").alias("last_fetched_at"), F.when(~F.col("r.ok"), F.substring("r.error", 1, 500)).alias("last_error"))


def removed(sources: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """Sources after removals were asked for: only those of removable types go."""
    gone = sources.where(F.col("type").isin(*REMOVABLE)).join(asked.select(key), key, "left_semi").select(key)
    return sources.join(gone, key, "left_anti")


def registry(sources: DataFrame) -> DataFrame:
    """Sources that are enabled and whose row is valid, by type and label."""
    valid = F.col("enabled") & (F.trim("label") != "") & F.col("type").isNotNull()
    return sources.where(F.coalesce(valid, F.lit(False))).orderBy("type", "label")


def recent(rows: DataFrame, now, seconds: int, at: str, tie: str, most: int) -> DataFrame:
    """The newest rows seen within some seconds, as many as `most`."""
    return rows.where(F.unix_seconds(F.col(at)) >= F.unix_seconds(now) - seconds).orderBy(F.desc(at), tie).limit(most)


def health_dots(attempts: DataFrame, source: str, at: str, tie: str, newest: int = 1000, each: int = 14) -> DataFrame:
    """(source, place, ok): of the newest attempts overall, each source's last ones, the oldest of them first."""
    top = attempts.orderBy(F.desc(at), F.desc(tie)).limit(newest)
    shown = latest_n(top, source, [F.desc(at), F.desc(tie)], each)
    return shown.withColumn("place", F.row_number().over(Window.partitionBy(source).orderBy(F.desc("rank")))).select(source, F.col("place").cast("long").alias("place"), "ok")


def price_ranges(offers: DataFrame, product: str) -> DataFrame:
    """(product, currency, low, high) of the priced offers."""
    return offers.where("price_minor > 0").groupBy(product, "currency").agg(F.min("price_minor").alias("low"), F.max("price_minor").alias("high"))


def nested_products(products: DataFrame, listings: DataFrame, prices: DataFrame, newest: int = 200, each: int = 30) -> DataFrame:
    """(product_id, offers): the products seen last, each with its offers by price and their last prices, newest first.

    products: product_id, seen; listings: listing_id, product_id, price_minor; prices: listing_id, at, price. Only what
    belongs to the products shown is joined; a listing holds `each` prices at most.
    """
    shown = products.orderBy(F.desc("seen"), "product_id").limit(newest).select("product_id")
    own = listings.join(F.broadcast(shown), "product_id")
    last = latest_n(prices.join(own.select("listing_id"), "listing_id", "left_semi"), "listing_id", [F.desc("at"), F.desc("price")], each)
    history = last.groupBy("listing_id").agg(F.array_sort(F.collect_list(F.struct("rank", "price"))).alias("h")).select("listing_id", F.transform("h", lambda x: x["price"]).alias("prices"))
    rows = own.join(history, "listing_id", "left").withColumn("prices", F.coalesce("prices", F.expr("filter(array(price_minor), x -> false)")))
    return rows.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("price_minor", "listing_id", "prices"))).alias("offers"))


def compared(products: DataFrame, listings: DataFrame, query_tokens, newest: int = 30, most: int = 8, stores: int = 5) -> DataFrame:
    """(product_id, sources, stores): of the newest products those with two sources or more whose titles hold a query's word, with a few stores.

    products: product_id, seen, title; listings: product_id, source, title, price_minor.
    """
    from ..functions import text

    top = products.orderBy(F.desc("seen"), "product_id").limit(newest)
    own = listings.join(F.broadcast(top.select("product_id", F.col("title").alias("product_title"), "seen")), "product_id")
    words = F.concat_ws(" ", F.lower("title"), F.lower("product_title"))
    hit = F.exists(query_tokens, lambda t: text.token_in_title(t, words))
    per = own.groupBy("product_id", "seen", "source").agg(F.min("price_minor").alias("price"), F.max(hit).alias("hit"))
    rows = per.groupBy("product_id", "seen").agg(F.count("*").alias("sources"), F.max("hit").alias("hit"), F.array_sort(F.collect_list(F.struct("price", "source"))).alias("s"))
    found = rows.where("sources >= 2 and hit").orderBy(F.desc("seen"), "product_id").limit(most)
    return found.select("product_id", "sources", F.slice(F.transform("s", lambda x: x["source"]), 1, stores).alias("stores"))


def bounded_json(value: Column, most: int = 20_000) -> Column:
    """A JSON text cut at a length, as telemetry keeps it."""
    return F.substring(value, 1, most)


def known_run(feedback: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """Feedback with the run it names, null where there is no such run."""
    there = runs.select(F.col(key).alias("_run")).distinct()
    return feedback.join(there, F.col(key) == F.col("_run"), "left").withColumn(key, F.col("_run")).drop("_run")


def safe_spec(spec: DataFrame) -> DataFrame:
    """What a parsed query (parse_queries) may leave in telemetry: kinds, whether something is set and how many, no values."""
    given = lambda c: F.col(c).isNotNull()
    return spec.select(
        "query_id",
        "kind",
        "product_type",
        given("brand").alias("has_brand"),
        given("model").alias("has_model"),
        F.size("must").alias("must_count"),
        F.size("must_not").alias("exclusion_count"),
        F.size("compatible").alias("compatibility_count"),
        "condition",
        given("min_price").alias("has_min_price"),
        given("max_price").alias("has_max_price"),
        F.col("spec_confidence").alias("confidence"),
    )


def gathered(rows: DataFrame, topic: str, source: str, order: Sequence[Column], per_source: int = 10, overall: int = 24) -> DataFrame:
    """The first rows of each topic: at most per_source of a source, then overall, in the same order. Failed rows (ok false) don't count."""
    kept = rows.where(F.coalesce("ok", F.lit(True))) if "ok" in rows.columns else rows
    near = kept.withColumn("_p", F.row_number().over(Window.partitionBy(topic, source).orderBy(*order))).where(F.col("_p") <= per_source).drop("_p")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy(topic).orderBy(*order))).where(F.col("rank") <= overall)
