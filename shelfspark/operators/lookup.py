"""Cheaper offers for many product pages at once: cut-offs, the page's own host, alternatives, the cheapest and a headline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text
from . import gates

#: Least score of an alternative and of the cheapest offer, alternatives of a page, letters of a title that tell offers of a store apart.
ALTERNATIVE, CHEAPEST, MOST, LETTERS = 0.35, 0.5, 8, 40
#: Signs of currencies; amounts of others have the code behind them.
SIGNS = {"USD": "$", "EUR": "€", "GBP": "£"}
HEADLINES = ("No other stores found this", "Compared across stores — no clear cheaper option", "Save ", "From ", " at ")


def amount(minor: Column, currency: Column) -> Column:
    """An amount with its currency."""
    number, sign = F.format_number(minor / 100.0, 2), F.try_element_at(F.create_map(*(F.lit(x) for kv in SIGNS.items() for x in kv)), currency)
    return F.when(sign.isNotNull(), F.concat(sign, number)).otherwise(F.concat_ws(" ", F.replace(number, F.lit(",")), currency))


def elsewhere(url: Column, page_host: Column) -> Column:
    """Whether an offer isn't on the page's host or below it; unknown hosts are elsewhere."""
    own = text.host(url)
    return F.coalesce((own != page_host) & ~own.endswith(F.concat(F.lit("."), page_host)), F.lit(True))


def alternatives(pages: DataFrame, offers: DataFrame) -> DataFrame:
    """offers (page_id, id, title, price_minor, currency, store, url, score) that count for their page (page_id, host, ...), with rank and stores.

    Known prices, scores of at least ALTERNATIVE, other hosts; of each store one with the same beginning of the title; the best
    MOST of a page by bands of the score and price. stores: how many stores had an offer that counts.
    """
    kept = offers.where((F.col("score") >= ALTERNATIVE) & (F.col("price_minor") > 0)).join(pages.select("page_id", F.col("host").alias("_host")), "page_id").where(elsewhere(F.col("url"), F.col("_host"))).drop("_host")
    stores = kept.groupBy("page_id").agg(F.countDistinct("store").alias("stores"))
    order = F.struct((-F.floor(F.col("score") / 0.05)).alias("band"), "price_minor", "id")
    row = F.struct(*[c for c in kept.columns if c not in ("page_id", "store")])
    single = kept.groupBy("page_id", "store", F.lower(F.substring("title", 1, LETTERS)).alias("_title")).agg(F.min_by(row, order).alias("_row")).select("page_id", "store", "_row.*")
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(*gates.banded_order(F.col("score"), F.col("price_minor")), "id"))
    return single.withColumn("rank", rank).where(F.col("rank") <= MOST).join(stores, "page_id")


def lookup(pages: DataFrame, offers: DataFrame) -> DataFrame:
    """(page_id, alternatives, stores, cheapest_id, cheapest_minor, store, savings_minor, headline) of every page (page_id, host, price_minor, currency).

    The cheapest is taken from the alternatives of the page's currency, of all if it has none, with a score of at least CHEAPEST;
    savings are known for the same currency only.
    """
    found = alternatives(pages, offers).join(pages.select("page_id", F.col("currency").alias("_currency")), "page_id")
    same = F.col("currency") == F.col("_currency")
    sure = F.col("score") >= CHEAPEST
    pick = F.struct("price_minor", "rank", "id", "store", "currency")
    best = found.groupBy("page_id").agg(
        F.count("*").alias("alternatives"),
        F.first("stores").alias("stores"),
        F.max(same).alias("_same"),
        F.min(F.when(same & sure, pick)).alias("_mine"),
        F.min(F.when(sure, pick)).alias("_any"),
    )
    rows = pages.join(best, "page_id", "left").withColumn("c", F.when(F.col("_same"), F.col("_mine")).otherwise(F.col("_any")))
    cheaper = (F.col("c.currency") == F.col("currency")) & (F.col("c.price_minor") < F.col("price_minor"))
    rows = rows.withColumn("savings_minor", F.when(cheaper, F.col("price_minor") - F.col("c.price_minor")))
    none, unclear, save, start, at = HEADLINES
    headline = (
        F.when(F.col("c").isNull(), F.when(F.coalesce("stores", F.lit(0)) == 0, none).otherwise(unclear))
        .when(F.col("savings_minor") > 0, F.concat(F.lit(save), amount(F.col("savings_minor"), F.col("currency")), F.lit(at), F.col("c.store").cast("string")))
        .otherwise(F.concat(F.lit(start), amount(F.col("c.price_minor"), F.col("c.currency")), F.lit(at), F.col("c.store").cast("string")))
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.select("page_id", zero("alternatives"), zero("stores"), F.col("c.id").alias("cheapest_id"), F.col("c.price_minor").alias("cheapest_minor"), F.col("c.store").alias("store"), "savings_minor", headline.alias("headline"))
