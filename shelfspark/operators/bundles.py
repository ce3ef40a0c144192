"""Bundles of one item per slot within a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Candidates of a slot that enter combinations: bounds them to PER_SLOT ** slots for each mission.
PER_SLOT = 8


def combinations(candidates: DataFrame, slots: int, budget_max: int | None = None, budget_min: int | None = None, per_slot: int = PER_SLOT) -> DataFrame:
    """(mission_id, ids, titles, total, relevance) over candidates (mission_id, slot 0..slots-1, id, title_key, price_minor, currency, score, rank).

    One row for each choice of one of the first candidates of every slot with different ids and titles, one currency and
    a total within the budget. Slots join one by one on mission and currency, and totals over the budget end at once.
    """
    head = candidates.where((F.col("price_minor") > 0) & (F.col("rank") <= per_slot))
    of = lambda k: head.where(F.col("slot") == k).select("mission_id", "currency", F.col("id").alias("i"), F.col("title_key").alias("t"), F.col("price_minor").alias("p"), F.col("score").alias("s"), F.col("rank").alias("r"))
    out = of(0).select("mission_id", "currency", F.array("i").alias("ids"), F.array("t").alias("titles"), F.col("p").alias("total"), F.col("s").alias("score"), F.array("r").alias("ranks"))
    if budget_max is not None:
        out = out.where(F.col("total") <= budget_max)
    for k in range(1, slots):
        out = out.join(of(k), ["mission_id", "currency"]).where(~F.array_contains("ids", F.col("i")) & ~F.array_contains("titles", F.col("t")))
        out = out.select(
            "mission_id",
            "currency",
            F.concat("ids", F.array("i")).alias("ids"),
            F.concat("titles", F.array("t")).alias("titles"),
            (F.col("total") + F.col("p")).alias("total"),
            (F.col("score") + F.col("s")).alias("score"),
            F.concat("ranks", F.array("r")).alias("ranks"),
        )
        if budget_max is not None:
            out = out.where(F.col("total") <= budget_max)
    if budget_min is not None:
        out = out.where(F.col("total") >= budget_min)
    return out.withColumn("relevance", F.col("score") / slots).drop("score")


def choices(combos: DataFrame, budget_max: int | None = None) -> DataFrame:
    """(mission_id, choice, ids, total, relevance): balanced, value and premium bundles of each mission, repeats dropped."""
    use = F.least(F.lit(1.0), F.col("total") / budget_max) if budget_max else F.lit(0.0)
    balance = F.round(0.75 * F.col("relevance") + 0.25 * use, 9)
    relevance = F.round("relevance", 9)
    orders = {"balanced": [balance.desc(), F.asc("ranks")], "value": [F.asc("total"), relevance.desc(), F.asc("ranks")], "premium": [F.desc("total"), relevance.desc(), F.asc("ranks")]}
    picked = None
    for k, (name, order) in enumerate(orders.items()):
        one = combos.withColumn("r", F.row_number().over(Window.partitionBy("mission_id").orderBy(*order))).where("r = 1").select("mission_id", F.lit(k).alias("k"), F.lit(name).alias("choice"), "ids", "total", "relevance")
        picked = one if picked is None else picked.unionByName(one)
    return picked.groupBy("mission_id", "ids").agg(F.min_by(F.struct("choice", "total", "relevance"), "k").alias("x")).select("mission_id", "x.choice", "ids", "x.total", "x.relevance")


def enforce_bounds(plan: DataFrame) -> DataFrame:
    """Slots with their effective maximum: a budget over alternatives bounds each, over a bundle only its total."""
    alternatives = F.col("composition") == "alternatives"
    return plan.withColumn("slot_max", F.when(alternatives, F.least("query_max", "budget_max")).otherwise(F.col("query_max"))).withColumn("total_max", F.when(~alternatives, F.col("budget_max")))


def slot_candidates(found: DataFrame, slots: DataFrame, order: list[Column], most: int = 8) -> DataFrame:
    """The first `most` offers of each slot: found (mission_id, slot, price_minor, currency, ...) with known prices, in dollars where the slot has a bound.

    slots: mission_id, slot, min_price, max_price (minor units, null without a bound). An offer without a currency is in dollars.
    """
    bound = F.col("min_price").isNotNull() | F.col("max_price").isNotNull()
    kept = found.join(slots.select("mission_id", "slot", bound.alias("_bound")), ["mission_id", "slot"]).where((F.col("price_minor") > 0) & (~F.col("_bound") | F.coalesce(F.col("currency") == "USD", F.lit(False)))).drop("_bound")
    place = F.row_number().over(Window.partitionBy("mission_id", "slot").orderBy(*order))
    return kept.withColumn("rank", place).where(F.col("rank") <= most).withColumn("currency", F.coalesce("currency", F.lit("USD")))
