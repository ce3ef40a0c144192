"""Missions as slots: lists of products, and plans by templates where no planner answers; for many missions in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import lexicon as lx, text
from ..functions.lists import listed_products

MOST_SLOTS, MOST_SUMMARY, MOST_GOAL = 5, 120, 70


def composition(mission: Column, products: Column) -> Column:
    """bundle for things to buy together, alternatives for things to choose from."""
    choices = F.forall(products, lambda p: p.isin(*lx.CONSOLE_ALTERNATIVES))
    return F.when(F.size(products) >= 2, F.when(choices, "alternatives").otherwise("bundle")).when(mission.rlike(lx.BUNDLE_WORDS), "bundle").otherwise("alternatives")


def _slot(query: Column | str, reason: str) -> Column:
    return F.struct((F.lit(query) if isinstance(query, str) else query).alias("query"), F.lit(reason).alias("reason"))


def _templates(low: Column, kind: Column) -> list[tuple[Column, Column]]:
    """(condition, slots) of the templates in order."""
    out = []
    for pattern, narrower, slots, others in lx.MISSION_TEMPLATES:
        rows = lambda some: F.array(*(_slot(q, r) for q, r in some))
        made = rows(slots)
        if others:
            made = F.when(kind == "bundle" if narrower == "bundle" else low.rlike(narrower), made).otherwise(rows(others))
        out.append((low.rlike(pattern), made))
    return out


def planned(missions: DataFrame, mission: str = "mission") -> DataFrame:
    """missions with summary, composition and slots (query, reason): of a list its products, else of a template, else of the goal itself.

    The deterministic plan of a mission; a hosted planner's answer would take its place.
    """
    whole = F.substring(F.trim(F.col(mission)), 1, 500)
    rows = missions.withColumn("_text", whole).withColumn("_low", F.lower("_text")).withColumn("_products", listed_products(F.col("_text")))
    rows = rows.withColumn("composition", composition(F.col("_text"), F.col("_products")))
    kind, products, low = F.col("composition"), F.col("_products"), F.col("_low")
    desk = F.array_contains(products, "monitor") & F.array_contains(products, "chair")
    own = lambda p: F.when(desk & (p == "chair"), "ergonomic office chair").when(desk & (p == "backpack"), "laptop backpack").otherwise(p)
    reason = F.when(kind == "alternatives", lx.LIST_REASONS[0]).otherwise(lx.LIST_REASONS[1])
    listed = F.transform(F.slice(products, 1, MOST_SLOTS), lambda p: F.struct(own(p).alias("query"), reason.alias("reason")))
    goal = F.substring(text.collapse(F.regexp_replace("_text", rf"(?i)\b(?:{lx.GOAL_BOUNDS})\s*\$\s*\d+(?:\.\d{{1,2}})?", "")), 1, MOST_GOAL)
    of_goal = lambda some: F.array(*(_slot(F.concat(F.lit(a), goal, F.lit(b)), r) for a, b, r in some))
    slots = F.when(F.size(products) >= 2, listed)
    for met, made in _templates(low, kind):
        slots = slots.when(met, made)
    slots = slots.otherwise(F.when(kind == "bundle", of_goal(lx.GOAL_BUNDLE)).otherwise(of_goal(lx.GOAL_CHOICES)))
    return rows.withColumn("slots", slots).withColumn("summary", F.substring("_text", 1, MOST_SUMMARY)).drop("_text", "_low", "_products")


def slots(plans: DataFrame, id_col: str) -> DataFrame:
    """(id, composition, slot, query, reason), a row for each slot of planned()."""
    return plans.select(id_col, "composition", F.posexplode("slots").alias("slot", "s")).select(id_col, "composition", "slot", "s.query", "s.reason")
