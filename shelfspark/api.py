"""The tools of the engine as functions: product search, cheaper offers, missions, sources. Inputs are validated; results are DataFrames."""

from __future__ import annotations

import hashlib
import hmac
import os
import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import text
from .operators import bundles, gates
from .plans import search as plan

TOOLS = ("search_products", "find_cheaper", "run_shopping_mission", "list_sources")
MOST_QUERY, MOST_RESULTS, DEFAULT_RESULTS = 500, 10, 6


def flag(name: str, default: bool = False) -> bool:
    """An environment switch: 1, true, yes and on are true."""
    value = os.environ.get(name)
    return default if value is None else value.strip().lower() in ("1", "true", "yes", "on")


def bounded_millis(value: str | None, default: int, low: int, high: int) -> int:
    """A whole number of milliseconds in a range, else the default."""
    return int(value) if value and re.fullmatch(r"\d+", value.strip()) and low <= int(value) <= high else default


def keyed_query_hash(query: str, key: bytes) -> str:
    """Hash of a query that only the key's holder can repeat."""
    return hmac.new(key, " ".join(query.lower().split()).encode(), hashlib.sha256).hexdigest()


def tool_arguments(tool: str, arguments: dict) -> dict | None:
    """Arguments of a routed call, trimmed and clamped; None for an unknown tool or an empty query."""
    if tool not in TOOLS:
        return None
    query = str(arguments.get("query") or "").strip()[:MOST_QUERY]
    if tool != "list_sources" and not query:
        return None
    try:
        results = int(arguments.get("max_results", DEFAULT_RESULTS))
    except (TypeError, ValueError):
        results = DEFAULT_RESULTS
    return {"query": query, "max_results": min(MOST_RESULTS, max(1, results))}


def routed(message: str) -> tuple[str, dict] | None:
    """The tool that a message asks for by fixed rules: sources, cheaper offers, missions, else a product search."""
    m = message.strip()
    tool = "list_sources" if re.search(r"(?i)\b(?:which|what|list).*\b(?:sources|stores|shops)\b", m) else "find_cheaper" if re.search(r"(?i)\b(?:cheaper|better price|lower price)\b", m) else "run_shopping_mission" if re.search(
        r"(?i)\b(?:furnish|equip|outfit|setup|starter kit|everything (?:i|we) need)\b",
        m,
    ) else "search_products"
    arguments = tool_arguments(tool, {"query": m})
    return (tool, arguments) if arguments else None


def canaries(labels: list[str]) -> list[str]:
    """Probe queries of a source: the first word of three letters or more of its name, then generic terms, each once."""
    own = [w.lower() for label in labels for w in re.findall(r"[A-Za-z]{3,}", label)[:1]]
    return list(dict.fromkeys([*own, "shoes", "shirt", "bag", "chair", "lamp"]))


def queries_frame(spark: SparkSession, queries: list[str]) -> DataFrame:
    rows = [(i, q.strip()[:MOST_QUERY]) for i, q in enumerate(queries) if q.strip()]
    return spark.createDataFrame(rows, "query_id long, query string").withColumn("query_embedding", F.lit(None).cast("array<double>"))


def search_products(listings: DataFrame, queries: list[str], max_results: int = DEFAULT_RESULTS) -> DataFrame:
    """Results of each query with the listing's title and price."""
    found = plan.search(listings, queries_frame(listings.sparkSession, queries), results=max(1, max_results))
    return found.join(listings.select("id", "title", "price_minor", "source"), "id").select("query_id", "position", "id", "title", text.format_price(F.col("price_minor")).alias("price"), "source", "final")


def find_cheaper(listings: DataFrame, title: str, price_minor: int, source: str | None = None) -> DataFrame:
    """Offers of shops for a page's product that cost less, in bands of relevance and by price; the page's own shop is left out."""
    spark = listings.sparkSession
    clean = spark.range(1).select(text.clean_title(F.lit(title)).alias("t")).first().t
    shops = listings.where(~F.col("source").isin(*gates.NO_SHOPS) & (F.col("price_minor") > 0) & (F.col("price_minor") < price_minor))
    if source:
        shops = shops.where(F.col("source") != source)
    found = plan.search(shops, queries_frame(spark, [clean]), results=16).where("base >= 0.35")
    return found.join(shops.select("id", "title", "price_minor", "source"), "id").withColumn("savings", F.lit(price_minor) - F.col("price_minor")).orderBy(*gates.banded_order(F.col("base"), F.col("price_minor")), "id").limit(8)


def run_shopping_mission(listings: DataFrame, slots: list[str], budget_minor: int | None = None) -> DataFrame:
    """Balanced, value and premium bundles of one listing for each slot within a budget."""
    spark = listings.sparkSession
    priced = listings.where("price_minor > 0")
    found = plan.search(priced, queries_frame(spark, slots), results=12)
    rows = found.join(priced.select("id", "title", "price_minor"), "id").select(
        F.lit("mission").alias("mission_id"),
        F.col("query_id").cast("int").alias("slot"),
        "id",
        text.title_key(F.col("title")).alias("title_key"),
        "price_minor",
        F.lit("USD").alias("currency"),
        F.col("final").alias("score"),
        F.col("position").cast("int").alias("rank"),
    )
    return bundles.choices(bundles.combinations(rows, len(slots), budget_max=budget_minor), budget_minor)


def list_sources(sources: DataFrame) -> DataFrame:
    """Sources, enabled ones first, by label."""
    return sources.orderBy(F.desc("enabled"), "label")


__all__ = [*TOOLS, "routed", "tool_arguments", "canaries", "flag", "bounded_millis", "keyed_query_hash"]
