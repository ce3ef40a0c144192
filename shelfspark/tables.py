"""Access to the driver's tables, and the listing view of them that the search operators work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .session import dealt, ship, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name == "documents" else dealt(rows) if name == "part" else rows


def minor(amount: Column | str) -> Column:
    """Money as integer minor units; halves round up."""
    c = F.col(amount) if isinstance(amount, str) else amount
    return F.floor(c.cast("double") * 100 + 0.5).cast("long")


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as listings: a supplier is a source, a part is a product, the unit price is the listing's price."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("external_id"),
        F.col("l_suppkey").alias("source_id"),
        F.col("l_partkey").alias("product_id"),
        minor(F.col("l_extendedprice") / F.col("l_quantity")).alias("price_minor"),
        minor(F.col("l_extendedprice") * F.col("l_tax") / F.col("l_quantity")).alias("shipping_minor"),
        "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate",
    )


#: The same view in DuckDB SQL, for the oracles.
OFFERS_SQL = """(SELECT l_orderkey || '-' || l_linenumber AS external_id, l_suppkey AS source_id, l_partkey AS product_id,
  CAST(floor(l_extendedprice / l_quantity * 100 + 0.5) AS BIGINT) AS price_minor,
  CAST(floor(l_extendedprice * l_tax / l_quantity * 100 + 0.5) AS BIGINT) AS shipping_minor,
  l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_shipdate FROM lineitem)"""
