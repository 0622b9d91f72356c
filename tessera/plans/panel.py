"""The driver tables in the roles that panel operators need.

``price_panel``: one row per code and week with open, high, low, close, volume, amount and an industry, from
shipments of suppliers. ``user_days``: events of users by day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def price_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    place = F.struct("l_shipdate", "l_orderkey", "l_partkey", "l_linenumber", price.alias("p"))
    bars = line.groupBy(F.col("l_suppkey").alias("code"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("date")).agg(
        F.min_by(price, place).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, place).alias("close"),
        F.sum(F.col("l_quantity").cast("bigint")).cast("double").alias("volume"),
        (F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")) / F.lit(100.0)).cast("double").alias("amount"),
    )
    industry = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_nationkey").alias("industry"))
    return bars.join(industry, "code", "left")


#: The same panel as common table expression for oracles.
PANEL = """panel AS (
  SELECT b.*, s.s_nationkey AS industry FROM (
    SELECT l_suppkey AS code, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
           arg_min(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_partkey, l_linenumber, l_extendedprice / l_quantity)) AS open,
           max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
           arg_max(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_partkey, l_linenumber, l_extendedprice / l_quantity)) AS close,
           sum(l_quantity::BIGINT)::DOUBLE AS volume,
           (sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE / 100.0)::DOUBLE AS amount
    FROM lineitem GROUP BY 1, 2) b
  LEFT JOIN supplier s ON s.s_suppkey = b.code)"""
