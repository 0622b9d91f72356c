"""Optimal weights of industries, with regions as sectors: a problem every quarter over the year before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.expr import ordered, pct_change
from tessera.operators import optimize as op
from tessera.plans.panel import price_panel, table
from tessera.plans.registry import query


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = price_panel(spark, sf_dir).select("code", "date", "close", "industry").withColumn("ret", pct_change("close", ordered("code", "date")))
    assets = rows.where("ret IS NOT NULL").groupBy(F.col("industry").alias("asset"), "date").agg(F.avg("ret").alias("ret"))
    sectors = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("asset"), F.col("n_regionkey").alias("sector"))
    return op.windows(assets.join(sectors, "asset", "left"), 52, 13)


@query()
def po_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least variance, highest Sharpe ratio, equal risk, least shortfall and posterior weights, side by side."""
    rows = op.weights(_windows(spark, sf_dir))
    return rows.select("problem", "method", "asset", F.round("weight", 6).alias("weight"), (F.col("error") < 1e-8).alias("optimal"))
