"""Clusters and components of the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import learning as le
from tessera.plans.panel import table
from tessera.plans.registry import query


@query()
def ml_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's cluster of 8 and its squared distance."""
    rows, _, _ = le.kmeans(table(spark, sf_dir, "embeddings"), 8)
    return rows.select("vec_id", "cluster", F.round("distance", 6).alias("distance"))


@query()
def ml_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's scores on the first three principal axes."""
    rows, _, _ = le.principal_components(table(spark, sf_dir, "embeddings"), 3)
    return rows.select("vec_id", *(F.round(F.col("components")[k], 5).alias(f"c{k + 1}") for k in range(3)))
