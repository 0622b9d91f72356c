"""Families of the panel's factors by their rank correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import factors as fz
from tessera.operators import clusters as cl
from tessera.operators import evaluation as ev
from tessera.operators.rolled import rolled, sorted_by
from tessera.operators.timeseries import forward_return
from tessera.plans.panel import price_panel
from tessera.plans.registry import query, rounded
from tessera.sources.scratch import stored

NAMES = [f"{n}_{k}" for n in ("mom", "ma_gap", "vol", "range") for k in (10, 20)]


def _factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(fz.with_factors(price_panel(spark, sf_dir), NAMES).select("code", "date", "close", *NAMES), "factors")


@query()
def ev_factor_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ward families of factors, with the member of the highest |information ratio| as representative."""
    rows = forward_return(sorted_by(price_panel(spark, sf_dir).select("code", "date", "high", "low", "close"), "code", "date"), 4).drop("known_on")
    columns = [*NAMES, "forward"]
    found = stored(ev.rank_correlations(rolled(rows, fz.rolled_windows(NAMES), keep=NAMES, into=ev.dealt([columns], "date", "date")), columns), "correlations")
    means = found.where("b <> 'forward'").groupBy("a", "b").agg(F.avg("rho").alias("rho"), F.count("*").alias("times")).where("times >= 5")
    scores = ev.ic_summary(found.where("b = 'forward' AND n >= 8").select(F.col("a").alias("factor"), F.col("rho").alias("ic")), by=("factor",)).select("factor", F.col("ir").alias("score"))
    return rounded(cl.representatives(cl.hierarchical(means, 0.8, NAMES), scores))


@query()
def ev_greedy_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.greedy(ev.factor_correlation(_factors(spark, sf_dir), NAMES, least=5), NAMES, 0.6)
