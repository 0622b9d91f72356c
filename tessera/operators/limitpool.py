"""Bars that close at, touch or fall to their daily price limit, and streaks of locked ones."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.expr import ordered
from tessera.operators.recursion import Recursion, Rows, scan
from tessera.operators.rolled import rolled


def _streaks(earlier: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Elements: rows that lead and that trail locked, whether all are, whether any is, whether the last streak is the
    leading one, and the streak's length at the end."""
    (lead1, trail1, all1, any1, only1, at1), (lead2, trail2, all2, any2, only2, at2) = earlier.T, later.T
    goes_on = (any2 > 0) & (only2 > 0) & (lead2 > 0)
    return np.stack([
        lead1 + np.where(all1 > 0, lead2, 0), np.where(all2 > 0, trail1 + trail2, trail2), all1 * all2, np.maximum(any1, any2),
        np.where(any2 > 0, goes_on * all1, only1), np.where(any2 == 0, at1, np.where(goes_on, trail1 + lead2, at2)),
    ], 1)


def locked_streak(flag: str, name: str = "streak") -> Recursion:
    """Consecutive rows with the flag (1), this one included; a row without it carries the length of the last streak."""

    def elements(rows: Rows) -> np.ndarray:
        return np.repeat((rows[flag] == 1)[:, None].astype(float), 6, 1)

    return Recursion((flag,), (name,), 6, elements, _streaks, lambda e: (e[:, 5],))


def limit_pool(df: DataFrame, ratio: Column | float = 0.1, slack: float = 1e-6, percent_slack: float = 0.3, touch: float = 2.0, key: str = "code", time: str = "date", parts: int | None = None) -> DataFrame:
    """Every bar with ``pct`` (change in percent, 0 for a first one), ``locked_up``, ``broken`` (touched the upper limit
    but didn't close there, up by almost as much), ``locked_down``, ``streak`` and ``next_pct``. A limit is the close before
    times 1 +- ``ratio``, to two digits (ties to even)."""
    r = ratio if isinstance(ratio, Column) else F.lit(ratio)
    w = ordered(key, time)
    before = F.lag("close").over(w)
    rows = df.withColumn("__ratio", r.cast("double")).withColumn("__up", F.rint(before * (1 + F.col("__ratio")) * 100) / 100).withColumn("__down", F.rint(before * (1 - F.col("__ratio")) * 100) / 100)
    rows = rows.withColumn("pct", F.coalesce((F.try_divide(F.col("close"), before) - 1) * 100, F.lit(0.0)))
    yes = lambda c: F.coalesce(c, F.lit(False))
    near = F.col("__ratio") * 100
    rows = rows.withColumn("locked_up", yes((F.col("close") >= F.col("__up") - slack) & (F.col("pct") >= near - percent_slack)))
    rows = rows.withColumn("locked_down", yes((F.col("close") <= F.col("__down") + slack) & (F.col("pct") <= percent_slack - near)))
    rows = rows.withColumn("broken", ~F.col("locked_up") & yes((F.col("high") >= F.col("__up") - slack) & (F.col("pct") >= near - touch)))
    rows = rows.withColumn("next_pct", F.lead("pct").over(w)).withColumn("__flag", F.col("locked_up").cast("int")).drop("__ratio", "__up", "__down")
    if parts:
        rows = scan(rows, [locked_streak("__flag")], key, time, parts=parts)
    else:  # the windows above have dealt the rows by key and sorted them
        rows = rolled(rows, {"__run": ("streak", "__flag", 1), "streak": ("held", "__run", 1)}, key).drop("__run")
    return rows.withColumn("streak", F.col("streak").cast("bigint")).drop("__flag")


def pool(df: DataFrame, **options) -> DataFrame:
    """The bars of ``limit_pool`` that are locked or broken."""
    return limit_pool(df, **options).where("locked_up OR locked_down OR broken")


def pool_counts(members: DataFrame, time: str = "date") -> DataFrame:
    """Per time: bars locked up and down and broken, the longest streak, the share of touches that broke, and locked bars
    by streak (1, 2, 3, 4 and more)."""
    up = F.col("locked_up")
    bins = [F.count_if(up & ((F.col("streak") == k) if k < 4 else (F.col("streak") >= 4))).alias(f"streak_{k}") for k in (1, 2, 3, 4)]
    out = members.groupBy(time).agg(F.count_if(up).alias("up"), F.count_if("locked_down").alias("down"), F.count_if("broken").alias("broken"), F.max(F.when(up, F.col("streak"))).alias("longest"), *bins)
    return out.withColumn("broken_share", F.try_divide(F.col("broken"), F.col("up") + F.col("broken")))
