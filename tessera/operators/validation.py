"""Labels and out-of-sample evidence: barriers, combinatorial folds and their paths, walk-forward choice of parameters, and
Sharpe ratios that pay for the number of trials."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from functools import reduce
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tessera.functions.expr import ordered, safe_div

EULER = 0.5772156649015329


def three_classes(df: DataFrame, h: int, up: float, down: float, value: str = "close", key: str = "code", time: str = "date") -> DataFrame:
    """``label``: 2 if the return over the next h rows, in percent, is above ``up``, 0 if below ``down``, else 1; missing at the end."""
    ahead = (safe_div(F.lead(value, h).over(ordered(key, time)), value) - 1) * 100
    return df.withColumn("label", F.when(ahead > up, 2).when(ahead < down, 0).when(ahead.isNotNull(), 1))


def first_touch(df: DataFrame, up: float, down: float, h: int, key: str = "code", time: str = "date") -> DataFrame:
    """The barrier that the next h bars reach first from the close: ``barrier`` 1 (high at close times 1 + up), -1 (low at close
    times 1 - down; also where one bar reaches both) or 0 (neither within h bars), after ``held`` bars; missing where
    fewer than h bars follow and neither was reached."""
    ahead = ordered(key, time).rowsBetween(1, h)
    bars = F.collect_list(F.struct("high", "low")).over(ahead)
    hits = F.transform(bars, lambda b, k: F.struct((k + 1).alias("held"), F.when(b["low"] <= F.col("close") * (1 - down), -1).when(b["high"] >= F.col("close") * (1 + up), 1).otherwise(0).alias("side")))
    first = F.try_element_at(F.filter(hits, lambda b: b["side"] != 0), F.lit(1))
    full = F.size(bars) >= h
    rows = df.withColumn("__first", first).withColumn("__full", full)
    side = F.coalesce(F.col("__first.side"), F.when(F.col("__full"), 0))
    return rows.withColumn("barrier", side).withColumn("held", F.coalesce(F.col("__first.held"), F.when(F.col("__full"), h))).drop("__first", "__full")


def combinatorial_folds(df: DataFrame, groups: int, tests: int, purge: int, embargo: int, time: str = "date") -> DataFrame:
    """(combo, time, part, block): times are cut into ``groups`` runs; each choice of ``tests`` of them is a combo, whose other times
    are to train on, but for ``purge`` times before and ``embargo`` after each test run. One row per time is ordered."""
    order = Window.orderBy(time)
    times = df.select(time).distinct().withColumn("place", F.row_number().over(order)).withColumn("block", F.ntile(groups).over(order))
    chosen = list(itertools.combinations(range(1, groups + 1), tests))
    combos = df.sparkSession.createDataFrame([(k, list(c)) for k, c in enumerate(chosen)], "combo int, held array<int>")
    spans = times.groupBy("block").agg(F.min("place").alias("low"), F.max("place").alias("high"))
    ends = spans.agg(F.map_from_entries(F.collect_list(F.struct("block", F.struct("low", "high")))).alias("ends"))  # one row per run
    rows = times.crossJoin(F.broadcast(combos)).crossJoin(F.broadcast(ends))
    near = F.exists("held", lambda b: F.col("place").between(F.try_element_at("ends", b)["low"] - purge, F.try_element_at("ends", b)["high"] + embargo))
    part = F.when(F.array_contains("held", F.col("block")), "test").when(~near, "train")
    return rows.withColumn("part", part).where("part is not null").select("combo", time, "part", "block")


def test_paths(spark, groups: int, tests: int) -> DataFrame:
    """(path, block, combo): each path takes every run's test result from another combo; the k-th combo that holds a run out
    serves the k-th path."""
    served = dict.fromkeys(range(1, groups + 1), 0)
    rows = []
    for combo, blocks in enumerate(itertools.combinations(range(1, groups + 1), tests)):
        for b in blocks:
            rows.append((served[b], b, combo))
            served[b] += 1
    return spark.createDataFrame(rows, "path int, block int, combo int")


def walk_windows(df: DataFrame, train: int, test: int, step: int, embargo: int, key: str = "code", time: str = "date") -> DataFrame:
    """Each row once per window that it is part of: ``window``, ``part`` (train or test) and ``left``, how many training rows follow.
    Windows start every ``step`` rows of a key; ``embargo`` rows lie between its parts; only whole windows count."""
    w = ordered(key, time)
    rows = df.withColumn("__k", F.row_number().over(w) - 1).withColumn("__n", F.count("*").over(Window.partitionBy(key)))
    span = train + embargo + test
    first = F.greatest(F.ceil((F.col("__k") - span + 1) / step), F.lit(0))
    last = F.least(F.floor(F.col("__k") / step), F.floor((F.col("__n") - span) / step))
    rows = rows.withColumn("window", F.explode(F.when(last >= first, F.sequence(first, last))))
    at = F.col("__k") - F.col("window") * step
    part = F.when(at < train, "train").when(at >= train + embargo, "test")
    return rows.withColumn("part", part).withColumn("left", train - 1 - at).where("part is not null").drop("__k", "__n")


def sharpe(ret: Column, periods: float) -> Column:
    """Annualised; 0 without spread or with fewer than two values."""
    spread = F.stddev_samp(ret) * math.sqrt(periods)
    return F.when(spread >= 1e-12, F.avg(ret) * periods / spread).otherwise(0.0)


def walk_forward(df: DataFrame, position: Callable[[WindowSpec, dict], Column], grid: list[dict], train: int, test: int, step: int, embargo: int = 0, cost: float = 0.0015, periods: float = 244.0, value: str = "close", key: str = "code", time: str = "date") -> tuple[DataFrame, DataFrame]:
    """In each window the parameters with the highest Sharpe ratio in training (the first of equals; the last ``embargo`` training rows
    don't count) trade its test rows. Positions are computed within a window's part, act a row later and pay ``cost`` for what
    they change by. Returns (key, window, choice, score) and, per key and time, the mean ``ret`` of the windows that test it.

    A key's windows and parameters are dealt out, so that no task holds more than one part of one window."""
    rows = walk_windows(df.select(key, time, value), train, test, step, embargo, key, time)
    w = Window.partitionBy(key, "window", "part").orderBy(time)
    move = F.coalesce(safe_div(value, F.lag(value).over(w)) - 1, F.lit(0.0))
    out = rows.withColumn("__move", move)
    for k, parameters in enumerate(grid):
        out = out.withColumn(f"__s{k}", F.coalesce(F.lag(position(w, parameters)).over(w), F.lit(0.0)))
    for k in range(len(grid)):
        held = F.col(f"__s{k}")
        traded = F.abs(held - F.coalesce(F.lag(held).over(w), F.lit(0.0)))
        out = out.withColumn(f"__r{k}", held * F.col("__move") - traded * cost)
    counted = (F.col("part") == "train") & (F.col("left") >= embargo)
    scores = out.groupBy(key, "window").agg(*(sharpe(F.when(counted, F.col(f"__r{k}")), periods).alias(f"__q{k}") for k in range(len(grid))))
    best = reduce(lambda a, b: F.when(b["score"] > a["score"], b).otherwise(a), (F.struct(F.lit(k).alias("choice"), F.col(f"__q{k}").alias("score")) for k in range(len(grid))))
    chosen = scores.select(key, "window", best.alias("__b")).select(key, "window", "__b.choice", "__b.score")
    tested = out.where("part = 'test'").join(chosen, [key, "window"]).withColumn("__ret", F.element_at(F.array(*(F.col(f"__r{k}") for k in range(len(grid)))), F.col("choice") + 1))
    return chosen, tested.groupBy(key, time).agg(F.avg("__ret").alias("ret"))


def expected_best(trials: int) -> float:
    """The highest of so many standard normal numbers, on average."""
    if trials <= 1:
        return 0.0
    quantile = NormalDist().inv_cdf
    return (1 - EULER) * quantile(1 - 1 / trials) + EULER * quantile(1 - 1 / (trials * math.e))


def deflated(ratio: float, trials: int, n: int, skew: float = 0.0, kurtosis: float = 3.0, target: float = 0.0) -> tuple[float, float]:
    """A per-period Sharpe ratio in deviations above what the best of ``trials`` would reach by chance, and the chance of more. Moments
    that no distribution has count as those of the normal one."""
    if n <= 1 or trials <= 0:
        return 0.0, 1.0
    kurtosis = kurtosis if math.isfinite(kurtosis) and kurtosis >= 1 else 3.0
    skew = skew if math.isfinite(skew) else 0.0
    spread = (1 - skew * ratio + (kurtosis - 1) / 4 * ratio * ratio) / (n - 1)
    spread = spread if math.isfinite(spread) and spread > 0 else 1 / (n - 1)
    z = (ratio - target - expected_best(trials) / math.sqrt(n - 1)) / math.sqrt(spread)
    return z, 1 - NormalDist().cdf(z)


def least_length(ratio: float, confidence: float = 0.95, trials: int = 1, skew: float = 0.0, kurtosis: float = 3.0, most: int = 10_000_000) -> int:
    """The fewest periods after which a per-period Sharpe ratio would be significant, in closed form."""
    if not (math.isfinite(ratio) and ratio > 0 and 0 < confidence < 1):
        raise ValueError("the ratio must be above 0 and the confidence between 0 and 1")
    spread = 1 - skew * ratio + (kurtosis - 1) / 4 * ratio * ratio
    if spread <= 0:
        spread = 1.0
    need = (NormalDist().inv_cdf(confidence) * math.sqrt(spread) + expected_best(trials)) / ratio
    n = 2 if need <= 0 else max(2, math.ceil(1 + need * need - 1e-9))
    return min(n, most)


def deflated_sharpe(df: DataFrame, trials: int, ret: str = "ret", key: str = "code") -> DataFrame:
    """Per key: n, per-period ``ratio``, skewness, kurtosis (3 for the normal), ``z`` and ``p``."""
    x = F.col(ret)
    rows = df.where(x.isNotNull()).groupBy(key).agg(F.count("*").alias("n"), safe_div(F.avg(x), F.stddev_samp(x)).alias("ratio"), F.skewness(x).alias("skewness"), (F.kurtosis(x) + 3).alias("kurtosis"))

    def run(ratio: pd.Series, n: pd.Series, skew: pd.Series, kurtosis: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([deflated(a, trials, int(b), c, d) for a, b, c, d in zip(ratio, n, skew, kurtosis)], columns=["z", "p"])

    rows = rows.where(F.col("ratio").isNotNull())
    found = F.pandas_udf(run, "z double, p double")
    return rows.withColumn("__f", found("ratio", "n", "skewness", "kurtosis")).select(key, "n", "ratio", "skewness", "kurtosis", "__f.*")
