"""Watching what is held: betas that break, attribution to factors, rolling figures, costs of trading, phases of a session."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.expr import col, enough, ordered, rolling, safe_div, trailing

#: Phases of a trading day: name, first minute, first minute after it.
PHASES = (("opening_auction", "09:15", "09:25"), ("pause", "09:25", "09:30"), ("continuous", "09:30", "11:30"), ("lunch", "11:30", "13:00"), ("continuous", "13:00", "14:57"), ("closing_auction", "14:57", "15:00"))


def beta_windows(df: DataFrame, ret: str, market: str, n: int = 60, key: str = "code", time: str = "date") -> DataFrame:
    """Per key: ``current`` and ``previous`` beta over its last ``n`` rows with both returns and the ``n`` before (sample covariance over
    population variance), and their ``change``; keys with fewer than two windows are missing."""
    rows = df.where(F.col(ret).isNotNull() & F.col(market).isNotNull())
    rows = rows.withColumn("__back", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(time)))).where(F.col("__back") <= 2 * n)
    part = lambda c, now: F.when((F.col("__back") <= n) == now, F.col(c))
    beta = lambda now: safe_div(F.covar_samp(part(ret, now), part(market, now)), F.when(F.var_pop(part(market, now)) >= 1e-12, F.var_pop(part(market, now))))
    out = rows.groupBy(key).agg(F.count("*").alias("__n"), beta(F.lit(True)).alias("current"), beta(F.lit(False)).alias("previous")).where(F.col("__n") >= 2 * n)
    return out.select(key, "current", "previous", (F.col("current") - F.col("previous")).alias("change"))


def beta_break(held: DataFrame, betas: DataFrame, by: list[str], threshold: float = 0.3, key: str = "code") -> DataFrame:
    """Per portfolio: betas of both windows, weighted over the assets that have them, and ``alert`` if they differ by more than the threshold."""
    rows = held.join(betas.select(key, "current", "previous"), key)
    mean = lambda c: safe_div(F.sum(F.col("weight") * F.col(c)), F.sum(F.when(F.col(c).isNotNull(), F.col("weight"))))
    out = rows.groupBy(*by).agg(mean("current").alias("current"), mean("previous").alias("previous")).withColumn("change", F.col("current") - F.col("previous"))
    return out.withColumn("alert", F.coalesce(F.abs("change") > threshold, F.lit(False)))


def attribution(exposed: DataFrame, factors: list[str], returns: DataFrame, portfolio: DataFrame, time: str = "date") -> DataFrame:
    """One row per factor: mean ``exposure`` of the portfolio, sum of the factor's ``ret``, ``contribution`` (sum over dates of exposure
    times return); ``residual`` (what the portfolio returned beyond all contributions) and ``r2`` of the dates' returns by the
    model, the same in each row. ``exposed`` has ``weight`` and the factors by date; weights are scaled to 1."""
    total = F.sum("weight")
    weighted = exposed.groupBy(time).agg(*(safe_div(F.sum(F.col("weight") * F.col(f)), total).alias(f"__x_{f}") for f in factors))
    rows = weighted.join(returns.select(time, *(F.col(f).alias(f"__f_{f}") for f in factors)), time).join(portfolio.select(time, "ret"), time)
    model = sum((F.col(f"__x_{f}") * F.col(f"__f_{f}") for f in factors[1:]), F.col(f"__x_{factors[0]}") * F.col(f"__f_{factors[0]}"))
    rows = rows.withColumn("__model", model).withColumn("__rest", F.col("ret") - F.col("__model"))
    cells = F.array(*(F.struct(F.lit(f).alias("factor"), F.avg(f"__x_{f}").alias("exposure"), F.sum(f"__f_{f}").alias("ret"), F.sum(F.col(f"__x_{f}") * F.col(f"__f_{f}")).alias("contribution")) for f in factors))
    r2 = 1 - safe_div(F.sum(F.col("__rest") * F.col("__rest")), F.regr_syy("ret", "ret"))
    return rows.agg(cells.alias("c"), F.sum("__rest").alias("residual"), r2.alias("r2")).select(F.inline("c"), "residual", "r2")


def rolling_figures(df: DataFrame, ret: str, n: int, free_rate: float = 0.025, periods: float = 252.0, key: str = "code", time: str = "date") -> DataFrame:
    """``sharpe``, ``vol`` (annualised) and ``max_dd`` (from the highest value inside the window) over the last ``n`` returns."""
    w = ordered(key, time)
    frame = trailing(w, n)
    std = rolling(ret, "std", w, n)
    start = F.struct(F.lit(1.0).alias("v"), F.lit(None).cast("double").alias("top"), F.lit(0.0).alias("worst"))

    def step(a: Column, r: Column) -> Column:
        v = a["v"] * (1 + r)
        top = F.greatest(a["top"], v)
        return F.struct(v.alias("v"), top.alias("top"), F.least(a["worst"], (v - top) / top).alias("worst"))

    worst = F.aggregate(F.collect_list(ret).over(frame), start, step, lambda a: a["worst"])
    rows = df.withColumn("__mean", rolling(ret, "mean", w, n)).withColumn("__std", std)
    out = rows.withColumn("sharpe", safe_div(F.col("__mean") - free_rate / periods, "__std") * math.sqrt(periods)).withColumn("vol", F.col("__std") * math.sqrt(periods))
    return out.withColumn("max_dd", enough(F.col(ret), worst, frame, n)).drop("__mean", "__std")


def permanent_impact(shares: Column | str, daily_shares: Column | str, eta: float, outstanding: Column | str | None = None) -> Column:
    """In basis points, in proportion to the share of a day's volume; beyond 5 % of all shares it grows tenfold with the excess."""
    impact = safe_div(shares, daily_shares) * eta * 1e4
    if outstanding is None:
        return impact
    part = safe_div(shares, outstanding)
    return F.when(part > 0.05, impact * (1 + 10 * (part - 0.05))).otherwise(impact)


def temporary_impact(shares: Column | str, daily_shares: Column | str, eta: float, sigma: Column | float, gamma: float, days: float = 1.0) -> Column:
    """In basis points, by the rate of trading to the power ``gamma``."""
    rate = safe_div(shares, daily_shares) / days
    return eta * (sigma if isinstance(sigma, Column) else F.lit(sigma)) * F.pow(rate, F.lit(gamma)) * 1e4


def phase(ts: Column | str, open_day: Column | bool = True) -> Column:
    """The phase of a trading day that a time of day is in; ``closed`` outside them and on other days."""
    c = col(ts)
    minute = F.hour(c) * 60 + F.minute(c)
    at = lambda t: int(t[:2]) * 60 + int(t[3:])
    out = F.when(~(open_day if isinstance(open_day, Column) else F.lit(open_day)) | c.isNull(), "closed")
    for name, first, end in PHASES:
        out = out.when((minute >= at(first)) & (minute < at(end)), name)
    return out.otherwise("closed")


def shifted_session(df: DataFrame, calendar: DataFrame, n: int, day: str, name: str = "session", time: str = "date") -> DataFrame:
    """``name``: the ``n``-th session after the day, or before it for n below 0; missing beyond the calendar. Every day between sessions is
    laid out with those on either side, so days join on equality; one row per session is ordered."""
    if n == 0:
        raise ValueError("n must not be 0")
    w = Window.orderBy("__s")
    sessions = calendar.select(F.col(time).cast("date").alias("__s")).distinct()
    sessions = sessions.select("__s", F.lead("__s").over(w).alias("__next"), F.lead("__s", n).over(w).alias("__on") if n > 0 else F.lag("__s", -n).over(w).alias("__on"), *([] if n > 0 else [F.lag("__s", -n - 1).over(w).alias("__off")]))
    days = F.sequence(F.col("__s"), F.coalesce(F.date_sub("__next", 1), F.col("__s")))
    between = F.col("__on") if n > 0 else F.when(F.col("__day") == F.col("__s"), F.col("__on")).otherwise(F.col("__off"))
    laid = sessions.withColumn("__day", F.explode(days)).select("__day", between.alias(name))
    ends = calendar.agg(F.min(F.col(time).cast("date")).alias("__first"), F.max(F.col(time).cast("date")).alias("__last"))  # one row
    edge = sessions.select("__s").orderBy("__s" if n > 0 else F.desc("__s")).limit(abs(n)).agg((F.max("__s") if n > 0 else F.min("__s")).alias("__edge"), F.count("*").alias("__k"))
    rows = df.drop(name).join(laid, F.col(day).cast("date") == F.col("__day"), "left").crossJoin(F.broadcast(ends)).crossJoin(F.broadcast(edge))
    outside = F.col(day) < F.col("__first") if n > 0 else F.col(day) > F.col("__last")
    found = F.when(outside & (F.col("__k") == abs(n)), F.col("__edge")).otherwise(F.col(name))
    return rows.withColumn(name, found).drop("__day", "__first", "__last", "__edge", "__k")
