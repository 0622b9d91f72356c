"""Column builders that panel operators share. All of them are native expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a: Column | str, b: Column | str) -> Column:
    """a / b, missing where b is zero or missing."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def clip(x: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """x held to [low, high]; a missing x stays missing (``greatest`` alone would skip it)."""
    c = col(x)
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def finite(x: Column | str) -> Column:
    """NaN and infinities become missing."""
    c = col(x)
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def zfill(x: Column | str, width: int) -> Column:
    """Pad with zeros on the left, never cutting longer text."""
    c = col(x).cast("string")
    return F.when(F.length(c) >= width, c).otherwise(F.lpad(c, width, "0"))


def parse_number(x: Column | str) -> Column:
    """Numbers as people type them: thousands commas go, dashes and words become missing."""
    return F.regexp_replace(F.trim(col(x)), ",", "").try_cast("double")


def parse_date(x: Column | str) -> Column:
    """``yyyyMMdd`` first, then any date text."""
    return F.coalesce(F.try_to_date(col(x), "yyyyMMdd") if hasattr(F, "try_to_date") else F.to_date(col(x), "yyyyMMdd"), col(x).try_cast("date"))


def ordered(key: str | list[str], time: str | list[str]) -> WindowSpec:
    keys = [key] if isinstance(key, str) else key
    times = [time] if isinstance(time, str) else time
    return Window.partitionBy(*keys).orderBy(*times)


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    """The current row and the n - 1 before it."""
    return w.rowsBetween(-(n - 1), 0)


def running(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def enough(x: Column, value: Column, frame: WindowSpec, least: int) -> Column:
    """``value`` where the frame holds at least ``least`` known values of ``x``."""
    return F.when(F.count(x).over(frame) >= least, value)


def rolling(x: Column | str, how: str, w: WindowSpec, n: int, min_periods: int | None = None) -> Column:
    """A trailing aggregate: mean, sum, std, var, min, max, median, count, skew, kurt, or product of 1 + x less 1."""
    c, frame = col(x), trailing(w, n)
    least = n if min_periods is None else min_periods
    aggregates = {
        "mean": F.avg, "sum": F.sum, "std": F.stddev_samp, "var": F.var_samp, "min": F.min, "max": F.max, "count": F.count,
        "median": lambda v: F.percentile(v, F.lit(0.5)),
    }
    if how in aggregates:
        return enough(c, aggregates[how](c).over(frame), frame, least)
    size = F.count(c).over(frame).cast("double")
    if how == "skew":
        g = F.skewness(c).over(frame)
        return F.when((size >= least) & (size > 2), g * F.sqrt(size * (size - 1)) / (size - 2))
    if how == "kurt":
        g = F.kurtosis(c).over(frame)
        return F.when((size >= least) & (size > 3), (size - 1) / ((size - 2) * (size - 3)) * ((size + 1) * g + 6))
    if how == "product":
        logs = F.sum(F.log(1 + c)).over(frame)
        return F.when((size >= least) & (F.min(1 + c).over(frame) > 0), F.exp(logs) - 1)
    raise ValueError(f"unknown aggregate {how}")


def corr(x: Column | str, y: Column | str, frame: WindowSpec | None = None) -> Column:
    """Correlation over rows where both are known; missing, not an error, where either doesn't vary."""
    both = col(x).isNotNull() & col(y).isNotNull()
    a, b = F.when(both, col(x)), F.when(both, col(y))
    over = (lambda c: c) if frame is None else (lambda c: c.over(frame))
    return F.try_divide(over(F.covar_pop(a, b)), over(F.stddev_pop(a)) * over(F.stddev_pop(b)))


def rolling_pair(x: Column | str, y: Column | str, how: str, w: WindowSpec, n: int, min_periods: int | None = None) -> Column:
    """Trailing corr, cov, beta (of x on y) or slope of two columns, over rows where both are known."""
    a, b = col(x), col(y)
    frame = trailing(w, n)
    both = a.isNotNull() & b.isNotNull()
    p, q = F.when(both, a), F.when(both, b)
    value = {
        "corr": lambda: corr(p, q, frame),
        "cov": lambda: F.covar_samp(p, q).over(frame),
        "beta": lambda: safe_div(F.covar_samp(p, q).over(frame), F.var_samp(q).over(frame)),
        "slope": lambda: F.regr_slope(p, q).over(frame),
    }[how]()
    return enough(p, value, frame, n if min_periods is None else min_periods)


def pct_change(x: Column | str, w: WindowSpec, n: int = 1) -> Column:
    """x over x n rows ago, less 1."""
    return safe_div(x, F.lag(col(x), n).over(w)) - 1


def filled(x: Column | str, w: WindowSpec, limit: int | None = None) -> Column:
    """Gaps filled with the last known value, at most ``limit`` rows back."""
    frame = running(w) if limit is None else w.rowsBetween(-limit, 0)
    return F.last(col(x), ignorenulls=True).over(frame)


def average_rank(x: Column | str, group: list[str]) -> Column:
    """Rank with ties averaged among known values of the group; missing stays missing."""
    c = col(x)
    order = Window.partitionBy(*group).orderBy(c.asc_nulls_last())
    ties = F.count(F.lit(1)).over(Window.partitionBy(*group, c))
    return F.when(c.isNotNull(), F.rank().over(order) + (ties - 1) / 2.0)


def pct_rank(x: Column | str, group: list[str]) -> Column:
    c = col(x)
    return average_rank(c, group) / F.count(c).over(Window.partitionBy(*group))


def zscore(x: Column | str, group: list[str], ddof: int = 0, limit: float | None = None, least: int = 1, flat: float | None = 0.0) -> Column:
    """Standard score in the group; ``flat`` where the spread is zero; missing below ``least`` known values."""
    c, g = col(x), Window.partitionBy(*group)
    std = (F.stddev_pop if ddof == 0 else F.stddev_samp)(c).over(g)
    z = F.when(std > 0, (c - F.avg(c).over(g)) / std).when(c.isNotNull() & (std == 0), F.lit(flat).cast("double"))
    z = F.when(F.count(c).over(g) >= least, z)
    return z if limit is None else clip(z, -limit, limit)


def rsi(price: Column | str, w: WindowSpec, n: int = 14) -> Column:
    """Relative strength over simple means: 100 without losses, missing where nothing moves."""
    move = col(price) - F.lag(col(price)).over(w)
    frame = trailing(w, n)
    gain = F.avg(F.when(move.isNotNull(), F.greatest(move, F.lit(0.0)))).over(frame)
    loss = F.avg(F.when(move.isNotNull(), F.greatest(-move, F.lit(0.0)))).over(frame)
    value = F.when((loss == 0) & (gain == 0), None).when(loss == 0, 100.0).otherwise(100 - 100 / (1 + safe_div(gain, loss)))
    return enough(move, value, frame, n)
