"""Operators along time, per key: returns, rolling windows, recursive averages, fills, resampling, runs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.expr import clip, enough, filled, ordered, pct_change, rolling, rolling_pair, rsi, running, safe_div, trailing


def momentum(df: DataFrame, lags: tuple[int, ...], key: str = "code", time: str = "date", value: str = "close") -> DataFrame:
    """``mom_n`` for each lag, and ``reversal`` (the negative of the shortest)."""
    w = ordered(key, time)
    out = df.select("*", *(pct_change(value, w, n).alias(f"mom_{n}") for n in lags))
    return out.withColumn("reversal", -F.col(f"mom_{min(lags)}"))


def skip_momentum(df: DataFrame, skip: int, spans: tuple[int, ...], key: str = "code", time: str = "date", value: str = "close") -> DataFrame:
    """Momentum over each span that leaves the last ``skip`` rows out."""
    w = ordered(key, time)
    return df.select("*", *((safe_div(F.lag(value, skip).over(w), F.lag(value, n).over(w)) - 1).alias(f"mom_{n}_{skip}") for n in spans))


def rolling_stats(df: DataFrame, n: int, how: tuple[str, ...], value: str = "close", key: str = "code", time: str = "date", min_periods: int | None = None) -> DataFrame:
    w = ordered(key, time)
    return df.select("*", *(rolling(value, h, w, n, min_periods).alias(f"{h}_{n}") for h in how))


def ts_rank(value: str, n: int, w) -> Column:
    """Share of the window at or below the current value, ties averaged; needs a full window."""
    frame = trailing(w, n)
    window = F.collect_list(value).over(frame)
    below, same = F.size(F.filter(window, lambda v: v < F.col(value))), F.size(F.filter(window, lambda v: v == F.col(value)))
    return enough(F.col(value), (below + (same + 1) / 2.0) / F.size(window), frame, n)


def share_below(value: str, n: int, w, strict: bool = True, least: int | None = None) -> Column:
    """Share of the window below (or at) the current value."""
    frame = trailing(w, n)
    window = F.collect_list(value).over(frame)
    hits = F.size(F.filter(window, lambda v: (v < F.col(value)) if strict else (v <= F.col(value))))
    return enough(F.col(value), hits / F.size(window), frame, least or n)


def weighted_mean(value: str, n: int, w) -> Column:
    """Linear weights 1..n, the latest row the heaviest."""
    terms = [F.lag(value, n - k).over(w) * k for k in range(1, n + 1)]
    return sum(terms[1:], terms[0]) / (n * (n + 1) / 2)


def mean_deviation(value: str, n: int, w) -> Column:
    """Mean absolute deviation from the window's own mean."""
    frame = trailing(w, n)
    window, mean = F.collect_list(value).over(frame), F.avg(value).over(frame)
    total = F.aggregate(window, F.lit(0.0), lambda a, v: a + F.abs(v - mean))
    return enough(F.col(value), total / F.size(window), frame, n)


def cci(df: DataFrame, n: int = 20, key: str = "code", time: str = "date") -> DataFrame:
    """Commodity channel index on the typical price."""
    w = ordered(key, time)
    typical = df.withColumn("typical", (F.col("high") + F.col("low") + F.col("close")) / 3)
    spread = mean_deviation("typical", n, w)
    return typical.withColumn("cci", safe_div(F.col("typical") - rolling("typical", "mean", w, n), spread * 0.015))


def window_drawdown(value: str, n: int, w) -> Column:
    """The deepest fall from a running peak inside the window: an exact fold over its rows."""
    frame = trailing(w, n)
    start = F.struct(F.lit(None).cast("double").alias("peak"), F.lit(0.0).alias("worst"))

    def step(a: Column, v: Column) -> Column:
        peak = F.greatest(a["peak"], v)
        return F.struct(peak.alias("peak"), F.least(a["worst"], v / peak - 1).alias("worst"))

    folded = F.aggregate(F.collect_list(value).over(frame), start, step, lambda a: a["worst"])
    return enough(F.col(value), folded, frame, n)


def drawdown(df: DataFrame, value: str, key: str = "code", time: str = "date") -> DataFrame:
    """``drawdown`` from the highest value so far."""
    return df.withColumn("drawdown", F.col(value) / F.max(value).over(running(ordered(key, time))) - 1)


def expanding_z(value: str, w, least: int = 20) -> Column:
    """Score against all history so far; 0 where there is no spread."""
    frame = running(w)
    std = F.stddev_samp(value).over(frame)
    return enough(F.col(value), F.when(std > 0, (F.col(value) - F.avg(value).over(frame)) / std).otherwise(0.0), frame, least)


def ewm(x: np.ndarray, alpha: float, adjust: bool = False, min_periods: int = 0) -> np.ndarray:
    """Exponentially weighted mean of one ordered series; unknown values keep the last state and decay it."""
    return pd.Series(x).ewm(alpha=alpha, adjust=adjust, min_periods=min_periods).mean().to_numpy()


def by_series(df: DataFrame, columns: dict[str, Callable[[pd.DataFrame], np.ndarray]], key: str = "code", time: str = "date") -> DataFrame:
    """Add columns that need a whole ordered series, one grouped pass for all of them."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"`{c}` double" for c in columns)])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(time, kind="stable")
        return rows.assign(**{c: f(rows) for c, f in columns.items()})

    return df.groupBy(key).applyInPandas(run, schema)


def _ewm(x: np.ndarray, alpha: float, least: int = 0) -> np.ndarray:
    """pandas' unadjusted exponential mean; missing before ``least`` known values."""
    return pd.Series(x).ewm(alpha=alpha, adjust=False, min_periods=least).mean().to_numpy()


def _line(f: Callable[[pd.DataFrame], np.ndarray]) -> Callable[[pd.DataFrame], np.ndarray]:
    """Computed once for a key's rows, however many lines use it."""
    last: list = []

    def once(r: pd.DataFrame) -> np.ndarray:
        if not last or last[0] is not r:
            last[:] = [r, f(r)]
        return last[1]

    return once


def recursive_indicators(df: DataFrame, key: str = "code", time: str = "date", names: tuple[str, ...] | None = None) -> DataFrame:
    """EMA 12 and 26, MACD (line, signal, histogram twice their difference), Wilder RSI and ATR 14, KDJ 9, ADX 14; or only
    those that are named."""
    span = lambda n: 2 / (n + 1)
    numbers = lambda r, c: r[c].to_numpy(float)
    before = lambda x: np.concatenate(([np.nan], x[:-1]))

    @_line
    def fast(r: pd.DataFrame) -> np.ndarray:
        return _ewm(numbers(r, "close"), span(12))

    @_line
    def slow(r: pd.DataFrame) -> np.ndarray:
        return _ewm(numbers(r, "close"), span(26))

    @_line
    def signal(r: pd.DataFrame) -> np.ndarray:
        return _ewm(fast(r) - slow(r), span(9))

    def wilder_rsi(r: pd.DataFrame) -> np.ndarray:
        move = numbers(r, "close") - before(numbers(r, "close"))
        gain, loss = _ewm(np.maximum(move, 0), 1 / 14, 14), _ewm(np.maximum(-move, 0), 1 / 14, 14)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(loss > 0, 100 - 100 / (1 + gain / loss), np.where(gain > 0, 100.0, np.nan))

    @_line
    def size(r: pd.DataFrame) -> np.ndarray:
        high, low, last = numbers(r, "high"), numbers(r, "low"), before(numbers(r, "close"))
        return _ewm(np.fmax(np.fmax(high - low, np.abs(high - last)), np.abs(low - last)), 1 / 14, 14)

    @_line
    def k_line(r: pd.DataFrame) -> np.ndarray:
        low, high = r["low"].rolling(9, min_periods=1).min().to_numpy(), r["high"].rolling(9, min_periods=1).max().to_numpy()
        with np.errstate(divide="ignore", invalid="ignore"):
            raw = np.where(high != low, (numbers(r, "close") - low) / (high - low) * 100, np.nan)
        return _ewm(np.where(np.isnan(raw), 50.0, raw), 1 / 3)

    @_line
    def d_line(r: pd.DataFrame) -> np.ndarray:
        return _ewm(k_line(r), 1 / 3)

    def adx(r: pd.DataFrame) -> np.ndarray:
        high, low = numbers(r, "high"), numbers(r, "low")
        up, down = high - before(high), before(low) - low
        plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
        known = np.where(size(r) == 0, np.nan, size(r))
        p, m = 100 * _ewm(plus, 1 / 14, 14) / known, 100 * _ewm(minus, 1 / 14, 14) / known
        with np.errstate(divide="ignore", invalid="ignore"):
            return _ewm(np.where(p + m == 0, np.nan, 100 * np.abs(p - m) / (p + m)), 1 / 14, 14)

    lines = {
        "ema_12": fast, "ema_26": slow, "macd": lambda r: fast(r) - slow(r), "macd_signal": signal,
        "macd_hist": lambda r: 2 * (fast(r) - slow(r) - signal(r)), "rsi_wilder": wilder_rsi, "atr_wilder": size,
        "kdj_k": k_line, "kdj_d": d_line, "kdj_j": lambda r: 3 * k_line(r) - 2 * d_line(r), "adx": adx,
    }
    return by_series(df, {n: lines[n] for n in names or lines}, key, time)


def true_range(w) -> Column:
    before = F.lag("close").over(w)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def bands(df: DataFrame, n: int = 20, k: float = 2.0, key: str = "code", time: str = "date") -> DataFrame:
    """Bollinger bands (sample deviation), width and place of the close between them."""
    w = ordered(key, time)
    mid, std = rolling("close", "mean", w, n), rolling("close", "std", w, n)
    out = df.withColumn("mid", mid).withColumn("upper", mid + std * k).withColumn("lower", mid - std * k)
    return out.withColumn("width", safe_div(F.col("upper") - F.col("lower"), "mid")).withColumn("place", safe_div(F.col("close") - F.col("lower"), F.col("upper") - F.col("lower")))


def volume_lines(df: DataFrame, key: str = "code", time: str = "date") -> DataFrame:
    """On-balance volume, price-volume trend, volume ratio to the last five rows before, and 20-row VWAP."""
    w = ordered(key, time)
    move = F.col("close") - F.lag("close").over(w)
    rows = df.withColumn("__signed", F.coalesce(F.signum(move), F.lit(0.0)) * F.col("volume")).withColumn("__flow", F.coalesce(pct_change("close", w), F.lit(0.0)) * F.col("volume"))
    out = rows.withColumn("obv", F.sum("__signed").over(running(w))).withColumn("pvt", F.sum("__flow").over(running(w)))
    out = out.withColumn("volume_ratio", safe_div("volume", F.avg("volume").over(w.rowsBetween(-5, -1))))
    frame = trailing(w, 20)
    return out.withColumn("vwap", safe_div(F.sum(F.col("close") * F.col("volume")).over(frame), F.sum("volume").over(frame))).drop("__signed", "__flow")


def breakout(df: DataFrame, n: int, key: str = "code", time: str = "date") -> DataFrame:
    """Extrema of the n rows before the current one, and whether the close breaks out of them."""
    w = ordered(key, time).rowsBetween(-n, -1)
    out = df.withColumn("prior_high", F.max("high").over(w)).withColumn("prior_low", F.min("low").over(w))
    return out.withColumn("breaks_up", F.coalesce(F.col("close") > F.col("prior_high"), F.lit(False))).withColumn("breaks_down", F.coalesce(F.col("close") < F.col("prior_low"), F.lit(False)))


def candle_patterns(df: DataFrame, key: str = "code", time: str = "date") -> DataFrame:
    """Names of one-, two- and three-bar patterns as an array."""
    w = ordered(key, time)
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    po, pc = F.lag("open").over(w), F.lag("close").over(w)
    po2, pc2 = F.lag("open", 2).over(w), F.lag("close", 2).over(w)
    body, span = F.abs(c - o), h - l
    top, bottom = h - F.greatest(o, c), F.least(o, c) - l
    tests = {
        "doji": (span > 0) & (body <= span * 0.1),
        "hammer": (body > 0) & (bottom >= body * 2) & (top <= body * 0.5),
        "shooting_star": (body > 0) & (top >= body * 2) & (bottom <= body * 0.5),
        "bullish_engulfing": (pc < po) & (c > o) & (o <= pc) & (c >= po),
        "bearish_engulfing": (pc > po) & (c < o) & (o >= pc) & (c <= po),
        "inside": (F.greatest(o, c) < F.greatest(po, pc)) & (F.least(o, c) > F.least(po, pc)),
        "three_up": (c > o) & (pc > po) & (pc2 > po2) & (c > pc) & (pc > pc2),
        "three_down": (c < o) & (pc < po) & (pc2 < po2) & (c < pc) & (pc < pc2),
    }
    return df.withColumn("patterns", F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in tests.items()))))


def runs(df: DataFrame, flag: Column, key: str = "code", time: str = "date") -> DataFrame:
    """``run``: consecutive rows with the flag up to and with the current one; 0 without it."""
    w = ordered(key, time)
    marked = df.withColumn("__up", F.coalesce(flag, F.lit(False))).withColumn("__part", F.sum(F.when(F.col("__up"), 0).otherwise(1)).over(running(w)))
    inside = Window.partitionBy(key, "__part").orderBy(time)
    return marked.withColumn("run", F.sum(F.col("__up").cast("bigint")).over(running(inside))).drop("__up", "__part")


def fill_calendar(df: DataFrame, calendar: DataFrame, prices: list[str], flows: list[str], limit: int = 10, key: str = "code", time: str = "date") -> DataFrame:
    """A row for every calendar date between a key's first and last: prices filled forward at most ``limit``
    rows, flows 0, ``synthetic`` marks them; rows without a price after that are dropped."""
    spans = df.groupBy(key).agg(F.min(time).alias("__from"), F.max(time).alias("__to"))
    spine = spans.join(calendar.select(F.col(time).alias("__day")), F.col("__day").between(F.col("__from"), F.col("__to"))).select(key, F.col("__day").alias(time))
    rows = spine.join(df.withColumn("__real", F.lit(True)), [key, time], "left")
    w = ordered(key, time)
    out = rows.select(
        key, time, *(filled(p, w, limit).alias(p) for p in prices), *(F.coalesce(F.col(f), F.lit(0.0)).alias(f) for f in flows),
        F.col("__real").isNull().alias("synthetic"),
    )
    return out.where(F.col(prices[0]).isNotNull())


def resample(df: DataFrame, period: Column, key: str = "code", time: str = "date") -> DataFrame:
    """Bars of a longer period: first open, highest, lowest, last close, summed volume and amount."""
    return df.groupBy(key, period.alias("period")).agg(
        F.min_by("open", time).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", time).alias("close"),
        F.sum("volume").alias("volume"), F.sum("amount").alias("amount"), F.count("*").alias("bars"),
    )


def forward_return(df: DataFrame, h: int, key: str = "code", time: str = "date", value: str = "close") -> DataFrame:
    """``forward`` over the next h rows, and ``known_on``: the date at which it is known."""
    w = ordered(key, time)
    return df.withColumn("forward", safe_div(F.lead(value, h).over(w), value) - 1).withColumn("known_on", F.lead(time, h).over(w))


def next_open_label(df: DataFrame, key: str = "code", time: str = "date") -> DataFrame:
    """Enter at the open of the next date of the common calendar, leave at the open of the one after."""
    w = Window.orderBy(time)  # one row per date
    calendar = df.select(time).distinct().select(time, F.lead(time, 1).over(w).alias("__in"), F.lead(time, 2).over(w).alias("__out"))
    own = ordered(key, time)
    rows = df.select("*", *(F.lead(F.struct(F.col(time).alias("t"), F.col("open").alias("o")), k).over(own).alias(f"__{k}") for k in (1, 2))).join(calendar, time)
    at = lambda day: F.when(F.col("__1.t") == F.col(day), F.col("__1.o")).when(F.col("__2.t") == F.col(day), F.col("__2.o"))
    out = rows.withColumn("entry", at("__in")).withColumn("exit", at("__out"))
    return out.withColumn("label", safe_div("exit", "entry") - 1).drop("__1", "__2", "__in", "__out")


def market_features(df: DataFrame, key: str = "code", time: str = "date", value: str = "close", n: int = 20) -> DataFrame:
    """Trailing beta, correlation and slope of a key's return on the mean return of all."""
    w = ordered(key, time)
    returns = df.withColumn("ret", pct_change(value, w))
    rows = returns.withColumn("market", F.avg("ret").over(Window.partitionBy(time)))
    return rows.select("*", *(rolling_pair("ret", "market", how, w, n, n // 2).alias(f"{how}_{n}") for how in ("beta", "corr", "cov")))


def trend_slope(value: str, n: int, w) -> tuple[Column, Column]:
    """Least-squares slope of the last n values on their order, and its angle in degrees, held to +-90."""
    order = F.row_number().over(w).cast("double")
    frame = trailing(w, n)
    slope = enough(F.col(value), F.regr_slope(F.col(value), F.col("__order")).over(frame), frame, n)
    return order, slope


def with_trend(df: DataFrame, value: str = "close", n: int = 10, key: str = "code", time: str = "date") -> DataFrame:
    w = ordered(key, time)
    order, slope = trend_slope(value, n, w)
    out = df.withColumn("__order", order).withColumn("slope", slope)
    return out.withColumn("angle", clip(F.degrees(F.atan("slope")), -90.0, 90.0)).drop("__order")


def range_volatility(df: DataFrame, n: int = 20, key: str = "code", time: str = "date") -> DataFrame:
    """Parkinson, Garman-Klass and Yang-Zhang volatility over n bars."""
    w = ordered(key, time)
    frame = trailing(w, n)
    hl, co = F.log(F.col("high") / F.col("low")), F.log(F.col("close") / F.col("open"))
    gap = F.log(F.col("open") / F.lag("close").over(w))
    rs = F.log(F.col("high") / F.col("close")) * F.log(F.col("high") / F.col("open")) + F.log(F.col("low") / F.col("close")) * F.log(F.col("low") / F.col("open"))
    rows = df.withColumn("__hl", hl * hl).withColumn("__gk", 0.5 * hl * hl - (2 * np.log(2) - 1) * co * co).withColumn("__o", gap).withColumn("__c", co).withColumn("__rs", rs)
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    full = F.count("close").over(frame) >= n
    mean = lambda c: F.avg(c).over(frame)
    out = rows.withColumn("parkinson", F.when(full, F.sqrt(mean("__hl") / (4 * np.log(2)))))
    out = out.withColumn("garman_klass", F.when(full & (mean("__gk") >= 0), F.sqrt(F.greatest(mean("__gk"), F.lit(0.0)))))
    yz = F.var_samp("__o").over(frame) + F.var_samp("__c").over(frame) * k + mean("__rs") * (1 - k)
    out = out.withColumn("yang_zhang", F.when((F.count("__o").over(frame) >= n) & (yz >= 0), F.sqrt(F.greatest(yz, F.lit(0.0)))))
    return out.drop("__hl", "__gk", "__o", "__c", "__rs")


def with_rsi(df: DataFrame, n: int = 14, key: str = "code", time: str = "date") -> DataFrame:
    w = ordered(key, time)
    return df.withColumn("rsi", rsi("close", w, n))


def back_fill(df: DataFrame, column: str, key: str = "code", time: str = "date") -> DataFrame:
    """Each missing value becomes the next one that isn't."""
    w = ordered(key, time).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn(column, F.first(column, ignorenulls=True).over(w))


def price_lines(df: DataFrame, span: int = 60, key: str = "code", time: str = "date") -> DataFrame:
    """``twap`` (mean of a bar's four prices), ``vwap`` (amount over volume; without volume the last known one, or
    else the close), what the close is above either in percent, and how far the close is below the ``span`` closes
    before it (``reversal_strength``, 0 to 100) and their low over their high (``reversal_ratio``)."""
    w = ordered(key, time)
    before = w.rowsBetween(-span, -1)
    full = F.count("close").over(before) >= span
    low, high = F.when(full, F.min("close").over(before)), F.when(full, F.max("close").over(before))
    known = F.last(safe_div("amount", "volume"), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = df.withColumn("twap", (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4).withColumn("vwap", F.coalesce(known, "close"))
    rows = rows.withColumn("__low", low).withColumn("__high", high)
    rows = rows.withColumn("twap_deviation", (safe_div("close", "twap") - 1) * 100).withColumn("vwap_deviation", (safe_div("close", "vwap") - 1) * 100)
    place = safe_div(F.col("close") - F.col("__low"), F.col("__high") - F.col("__low"))
    rows = rows.withColumn("reversal_strength", clip((1 - place) * 100, 0.0, 100.0)).withColumn("reversal_ratio", clip(safe_div("__low", "__high"), 0.0, 1.0))
    return rows.drop("__low", "__high")
