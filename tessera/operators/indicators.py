"""Bundles of indicators for a chart: daily, minutes, several resolutions side by side, scores, divergence.

All recursive lines of a bundle come from one prefix scan; everything else is windows over the same key and order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.expr import clip, ordered, rolling, running, safe_div, trailing
from tessera.operators import recursion as rc
from tessera.operators.timeseries import mean_deviation, true_range

#: Names of candlestick patterns, in the order in which a row lists them.
PATTERNS = ("doji", "hammer", "shooting_star", "bullish_engulf", "bearish_engulf", "piercing", "dark_cloud", "harami", "three_white", "three_black", "morning_star", "evening_star")


def _change(df: DataFrame, w) -> DataFrame:
    move = F.col("close") - F.lag("close").over(w)
    return df.withColumn("__gain", F.greatest(move, F.lit(0.0)) + move * 0).withColumn("__loss", F.greatest(-move, F.lit(0.0)) + move * 0)


def _rsi(gain: str, loss: str) -> Column:
    """Missing where nothing was lost."""
    return 100 - 100 / (1 + safe_div(gain, loss))


def recursive_lines(df: DataFrame, emas: tuple[int, ...], rsis: tuple[int, ...] = (), macd: bool = False, kdj: bool = False, atr: int = 0, adx: int = 0, key: str = "code", time: str = "date", parts: int | None = None) -> DataFrame:
    """``ema_n``; ``rsi_n`` with means that start at the first change; ``macd_dif``, ``macd_dea``, ``macd_hist``; ``kdj_k``, ``kdj_d``,
    ``kdj_j`` from full windows of 9; ``atr_n``; ``adx_n`` (a second scan, of what the first one gives)."""
    w = ordered(key, time)
    rows = _change(df, w).withColumn("__range", true_range(w))
    low, high = rolling("low", "min", w, 9), rolling("high", "max", w, 9)
    rows = rows.withColumn("__raw", safe_div(F.col("close") - low, high - low) * 100)
    up, down = F.col("high") - F.lag("high").over(w), F.lag("low").over(w) - F.col("low")
    rows = rows.withColumn("__plus", F.coalesce(F.when((up > down) & (up > 0), up), F.lit(0.0))).withColumn("__minus", F.coalesce(F.when((down > up) & (down > 0), down), F.lit(0.0)))
    steps = [rc.ewm_mean("close", 2 / (n + 1), f"ema_{n}") for n in emas]
    steps += [r for n in rsis for r in (rc.ewm_mean("__gain", 1 / n, f"__gain_{n}"), rc.ewm_mean("__loss", 1 / n, f"__loss_{n}"))]
    steps += [rc.macd("close", ("__fast", "__slow", "macd_dea"))] if macd else []
    steps += [rc.twice_smoothed("__raw", ("kdj_k", "kdj_d"))] if kdj else []
    steps += [rc.ewm_mean("__range", 1 / n, f"__atr_{n}") for n in sorted({atr, adx} - {0})]
    steps += [rc.ewm_mean("__plus", 1 / adx, "__plus_mean"), rc.ewm_mean("__minus", 1 / adx, "__minus_mean")] if adx else []
    out = rc.scan(rows, steps, key, time, parts=parts)
    for n in rsis:
        out = out.withColumn(f"rsi_{n}", _rsi(f"__gain_{n}", f"__loss_{n}"))
    if macd:
        out = out.withColumn("macd_dif", F.col("__fast") - F.col("__slow")).withColumn("macd_hist", (F.col("macd_dif") - F.col("macd_dea")) * 2)
    if kdj:
        out = out.withColumn("kdj_j", 3 * F.col("kdj_k") - 2 * F.col("kdj_d"))
    if atr:
        out = out.withColumn(f"atr_{atr}", F.col(f"__atr_{atr}"))
    if adx:
        plus, minus = (100 * safe_div(c, f"__atr_{adx}") for c in ("__plus_mean", "__minus_mean"))
        out = out.withColumn("__spread", safe_div(F.abs(plus - minus), plus + minus) * 100)
        out = rc.scan(out, [rc.ewm_mean("__spread", 1 / adx, f"adx_{adx}")], key, time, parts=parts)
    return out.drop(*(c for c in out.columns if c.startswith("__")))


def candlesticks(w) -> Column:
    """Patterns of a bar and the two before it, as one comma-separated text."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    o1, c1, o2, c2 = (F.lag(x, k).over(w) for x, k in (("open", 1), ("close", 1), ("open", 2), ("close", 2)))
    span1 = F.lag("high").over(w) - F.lag("low").over(w)
    body, span = F.abs(c - o), h - l
    share = lambda part, whole: safe_div(part, whole)
    of_body, of_top, of_bottom = share(body, span), share(h - F.greatest(o, c), span), share(F.least(o, c) - l, span)
    real = of_body.isNotNull() & (body >= 1e-6)
    body1 = F.abs(c1 - o1)
    real1, real2 = (F.lag((F.abs(F.col("close") - F.col("open")) >= 1e-6) & (F.col("high") > F.col("low")), k).over(w) for k in (1, 2))
    small, after = real & (of_body < 0.1), real & (body1 >= 1e-6)
    up, down, up1, down1 = c > o, c < o, c1 > o1, c1 < o1
    star = share(body1, span1) < 0.3
    tests = {
        "doji": small & (of_top < 0.3) & (of_bottom < 0.3),
        "hammer": small & (of_bottom > 0.6) & (of_top < 0.1),
        "shooting_star": small & (of_top > 0.6) & (of_bottom < 0.1),
        "bullish_engulf": after & up & down1 & (c > o1) & (o < c1),
        "bearish_engulf": after & down & up1 & (o > c1) & (c < o1),
        "piercing": after & up & down1 & (c > (o1 + c1) / 2) & (o < c1) & (c < o1),
        "dark_cloud": after & down & up1 & (o > c1) & (c < (o1 + c1) / 2),
        "harami": real & (body1 > 0) & (body < body1 * 0.3),
        "three_white": real & real1 & real2 & (c2 > o2) & up1 & up & (c1 > c2) & (c > c1),
        "three_black": real & real1 & real2 & (c2 < o2) & down1 & down & (c1 < c2) & (c < c1),
        "morning_star": (c2 < o2) & star & up & (c > (o2 + c2) / 2),
        "evening_star": (c2 > o2) & star & down & (c < (o2 + c2) / 2),
    }
    return F.concat_ws(",", *(F.when(tests[n], F.lit(n)) for n in PATTERNS))


def daily(df: DataFrame, fast: int = 5, slow: int = 20, trend: int = 60, long_trend: int = 120, volume_ma: int = 20, key: str = "code", time: str = "date", parts: int | None = None) -> DataFrame:
    """The daily bundle: means, exponential lines, bands, ranges, volume, extrema of the 60 rows before, patterns, resistance
    slope and its score over 300 rows, channel index, four scores and their composite (unrounded)."""
    w = ordered(key, time)
    out = recursive_lines(df, (5, 10, 12, 21, 26), (6, 14), True, True, 14, key=key, time=time, parts=parts)
    for name, n in (("ma_fast", fast), ("ma_slow", slow), ("ma_trend", trend), ("ma_long_trend", long_trend)):
        out = out.withColumn(name, clip(rolling("close", "mean", w, n), 0.01))
    mid, std = rolling("close", "mean", w, 20), rolling("close", "std", w, 20)
    out = out.withColumn("boll_mid", mid).withColumn("boll_upper", mid + 2 * std).withColumn("boll_lower", mid - 2 * std)
    out = out.withColumn("boll_width_pct", safe_div(F.col("boll_upper") - F.col("boll_lower"), "boll_mid") * 100).withColumn("atr_pct", safe_div("atr_14", "close") * 100)
    move = F.coalesce(F.signum(F.col("close") - F.lag("close").over(w)), F.lit(0.0)) * F.coalesce("volume", F.lit(0.0))
    out = out.withColumn("volume_ratio", safe_div("volume", rolling("volume", "mean", w, volume_ma))).withColumn("__move", move).withColumn("obv", F.sum("__move").over(running(w)))
    for n in (5, 20, 60):
        out = out.withColumn(f"pct_{n}", (safe_div("close", F.lag("close", n).over(w)) - 1) * 100)
    before = w.rowsBetween(-60, -1)
    full = F.count("close").over(before) >= 60
    out = out.withColumn("highest_since_60", F.when(full, F.max("close").over(before))).withColumn("lowest_since_60", F.when(full, F.min("close").over(before)))
    out = out.withColumn("drawdown_60_pct", (safe_div("close", "highest_since_60") - 1) * 100).withColumn("patterns", candlesticks(w))
    frame = trailing(w, 18)
    slope = F.covar_samp("high", "low").over(frame) / F.greatest(F.var_samp("low").over(frame), F.lit(1e-10))
    out = out.withColumn("rsrs_beta", F.when(F.count("close").over(frame) >= 18, slope))
    spread = rolling("rsrs_beta", "std", w, 300)
    out = out.withColumn("rsrs_zscore", F.when(spread > 1e-10, (F.col("rsrs_beta") - rolling("rsrs_beta", "mean", w, 300)) / spread))
    out = out.withColumn("__typical", (F.col("high") + F.col("low") + F.col("close")) / 3)
    out = out.withColumn("cci_20", safe_div(F.col("__typical") - rolling("__typical", "mean", w, 20), mean_deviation("__typical", 20, w) * 0.015))
    return scores(out, w).drop("__move", "__typical")


def _points(condition: Column, points: float) -> Column:
    return F.when(condition, float(points)).otherwise(0.0)


def scores(rows: DataFrame, w) -> DataFrame:
    """``trend_score``, ``momentum_score``, ``volume_score``, ``risk_score`` (0 to 100) and ``composite_score``."""
    known = lambda x: F.coalesce(x, F.lit(0.0))
    c = F.col
    trend = _points(c("close") > c("ma_fast"), 20) + _points(c("ma_fast") > c("ma_slow"), 25) + _points(c("ma_slow") > c("ma_trend"), 25) + _points(c("ma_trend") > c("ma_long_trend"), 20) + _points(c("close") >= c("highest_since_60"), 10)
    momentum = known(clip("pct_20", -20.0, 20.0)) + 20 + _points(c("macd_hist") > 0, 20) + known(clip(c("rsi_14") - 30, 0.0, 40.0)) + _points(c("kdj_k") > c("kdj_d"), 20)
    volume = clip(F.coalesce("volume_ratio", F.lit(1.0)), 0.0, 2.5) / 2.5 * 70 + _points(c("obv") > rolling("obv", "mean", w, 20), 30)
    risk = F.lit(20.0) + known(clip("atr_pct", 0.0, 12.0)) * 4 + known(clip(F.abs("drawdown_60_pct"), 0.0, 40.0)) + _points(c("rsi_14") > 80, 15) + _points(c("close") < c("ma_slow"), 20)
    for name, score in (("trend", trend), ("momentum", momentum), ("volume", volume), ("risk", risk)):
        rows = rows.withColumn(f"{name}_score", clip(score, 0.0, 100.0))
    return rows.withColumn("composite_score", c("trend_score") * 0.35 + c("momentum_score") * 0.25 + c("volume_score") * 0.2 + (100 - c("risk_score")) * 0.2)


def intraday(df: DataFrame, key: str = "code", time: str = "ts", parts: int | None = None) -> DataFrame:
    """The lighter bundle for minutes: means of 5 to 60 bars, exponential lines, RSI 6 and 14, channel index of 10, volume ratio,
    range, and whether the means are in rising or falling order."""
    w = ordered(key, time)
    out = recursive_lines(df, (5, 10, 21, 12, 26), (6, 14), True, False, 14, key=key, time=time, parts=parts)
    for n in (5, 10, 20, 60):
        out = out.withColumn(f"ma_{n}", rolling("close", "mean", w, n))
    out = out.withColumn("__typical", (F.col("high") + F.col("low") + F.col("close")) / 3)
    out = out.withColumn("cci_10", safe_div(F.col("__typical") - rolling("__typical", "mean", w, 10), mean_deviation("__typical", 10, w) * 0.015))
    out = out.withColumn("volume_ma", rolling("volume", "mean", w, 20)).withColumn("volume_ratio", safe_div("volume", "volume_ma"))
    lines = [F.col(f"ma_{n}") for n in (5, 10, 20, 60)]
    in_order = lambda test: F.coalesce(reduce(lambda a, b: a & b, (test(x, y) for x, y in zip(lines, lines[1:]))), F.lit(False)).cast("int")
    return out.withColumn("ma_bull", in_order(lambda x, y: x > y)).withColumn("ma_bear", in_order(lambda x, y: x < y)).drop("__typical")


def bars(ticks: DataFrame, width: str, key: str, value: str = "value", time: str = "ts", order: str = "event_id") -> DataFrame:
    """Open, high, low, close and number of ticks by key and ``width``; a bar bears the time at which it starts."""
    at = F.struct(time, order)
    start = F.window(F.col(time).cast("timestamp_ntz"), width)["start"]
    return ticks.groupBy(F.col(key).alias("code"), start.alias("ts")).agg(
        F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"), F.count(value).cast("double").alias("volume"))


def aligned(base: DataFrame, others: dict[str, DataFrame], key: str = "code", time: str = "ts") -> DataFrame:
    """Each row of ``base`` with the last row at or before it of every other frame of the key, its columns prefixed: all frames
    are laid into one sequence that is sorted once."""
    fields = {p: [c for c in df.columns if c not in (key, time)] for p, df in others.items()}
    own = [c for c in base.columns if c not in (key, time)]
    kind = lambda df, names: f"struct<{', '.join(f'`{f.name}`: {f.dataType.simpleString()}' for f in df.select(*names).schema)}>"
    none = lambda df, names: F.lit(None).cast(kind(df, names))
    empty = {p: none(df, fields[p]) for p, df in others.items()}
    pieces = [base.select(key, time, F.lit(1).alias("__own"), F.struct(*own).alias("__base"), *(empty[p].alias(f"__{p}") for p in others))]
    for p, df in others.items():
        pieces.append(df.select(key, time, F.lit(0).alias("__own"), none(base, own).alias("__base"), *((F.struct(*fields[p]) if q == p else empty[q]).alias(f"__{q}") for q in others)))
    w = Window.partitionBy(key).orderBy(time, "__own").rowsBetween(Window.unboundedPreceding, 0)
    rows = reduce(DataFrame.unionByName, pieces).select(key, time, "__own", "__base", *(F.last(f"__{p}", ignorenulls=True).over(w).alias(f"__{p}") for p in others))
    return rows.where("__own = 1").select(key, time, *(F.col(f"__base.{c}").alias(c) for c in own), *(F.col(f"__{p}.{c}").alias(f"{p}_{c}") for p in others for c in fields[p]))


def divergence(df: DataFrame, span: int = 20, key: str = "code", time: str = "date", parts: int | None = None) -> DataFrame:
    """Per key, the last ``span`` rows against the ``span`` before (half the rows each where there are fewer; none under 10):
    ``bearish`` if the close's high rose while the MACD line's fell, else ``bullish`` if its low fell while the line's rose;
    ``strength`` (1 to 100) from the two relative moves."""
    rows = rc.scan(df.select(key, time, "close"), [rc.macd("close", ("__fast", "__slow", "__dea"))], key, time, parts=parts)
    every = Window.partitionBy(key)
    rows = rows.withColumn("dif", F.col("__fast") - F.col("__slow")).withColumn("__n", F.count("*").over(every)).withColumn("__back", F.row_number().over(every.orderBy(F.col(time).desc())))
    span_of = F.least(F.lit(span), F.floor(F.col("__n") / 2))
    part = F.when(F.col("__back") <= span_of, "now").when(F.col("__back") <= 2 * span_of, "then")
    rows = rows.withColumn("__part", part).where(F.col("__part").isNotNull())
    pick = lambda how, c, p: how(F.when(F.col("__part") == p, F.col(c))).alias(f"{how.__name__}_{c}_{p}")
    ends = rows.groupBy(key).agg(F.first("__n").alias("__n"), *(pick(how, c, p) for how in (F.max, F.min) for c in ("close", "dif") for p in ("now", "then")))
    c = F.col
    rise, fade = c("max_close_now") - c("max_close_then"), c("max_dif_then") - c("max_dif_now")
    fall, lift = c("min_close_then") - c("min_close_now"), c("min_dif_now") - c("min_dif_then")
    size = lambda move, line, a, b: clip(F.floor((move / F.greatest(F.abs(c(a)), F.lit(1e-12)) + line / F.greatest(F.abs(c(b)), F.lit(1e-12))) * 500).cast("double"), 1.0, 100.0).cast("int")
    enough = c("__n") >= 10
    bear, bull = enough & (rise > 0) & (fade > 0), enough & (fall > 0) & (lift > 0)
    kind = F.when(bear, "bearish").when(bull, "bullish").otherwise("none")
    strength = F.when(bear, size(rise, fade, "max_close_then", "max_dif_then")).when(bull, size(fall, lift, "min_close_then", "min_dif_then")).otherwise(0)
    return ends.select(key, kind.alias("divergence"), strength.alias("strength"))
