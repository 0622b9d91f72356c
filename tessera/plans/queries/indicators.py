"""Indicator bundles: weekly bars of suppliers, minute bars of event types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.expr import ordered, pct_change, rolling, safe_div
from tessera.operators import indicators as ind
from tessera.plans.panel import PANEL, price_panel, table
from tessera.plans.registry import places, query, rounded
from tessera.sources.scratch import stored

_W = "PARTITION BY code ORDER BY t"


def _lines(source: str, key: str = "code") -> str:
    """States of the recursive lines over ``source`` (code, t, open, high, low, close, volume)."""
    w = f"PARTITION BY {key} ORDER BY t"
    ema = lambda n, x, e: f"{2 / (n + 1)!r} * {x} + {(n - 1) / (n + 1)!r} * {e}"
    wilder = lambda n, x, e: f"CASE WHEN {x} IS NULL THEN {e} WHEN {e} IS NULL THEN {x} ELSE {1 / n!r} * {x} + {1 - 1 / n!r} * {e} END"
    return f"""base AS (SELECT *, row_number() OVER w AS k, close - lag(close) OVER w AS mv,
      greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)) AS tr,
      CASE WHEN count(close) OVER n9 >= 9 THEN (close - min(low) OVER n9) / nullif(max(high) OVER n9 - min(low) OVER n9, 0) * 100 END AS raw
      FROM {source} WINDOW w AS ({w}), n9 AS ({w} ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)),
    moves AS (SELECT *, CASE WHEN mv IS NOT NULL THEN greatest(mv, 0) END AS gain, CASE WHEN mv IS NOT NULL THEN greatest(-mv, 0) END AS loss FROM base),
    s AS (SELECT {key}, k, close AS e5, close AS e10, close AS e12, close AS e26, 0.0::DOUBLE AS dea, gain AS g6, loss AS l6, gain AS g14, loss AS l14, tr AS atr, raw AS kk, raw AS dd FROM moves WHERE k = 1
      UNION ALL SELECT {key}, k, e5, e10, e12, e26, 0.8 * dea + 0.2 * (e12 - e26), g6, l6, g14, l14, atr, kk, CASE WHEN raw IS NULL THEN dd WHEN dd IS NULL THEN kk ELSE 2.0 / 3 * dd + 1.0 / 3 * kk END
      FROM (SELECT b.{key}, b.k, b.raw, s.dea, s.dd, {ema(5, 'b.close', 's.e5')} AS e5, {ema(10, 'b.close', 's.e10')} AS e10, {ema(12, 'b.close', 's.e12')} AS e12, {ema(26, 'b.close', 's.e26')} AS e26,
        {wilder(6, 'b.gain', 's.g6')} AS g6, {wilder(6, 'b.loss', 's.l6')} AS l6, {wilder(14, 'b.gain', 's.g14')} AS g14, {wilder(14, 'b.loss', 's.l14')} AS l14, {wilder(14, 'b.tr', 's.atr')} AS atr,
        CASE WHEN b.raw IS NULL THEN s.kk WHEN s.kk IS NULL THEN b.raw ELSE 2.0 / 3 * s.kk + 1.0 / 3 * b.raw END AS kk
        FROM s JOIN moves b ON b.{key} = s.{key} AND b.k = s.k + 1)),
    lines AS (SELECT b.*, e5, e10, e12 - e26 AS dif, dea, 2 * (e12 - e26 - dea) AS hist, 100 - 100 / (1 + g6 / nullif(l6, 0)) AS rsi6, 100 - 100 / (1 + g14 / nullif(l14, 0)) AS rsi14, atr, kk, dd FROM moves b JOIN s USING ({key}, k))"""


def _mean(x: str, n: int, how: str = "avg") -> str:
    return f"CASE WHEN {x} IS NOT NULL AND count({x}) OVER ({_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) >= {n} THEN {how}({x}) OVER ({_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END"


_BARS = f"{PANEL}, pb AS (SELECT code, date AS t, open, high, low, close, volume FROM panel)"


@query(f"""WITH RECURSIVE {_BARS}, {_lines('pb')},
  a AS (SELECT *, greatest({_mean('close', 5)}, 0.01) AS ma5, greatest({_mean('close', 20)}, 0.01) AS ma20, greatest({_mean('close', 60)}, 0.01) AS ma60, greatest({_mean('close', 120)}, 0.01) AS ma120,
    (close / nullif(lag(close, 20) OVER o, 0) - 1) * 100 AS pct20, volume / nullif({_mean('volume', 20)}, 0) AS vr, sum(coalesce(sign(mv), 0) * volume) OVER (o ROWS UNBOUNDED PRECEDING) AS obv,
    CASE WHEN count(close) OVER b60 >= 60 THEN max(close) OVER b60 END AS top60 FROM lines WINDOW o AS ({_W}), b60 AS ({_W} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
  m AS (SELECT *, {_mean('obv', 20)} AS obv20, CASE WHEN count(close) OVER (PARTITION BY code ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) >= 5 THEN ma5 END AS f5, CASE WHEN k >= 20 THEN ma20 END AS f20, CASE WHEN k >= 60 THEN ma60 END AS f60, CASE WHEN k >= 120 THEN ma120 END AS f120 FROM a),
  p AS (SELECT code, t, atr, hist, kk, dd, rsi14, CASE WHEN close > f5 THEN 20.0 ELSE 0 END + CASE WHEN f5 > f20 THEN 25 ELSE 0 END + CASE WHEN f20 > f60 THEN 25 ELSE 0 END + CASE WHEN f60 > f120 THEN 20 ELSE 0 END + CASE WHEN close >= top60 THEN 10 ELSE 0 END AS trend,
    coalesce(CASE WHEN pct20 IS NOT NULL THEN least(greatest(pct20, -20), 20) END, 0) + 20 + CASE WHEN hist > 0 THEN 20 ELSE 0 END + coalesce(CASE WHEN rsi14 IS NOT NULL THEN least(greatest(rsi14 - 30, 0), 40) END, 0) + CASE WHEN kk > dd THEN 20 ELSE 0 END AS momentum,
    least(greatest(coalesce(vr, 1), 0), 2.5) / 2.5 * 70 + CASE WHEN obv > obv20 THEN 30 ELSE 0 END AS vol,
    20 + least(greatest(coalesce(atr / close * 100, 0), 0), 12) * 4 + least(coalesce(abs((close / top60 - 1) * 100), 0), 40) + CASE WHEN rsi14 > 80 THEN 15 ELSE 0 END + CASE WHEN close < f20 THEN 20 ELSE 0 END AS risk FROM m),
  c AS (SELECT code, t, atr, hist, kk, dd, rsi14, trend::DOUBLE AS trend, least(greatest(momentum, 0), 100)::DOUBLE AS momentum, least(greatest(vol, 0), 100)::DOUBLE AS vol, least(greatest(risk, 0), 100)::DOUBLE AS risk FROM p)
  SELECT code, t AS date, round(hist, 6) AS macd_hist, round(rsi14, 6) AS rsi_14, round(3 * kk - 2 * dd, 6) AS kdj_j, round(atr, 6) AS atr_14, round(trend, 6) AS trend_score, round(momentum, 5) AS momentum_score, round(vol, 5) AS volume_score, round(risk, 5) AS risk_score,
    round(trend * 0.35 + momentum * 0.25 + vol * 0.2 + (100 - risk) * 0.2, 5) AS composite_score FROM c""")
def in_daily_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ind.daily(price_panel(spark, sf_dir))
    exact = {"macd_hist": 6, "rsi_14": 6, "kdj_j": 6, "atr_14": 6, "trend_score": 6, "momentum_score": 5, "volume_score": 5, "risk_score": 5, "composite_score": 5}
    return rows.select("code", "date", *(places(c, n).alias(c) for c, n in exact.items()))


_PATTERN_TESTS = """CASE WHEN small AND top < 0.3 AND bot < 0.3 THEN 'doji' END, CASE WHEN small AND bot > 0.6 AND top < 0.1 THEN 'hammer' END, CASE WHEN small AND top > 0.6 AND bot < 0.1 THEN 'shooting_star' END,
  CASE WHEN ok AND b1 >= 1e-6 AND c > o AND c1 < o1 AND c > o1 AND o < c1 THEN 'bullish_engulf' END, CASE WHEN ok AND b1 >= 1e-6 AND c < o AND c1 > o1 AND o > c1 AND c < o1 THEN 'bearish_engulf' END,
  CASE WHEN ok AND b1 >= 1e-6 AND c > o AND c1 < o1 AND c > (o1 + c1) / 2 AND o < c1 AND c < o1 THEN 'piercing' END, CASE WHEN ok AND b1 >= 1e-6 AND c < o AND c1 > o1 AND o > c1 AND c < (o1 + c1) / 2 THEN 'dark_cloud' END,
  CASE WHEN ok AND b1 > 0 AND b < b1 * 0.3 THEN 'harami' END, CASE WHEN ok AND ok1 AND ok2 AND c2 > o2 AND c1 > o1 AND c > o AND c1 > c2 AND c > c1 THEN 'three_white' END,
  CASE WHEN ok AND ok1 AND ok2 AND c2 < o2 AND c1 < o1 AND c < o AND c1 < c2 AND c < c1 THEN 'three_black' END, CASE WHEN c2 < o2 AND b1 / nullif(s1, 0) < 0.3 AND c > o AND c > (o2 + c2) / 2 THEN 'morning_star' END,
  CASE WHEN c2 > o2 AND b1 / nullif(s1, 0) < 0.3 AND c < o AND c < (o2 + c2) / 2 THEN 'evening_star' END"""


@query(f"""WITH {_BARS}, x AS (SELECT code, t, open AS o, close AS c, abs(close - open) AS b, high - low AS s, high - greatest(open, close) AS hi, least(open, close) - low AS lo FROM pb),
  y AS (SELECT *, s > 0 AND b >= 1e-6 AS ok, hi / nullif(s, 0) AS top, lo / nullif(s, 0) AS bot, lag(o) OVER w AS o1, lag(c) OVER w AS c1, lag(b) OVER w AS b1, lag(s) OVER w AS s1, lag(o, 2) OVER w AS o2, lag(c, 2) OVER w AS c2 FROM x WINDOW w AS ({_W})),
  z AS (SELECT *, ok AND b / nullif(s, 0) < 0.1 AS small, lag(ok) OVER w AS ok1, lag(ok, 2) OVER w AS ok2 FROM y WINDOW w AS ({_W}))
  SELECT code, t AS date, concat_ws(',', {_PATTERN_TESTS}) AS patterns FROM z""")
def in_candlesticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price_panel(spark, sf_dir).select("code", "date", ind.candlesticks(ordered("code", "date")).alias("patterns"))


@query(f"""WITH RECURSIVE {_BARS}, {_lines('pb')},
  n AS (SELECT *, count(*) OVER (PARTITION BY code) AS n, row_number() OVER (PARTITION BY code ORDER BY t DESC) AS back FROM lines), g AS (SELECT *, least(20, n // 2) AS span FROM n),
  e AS (SELECT code, any_value(n) AS n, max(close) FILTER (WHERE back <= span) AS ch, max(close) FILTER (WHERE back > span) AS ph, min(close) FILTER (WHERE back <= span) AS cl, min(close) FILTER (WHERE back > span) AS pl,
    max(dif) FILTER (WHERE back <= span) AS dh, max(dif) FILTER (WHERE back > span) AS eh, min(dif) FILTER (WHERE back <= span) AS dl, min(dif) FILTER (WHERE back > span) AS el FROM g WHERE back <= 2 * span GROUP BY code)
  SELECT code, CASE WHEN n >= 10 AND ch > ph AND eh > dh THEN 'bearish' WHEN n >= 10 AND pl > cl AND dl > el THEN 'bullish' ELSE 'none' END AS divergence,
    CASE WHEN n >= 10 AND ch > ph AND eh > dh THEN least(greatest(floor(((ch - ph) / greatest(abs(ph), 1e-12) + (eh - dh) / greatest(abs(eh), 1e-12)) * 500), 1), 100)
      WHEN n >= 10 AND pl > cl AND dl > el THEN least(greatest(floor(((pl - cl) / greatest(abs(pl), 1e-12) + (dl - el) / greatest(abs(el), 1e-12)) * 500), 1), 100) ELSE 0 END::INT AS strength FROM e""")
def in_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ind.divergence(price_panel(spark, sf_dir))


def _duck_bars(minutes: int) -> str:
    return f"""SELECT event_type AS code, time_bucket(INTERVAL {minutes} MINUTE, ts, TIMESTAMP '2024-01-01') AS t, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(value)::DOUBLE AS volume FROM events GROUP BY 1, 2"""


@query(f"""WITH RECURSIVE hb AS ({_duck_bars(60)}), {_lines('hb')},
  a AS (SELECT code, t, hist, rsi6, rsi14, e5, (high + low + close) / 3 AS tp, volume / nullif({_mean('volume', 20)}, 0) AS vr, {_mean('close', 5)} AS m5, {_mean('close', 10)} AS m10, {_mean('close', 20)} AS m20, {_mean('close', 60)} AS m60 FROM lines),
  c AS (SELECT *, list(tp) OVER ({_W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS tps FROM a)
  SELECT code, t AS ts, round(e5, 6) AS ema_5, round(hist, 6) AS macd_hist, round(rsi6, 6) AS rsi_6, round(rsi14, 6) AS rsi_14, round(vr, 6) AS volume_ratio,
    CASE WHEN len(tps) = 10 THEN round((tp - list_avg(tps)) / nullif(list_avg(list_transform(tps, lambda v: abs(v - list_avg(tps)))) * 0.015, 0), 4) END AS cci_10,
    coalesce(m5 > m10 AND m10 > m20 AND m20 > m60, false)::INT AS ma_bull, coalesce(m5 < m10 AND m10 < m20 AND m20 < m60, false)::INT AS ma_bear FROM c""")
def in_intraday(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of each event type."""
    rows = ind.intraday(ind.bars(table(spark, sf_dir, "events"), "1 hour", "event_type"))
    return rows.select("code", "ts", *(F.round(c, 4 if c == "cci_10" else 6).alias(c) for c in ("ema_5", "macd_hist", "rsi_6", "rsi_14", "volume_ratio", "cci_10")), "ma_bull", "ma_bear")


@query(f"""WITH RECURSIVE both_frames AS (SELECT '30' || code AS fc, '30' AS f, * FROM ({_duck_bars(30)}) UNION ALL SELECT '60' || code, '60', * FROM ({_duck_bars(60)})), {_lines('both_frames', 'fc')},
  five AS (SELECT code, t, round((close / nullif(lag(close, 5) OVER w, 0) - 1) * 100, 6) AS pct, round(volume / nullif({_mean('volume', 20)}, 0), 6) AS vr FROM ({_duck_bars(5)}) WINDOW w AS ({_W})),
  m AS (SELECT code, t, f, round(hist, 6) AS hist, round(kk, 6) AS kk, round(atr, 6) AS atr, round(rsi14, 6) AS rsi, round(e10, 6) AS e10 FROM lines)
  SELECT five.code, five.t AS ts, pct AS min5_pct_5bars, vr AS min5_vol_ratio, x.hist AS min30_macd_hist, x.kk AS min30_kdj_k, x.atr AS min30_atr_14, y.rsi AS min60_rsi_14, y.e10 AS min60_ema_10
  FROM five ASOF LEFT JOIN (SELECT * FROM m WHERE f = '30') x ON x.code = five.code AND x.t <= five.t ASOF LEFT JOIN (SELECT * FROM m WHERE f = '60') y ON y.code = five.code AND y.t <= five.t""")
def in_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-minute bars with the last lines of 30- and 60-minute bars."""
    events = table(spark, sf_dir, "events")
    frames = {n: stored(ind.bars(events, f"{n} minutes", "event_type"), f"bars{n}") for n in (5, 30, 60)}
    w = ordered("code", "ts")
    five = frames[5].select("code", "ts", (pct_change("close", w, 5) * 100).alias("min5_pct_5bars"), safe_div("volume", rolling("volume", "mean", w, 20)).alias("min5_vol_ratio"))
    half = ind.recursive_lines(frames[30], (), (), True, True, 14, time="ts").select("code", "ts", "macd_hist", "kdj_k", "atr_14")
    hour = ind.recursive_lines(frames[60], (10,), (14,), time="ts").select("code", "ts", "rsi_14", "ema_10")
    return rounded(ind.aligned(five, {"min30": half, "min60": hour}))
